"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import line_dedup, mixing, ngram_join, packing, quality
from lattica.llm.common import materialise, read_table

#: (name, function of (spark, docs, sf_dir)); each works on what its predecessor kept.
STAGES = [
    ("quality classifier", lambda spark, docs, sf_dir: quality.keep_good(docs, read_table(spark, sf_dir, "labels"))),
    ("line dedup", lambda spark, docs, sf_dir: line_dedup.dedup_documents(docs)),
    ("n-gram Jaccard join", lambda spark, docs, sf_dir: ngram_join.one_of_each(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixing.mixed_documents(docs)),
    ("best-fit packing", lambda spark, docs, sf_dir: packing.pack_documents(docs).drop("ids")),
]

#: The classifier's model and the tokenizer have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: pieces of tokens with their places in sequences.

    Nulls, empty texts, repeated rows and ties are each stage's matter (see their
    docstrings); no rows give no rows.
    """
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
