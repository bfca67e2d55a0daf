"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is of characters as they are (see char_model): its table has every n-gram
of the trusted documents and grows with them. It lies in parts by n-gram; documents'
n-grams are counted and joined to the parts, and their costs summed per document. A
document's perplexity is held against a quantile of its language's trusted documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import char_model
from .common import join_checked, materialise, text_or_empty

#: Halves of the trusted documents, each scored by a model of the other.
FOLDS = 2
#: Share of a language's trusted documents that stay below its threshold, and a margin in bits above it.
QUANTILE, MARGIN = 0.995, 0.05
#: A document's cost is averaged with so many symbols of the trusted mean; a language's threshold with that of all languages, as if so many of its trusted documents had it.
PRIOR_SYMBOLS, PRIOR_DOCUMENTS = 40, 30


def trusted_ids(labels: DataFrame) -> DataFrame:
    return materialise(labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias("_trusted")).distinct())


def _keys() -> list[Column]:
    """128 bits that tell rows of other doc_id, lang or text apart."""
    own = [x for c in ("doc_id", "lang", "text") for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(i), *own).alias(f"_k{i}") for i in (0, 1)]


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, _k0, _k1, _bits, _limit of (doc_id, lang, text); a document is rejected if its _bits exceed its _limit.

    All trusted documents give counts. For the quantiles each is scored by a model of
    the other half of them, so that a small corpus is not taken at its own word. A
    language's limit is its own quantile, drawn to that of all the less the more
    trusted documents it has; a null language is one of its own. Nothing is rejected of
    a language without trusted documents. Bits are rounded to 0.001, so that quantiles
    are exact and the same however rows are dealt.
    """
    trusted = trusted_ids(labels)
    half = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    known = join_checked(docs.select("doc_id", "lang", "text"), trusted.withColumnRenamed("_trusted", "doc_id"), ["doc_id"], "left_semi").withColumn("fold", half)
    counts = materialise(char_model.count_ngrams(known))
    if counts.isEmpty():
        return docs.select("doc_id", *_keys(), F.lit(0.0).alias("_bits"), F.lit(math.inf).alias("_limit"))
    every = counts.drop("fold").groupBy(*(c for c in counts.columns if c not in ("fold", "n"))).agg(F.sum("n").alias("n"))
    table, base = char_model.build(materialise(counts.withColumn("model", 1 - F.col("fold")).drop("fold").unionByName(every.withColumn("model", F.lit(FOLDS)))))
    own = F.when(half.isin([m for m in range(FOLDS) if m in base]), half).otherwise(FOLDS)
    marked = join_checked(docs, trusted.withColumn("_is", F.lit(True)).withColumnRenamed("_trusted", "doc_id"), ["doc_id"], "left")
    lang = F.coalesce(F.concat(F.lit("L"), "lang"), F.lit("n"))
    rows = marked.select("doc_id", *_keys(), lang.alias("_lang"), text_or_empty().alias("text"), F.lit(FOLDS).alias("_every"), F.when(F.col("_is"), own).alias("_half"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    scored = materialise(char_model.scored(rows, table, base, ["_every", "_half"], size))
    told = scored.where("_half is not null")
    mean = told.agg(F.sum("_bits1") / F.sum("_symbols")).first()[0]
    if mean is None:  # no trusted document has any text
        return docs.select("doc_id", *_keys(), F.lit(0.0).alias("_bits"), F.lit(math.inf).alias("_limit"))
    smoothed = lambda c: F.round((F.col(c) + PRIOR_SYMBOLS * mean) / (F.col("_symbols") + PRIOR_SYMBOLS), 3).alias("_bits")
    counted = materialise(told.groupBy("_lang", smoothed("_bits1")).agg(F.count("*").alias("_n")))
    cut = F.percentile("_bits", F.lit(quantile), F.col("_n")) + margin
    limit = counted.agg(cut.alias("c")).first()["c"]
    drawn = (F.col("_n") * F.col("_own") + F.lit(PRIOR_DOCUMENTS * limit)) / (F.col("_n") + PRIOR_DOCUMENTS)
    limits = materialise(counted.groupBy("_lang").agg(cut.alias("_own"), F.sum("_n").alias("_n")).select("_lang", drawn.alias("_limit")))
    out = scored.select("doc_id", "_k0", "_k1", "_lang", smoothed("_bits0"))
    return join_checked(out, limits, ["_lang"], "left").select("doc_id", "_k0", "_k1", "_bits", F.coalesce("_limit", F.lit(math.inf)).alias("_limit"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, perplexity, threshold, keep: a row per document.

    A null or empty text has the trusted mean and is kept, a long one is scored whole. A
    document at its threshold is kept. Repeated rows are judged alike, each of them. Labels
    without doc_id, or of documents that are not there, say nothing; further columns are
    ignored; no rows give no rows.
    """
    out = judged(docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")), labels, quantile, margin)
    return out.select("doc_id", F.pow(F.lit(2.0), "_bits").alias("perplexity"), F.pow(F.lit(2.0), "_limit").alias("threshold"), (F.col("_bits") <= F.col("_limit")).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """``docs`` without those that the classifier rejects (see classify), all columns as they were, whatever their names; texts are not shuffled."""
    inside = docs.toDF(*(c if c in ("doc_id", "lang", "text") else f"c{i}" for i, c in enumerate(docs.columns)))
    bad = materialise(judged(inside.select("doc_id", "lang", F.col("text").cast("string").alias("text")), labels, quantile, margin).where("_bits > _limit").select("_k0", "_k1").distinct())
    kept = join_checked(inside.withColumns({f"_k{i}": k for i, k in enumerate(_keys())}), bad, ["_k0", "_k1"], "left_anti")
    return kept.select(*inside.columns).toDF(*docs.columns)
