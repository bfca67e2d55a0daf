"""Exact dedup by deterministic block naming (native).

A text is cut into fixed-size blocks of bytes. The distinct blocks are sorted and
numbered, so a block is an integer name. Then adjacent names are paired, the
distinct pairs are sorted and numbered in turn, and so on until each document has
one name. Names of a level are equal only where the pairs, and so in the end the
bytes, are equal: the identity has no collisions.

Rows meet by a 128-bit key of the block while the level-0 names are made; each
key's least and greatest block are compared, and if any differ the keys are drawn
anew with another seed, so an unlucky key never joins two different blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, materialise, text_or_empty

BLOCK_BYTES = 4096
SPACES = r"[\x20\x09-\x0D]+"


def normalised(name: str = "text"):
    return F.regexp_replace(text_or_empty(name), SPACES, " ")


def _blocks(binary, block_bytes: int):
    last = F.floor((F.greatest(F.length(binary), F.lit(1)) - 1) / block_bytes).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(binary, i * block_bytes + 1, F.lit(block_bytes)))


def _named(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Sorts the distinct keys within their hash partition and numbers them."""
    counted = pairs.groupBy(*keys).agg(F.count("*").alias("cnt"))
    return materialise(counted.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: rid (row number), doc_id, text_sha256, level, name.

    Two documents have the same (level, name) if and only if their normalised
    texts are equal. A null text counts as empty, and an empty text is one empty
    block. Repeated rows each keep their own rid. Columns other than doc_id and
    text are ignored, whatever their names.
    """
    texts = docs.select("doc_id", normalised().alias("text"))
    seed = 0
    while True:
        key = [F.xxhash64(F.lit(seed + i), F.col("b")) for i in (0, 1)]
        blocks = texts.select(F.explode(_blocks(F.encode("text", "UTF-8"), block_bytes)).alias("b"))
        grouped = blocks.select(key[0].alias("k1"), key[1].alias("k2"), "b").groupBy("k1", "k2").agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.count("*").alias("cnt"))
        names = materialise(
            grouped.sortWithinPartitions("lo", "k1", "k2").select("k1", "k2", "cnt", (F.col("lo") != F.col("hi")).alias("clash"), F.monotonically_increasing_id().alias("name"))
        )
        if names.where("clash").isEmpty():
            break
        seed += 2
    names = names.drop("clash")
    binary = F.encode("text", "UTF-8")
    rows = materialise(
        texts.select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2(binary, 256).alias("text_sha256"),
            F.transform(_blocks(binary, block_bytes), lambda b: F.struct(F.xxhash64(F.lit(seed), b).alias("k1"), F.xxhash64(F.lit(seed + 1), b).alias("k2"))).alias("keys"),
        )
    )
    widest, total = rows.agg(F.max(F.size("keys")), F.sum(F.size("keys"))).first()
    if widest is None:
        return rows.select("rid", "doc_id", "text_sha256", F.lit(0).alias("level"), F.lit(0).cast("long").alias("name"))
    occurrences = rows.select("rid", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "k")).select("rid", "n", "pos", "k.k1", "k.k2")
    current = materialise(join_skewed(occurrences, names, ["k1", "k2"], "cnt", total, F.xxhash64("rid", "pos")).select("rid", "n", "pos", "name"))
    done, level, size = [current.where("n = 1").select("rid", F.lit(0).alias("level"), "name")], 0, widest
    while size > 1:
        level, size = level + 1, (size + 1) // 2
        even = F.when(F.col("pos") % 2 == 0, F.col("name"))
        odd = F.when(F.col("pos") % 2 == 1, F.col("name"))
        pairs = materialise(
            current.where("n > 1").groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.ceil(F.first("n") / 2).cast("int").alias("n"), F.max(even).alias("a"), F.coalesce(F.max(odd), F.lit(-1)).alias("b"))
        )
        current = materialise(join_skewed(pairs, _named(pairs, ["a", "b"]), ["a", "b"], "cnt", pairs.count(), F.xxhash64("rid", "pos")).select("rid", "n", "pos", "name"))
        done.append(current.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
    every = done[0]
    for one in done[1:]:
        every = every.unionByName(one)
    return rows.select("rid", "doc_id", "text_sha256").join(every, "rid")


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row per document.

    Of equal texts the row with the smallest doc_id stays (a null doc_id is the
    largest; of rows that repeat a doc_id, one stays). No rows give no rows.
    """
    named = materialise(identities(docs, block_bytes))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("rid").alias("rid"))).alias("first")
    groups = materialise(named.groupBy("level", "name").agg(first, F.count("*").alias("cnt")).select("level", "name", "first.id", "first.rid", "cnt").withColumnRenamed("rid", "first_rid").withColumn("level", F.col("level").cast("long")))
    left = named.withColumn("level", F.col("level").cast("long"))
    out = join_skewed(left, groups, ["level", "name"], "cnt", named.count(), F.col("rid"))
    return out.select("doc_id", F.col("id").alias("keep_id"), F.col("cnt").alias("group_size"), (F.col("rid") == F.col("first_rid")).alias("kept"), "text_sha256")
