"""Mixing sources to target weights by hash-threshold histograms (native).

Each document has a 60-bit hash of its doc_id. Its source takes every document a
whole number of times, and those with a hash below the source's threshold once
more. Thresholds come from histograms: words summed by source and hash bucket show
which bucket the budget ends in; only that bucket is split again, until it holds
one hash. Nothing is sorted, and the same threshold is found on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_checked, materialise, text_or_empty

WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"
BITS, STEP = 60, 12


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds target to (skey, source_size): shares of 150% of all sizes by weight, 2 x source_size at most.

    Sources rank by code point, null last, and weigh ``weights`` in turn. What a
    capped source leaves is shared by weight among the others: in the order of
    cap / weight, a source is capped if its share of what the capped ones before it
    left exceeds its cap. The table has a row per source; all rows meet in one task.
    """
    rank = F.row_number().over(Window.orderBy(F.col("skey") == "n", "skey")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights)) + 1).cast("long")
    t = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * 2)
    order = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    since = order.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("left2", F.sum("source_size").over(Window.partitionBy()) * 3 - 2 * F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("ws", F.sum("w").over(since))
    t = t.withColumn("capped", F.col("left2") * F.col("w") > 2 * F.col("cap") * F.col("ws"))
    open_ = F.when(~F.col("capped"), F.struct("left2", "ws"))
    level = F.first(open_, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("level", level)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("level.left2") * F.col("w")).cast("double") / (2 * F.col("level.ws")).cast("double"))
    return t.select("skey", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds copies and threshold to targets: rows of (skey, h, size) with h below it are taken once more."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    state = materialise(state.withColumn("lo", F.lit(0).cast("long")).withColumn("threshold", F.when(F.col("rest") <= 0, F.lit(0).cast("long"))))
    for shift in range(BITS - STEP, -1, -STEP):
        todo = state.where("threshold is null").select("skey", "rest", "lo")
        if todo.isEmpty():
            break
        width = 1 << shift
        inside = join_checked(rows, materialise(todo.drop("rest")), ["skey"], "inner").where((F.col("h") >= F.col("lo")) & (F.col("h") < F.col("lo") + width * (1 << STEP)))
        buckets = inside.groupBy("skey", F.shiftright(F.col("h") - F.col("lo"), shift).alias("b"))
        hist = buckets.agg(F.sum("size").alias("s"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        ahead = F.coalesce(F.sum("s").over(Window.partitionBy("skey").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        edge = hist.withColumn("ahead", ahead).join(todo, "skey").where((F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("s") >= F.col("rest")))
        edge = edge.select("skey", "ahead", "s", "h0", "h1", (F.col("lo") + F.col("b") * width).alias("lo1"))
        take = 2 * F.col("ahead") + F.col("s") <= 2 * F.col("rest")
        single = F.when(F.col("h0") == F.col("h1"), F.when(take, F.col("h0") + 1).otherwise(F.col("h0")))
        found = F.when(F.col("threshold").isNotNull(), F.col("threshold")).when(F.col("s").isNull(), F.lit(1 << BITS)).otherwise(single)
        state = materialise(
            state.join(edge, "skey", "left").select(
                "skey", "source_size", "target", "copies", found.alias("threshold"),
                (F.col("rest") - F.coalesce("ahead", F.lit(0))).alias("rest"), F.coalesce("lo1", "lo").alias("lo"),
            )
        )
    return state.select("skey", "source_size", "target", "copies", "threshold")


def _keys() -> tuple:
    """skey, size and h of a document."""
    digest = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, BITS // 4)
    skey = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("S"), "source"))
    return skey.alias("skey"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), F.conv(digest, 16, 10).cast("long").alias("h")


def _cuts(rows: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    return thresholds(rows, source_targets(rows.groupBy("skey").agg(F.sum("size").alias("source_size")), weights))


def _times():
    return (F.col("copies") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken, times: a row per document.

    Size counts the words of the text, 0 for null. taken is size times the number
    of times the mix takes the document, 2 at most. Rows that repeat a doc_id share
    a hash and are taken alike; a null doc_id hashes as an empty one.
    """
    rows = materialise(docs.select("doc_id", *_keys()))
    out = join_checked(rows, _cuts(rows, weights), ["skey"], "inner")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).alias("taken"), _times().alias("times"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, in the columns it has; texts, however long, are not shuffled.

    Words count, and null texts, repeated rows and null ids go, as in mix; no rows give no rows.
    """
    skey, size, h = _keys()
    cuts = _cuts(materialise(docs.select(skey, size, h)), weights)
    keyed = docs.select(F.struct("*").alias("doc"), skey, h)
    taken = join_checked(keyed, cuts, ["skey"], "inner").where(_times() > 0)
    return taken.select("doc", F.explode(F.sequence(F.lit(1), _times()))).select("doc.*")
