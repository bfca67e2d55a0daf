"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is heavy when it holds more than one row in HEAVY_SHARE; at most HEAVY_SHARE keys can.
HEAVY_SHARE = 1000
#: Up to so many rows and bytes a side is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20
#: A batch of texts on its way to a Python worker; a longer text is a batch of its own.
BATCH_BYTES = "4m"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    folder = tempfile.mkdtemp(prefix="lattica-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that all machines share; a local one, removed at exit, only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = _own_dir()
    return f"{named.rstrip('/')}/lattica/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and
    what was drawn once (row numbers, partition ids) stays as it was drawn. A folder
    for each value of ``by``, if there is one."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def limit_batches(spark: SparkSession, size: str = BATCH_BYTES) -> None:
    """Batches of texts for Python workers end at ``size`` bytes too, and not only at a number of rows."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fits_broadcast(table: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether a materialised table has ``rows`` rows and ``most`` bytes or fewer; texts, arrays and the like are measured."""
    n = table.count()
    if n > rows:
        return False
    wide = [f.name for f in table.schema if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType))]
    size = n * 8 * len(table.columns)
    if n and wide:
        size += table.agg(F.sum(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in wide)))))).first()[0]
    return size <= most


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a materialised side that is broadcast if it has ``limit`` rows and ``most`` bytes or fewer, and shuffled beyond."""
    if fits_broadcast(right, limit, most):
        right = F.broadcast(right)
    return left.join(right, on, how)


def join_skewed(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int, spread: Column) -> DataFrame:
    """Left join with a table of one row per key and its row ``count``.

    ``right`` is materialised. Its heavy keys, HEAVY_SHARE at most, are broadcast; rows
    that found theirs carry a null-free, spread-out key through the shuffle join of
    the others, so that no key gathers more than ``total`` / HEAVY_SHARE rows.
    """
    values = [c for c in right.columns if c not in on]
    heavy = right.where(F.col(count) * HEAVY_SHARE > F.lit(total))
    first = left.join(F.broadcast(heavy.select(*on, *(F.col(c).alias(f"_h_{c}") for c in values))), on, "left")
    found = F.col(f"_h_{count}").isNotNull()
    keys = [F.when(found, F.xxhash64(spread, F.lit(i)).cast(left.schema[k].dataType)).otherwise(F.col(k)).alias(f"_k_{k}") for i, k in enumerate(on)]
    rest = right.where(F.col(count) * HEAVY_SHARE <= F.lit(total)).select(*(F.col(k).alias(f"_k_{k}") for k in on), *(F.col(c).alias(f"_r_{c}") for c in values))
    joined = first.select("*", *keys).join(rest, [f"_k_{k}" for k in on], "left")
    return joined.select(*left.columns, *(F.when(found, F.col(f"_h_{c}")).otherwise(F.col(f"_r_{c}")).alias(c) for c in values))


def heavy_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, _salts), materialised: keys with more than one row in HEAVY_SHARE of ``rows``, and into how many parts to deal them."""
    total = rows.count()
    counts = rows.groupBy(key).agg(F.count("*").alias("_c")).where(F.col("_c") * HEAVY_SHARE > F.lit(total))
    return materialise(counts.select(key, F.ceil(F.col("_c") * HEAVY_SHARE / F.lit(max(1, total))).cast("int").alias("_salts")))


def join_salted(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame, spread: Column) -> DataFrame:
    """Inner join with a table of one wide row per key; rows of ``heavy`` keys (HEAVY_SHARE at most) are dealt out by
    ``spread`` to copies of their right row, HEAVY_SHARE copies and as many again at most."""
    small = F.broadcast(heavy)
    dealt = left.join(small, key, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"))).drop("_salts")
    copies = right.join(small, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")
