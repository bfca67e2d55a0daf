"""Parsing again only what has changed: a log of files and a table of parsed units, both only ever appended to."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import materialise
from .ingest import cache_key, parse_keyed

_LOG = "version bigint, file string, key string, modified timestamp, gone boolean"
_UNITS = "key string, unit string"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def state(spark: SparkSession, folder: str) -> DataFrame:
    """(file, key, modified) of the files as the last build saw them."""
    last = _table(spark, f"{folder}/log", _LOG).groupBy("file").agg(F.max_by(F.struct("key", "modified", "gone"), "version").alias("s"))
    return last.where("not s.gone").select("file", "s.key", "s.modified")


def changes(listing: DataFrame, known: DataFrame) -> DataFrame:
    """(file, status) of (file, modified) against a state: added, changed, removed or same."""
    both = listing.select("file", F.col("modified").alias("now")).join(known.select("file", F.col("modified").alias("then"), F.lit(True).alias("_known")), "file", "full")
    status = F.when(F.col("_known").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") == F.col("then"), "same").otherwise("changed")
    return both.select("file", status.alias("status"))


def is_fresh(listing: DataFrame, known: DataFrame) -> bool:
    """Whether nothing was added, changed or removed since the state."""
    return changes(listing, known).where("status <> 'same'").isEmpty()


def update(sources: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(units, what was done) of (file, content, modified): only texts that are new here are parsed.

    Files whose time is as it was are not read; of the others, those whose text has a unit from any earlier build are not
    parsed. New units are appended before the log is, each by a write that shows as a whole or not at all, so a run that
    ends between the two leaves units that the next one finds. Rows of ``what was done`` are (file, status, parsed).
    """
    spark = sources.sparkSession
    known = materialise(state(spark, folder))
    done = materialise(changes(sources, known))
    moved = done.where("status in ('added', 'changed')").select("file")
    since = sources.join(moved, "file", "left_semi").agg(F.min("modified")).first()[0]
    texts = sources.where(F.col("modified") >= F.lit(since)) if since is not None else sources.limit(0)  # a filter that file sources prune by
    keyed = materialise(texts.join(moved, "file", "left_semi").select("file", "content", "modified", cache_key().alias("key")))
    units = _table(spark, f"{folder}/units", _UNITS)
    fresh = keyed.join(units.select("key"), "key", "left_anti").select("file", "content", "key")
    new = materialise(parse_keyed(fresh))
    if not new.isEmpty():
        new.write.mode("append").parquet(f"{folder}/units")
    version = (_table(spark, f"{folder}/log", _LOG).agg(F.max("version")).first()[0] or 0) + 1
    gone = done.where("status = 'removed'").select("file", F.lit(None).cast("string").alias("key"), F.lit(None).cast("timestamp").alias("modified"), F.lit(True).alias("gone"))
    entries = keyed.select("file", "key", "modified", F.lit(False).alias("gone")).unionByName(gone)
    if not entries.isEmpty():
        entries.select(F.lit(version).cast("long").alias("version"), "file", "key", "modified", "gone").write.mode("append").parquet(f"{folder}/log")
    live = state(spark, folder).select("key").distinct()
    # two builds at once may each have appended a text's unit; they are equal
    parsed = _table(spark, f"{folder}/units", _UNITS).join(live, "key", "left_semi").groupBy("key").agg(F.any_value("unit").alias("unit"))
    told = done.join(keyed.join(new.select("key"), "key", "left_semi").select("file", F.lit(True).alias("parsed")), "file", "left")
    return parsed, told.select("file", "status", F.coalesce("parsed", F.lit(False)).alias("parsed"))


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """The live files and their units in a new folder; those of texts that are gone are left behind."""
    known = state(spark, folder)
    known.select(F.lit(1).cast("long").alias("version"), "file", "key", "modified", F.lit(False).alias("gone")).write.parquet(f"{target}/log")
    _table(spark, f"{folder}/units", _UNITS).join(known.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]).write.parquet(f"{target}/units")
