"""Audit files as a stream: the reference kind of change-driven work, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.storage import materialise

RECORD = "node string, status string, body_hash string, reviewer string, note string, at timestamp"


def review_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Review entries from JSON-lines files as they appear in a folder."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 100).json(folder)


def latest_reviews(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """The last entry of each node; state older than ``delay`` is let go."""
    return stream.withWatermark("at", delay).groupBy("node").agg(F.max_by(F.struct("status", "body_hash", "reviewer", "note", "at"), "at").alias("r")).select("node", "r.*")


def follow(stream: DataFrame, nodes: DataFrame, on_change: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Calls ``on_change`` with each batch of entries and their state against ``nodes``."""
    from ..operators.audit import review_staleness

    def batch(df: DataFrame, number: int) -> None:
        on_change(review_staleness(df, nodes), number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


# Whole files: each is the audit state at a time

_ENTRIES = "map<string,struct<status:string,bodyHash:string,reviewer:string,note:string,at:string>>"
_STATE = "node string, status string, body_hash string, reviewer string, note string, at timestamp"


def snapshot_stream(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(path, modified, content) of review files as they appear, one whole file a batch, oldest first."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    return files.option("maxFilesPerTrigger", 1).option("pathGlobFilter", pattern).load(folder).select("path", F.col("modificationTime").alias("modified"), "content")


def entries_of(snapshots: DataFrame) -> DataFrame:
    """Review entries of snapshots; one that is not a map of entries has none that are valid, and gives none."""
    parsed = snapshots.select(F.from_json(F.decode("content", "UTF-8"), _ENTRIES).alias("m"))
    rows = parsed.select(F.explode("m").alias("node", "r")).where("r.status in ('reviewed', 'flagged', 'follow-up', 'ignored')")
    return rows.select("node", "r.status", F.coalesce("r.bodyHash", F.lit("")).alias("body_hash"), "r.reviewer", "r.note", F.to_timestamp("r.at").alias("at"))


def deltas(before: DataFrame, now: DataFrame) -> DataFrame:
    """(node, change, status): entries set, changed or cleared between two states."""
    sides = [df.select("node", F.struct("status", "body_hash", "reviewer", "note", "at").alias(c)) for df, c in ((before, "old"), (now, "new"))]
    both = sides[0].join(sides[1], "node", "full").where("not old <=> new")
    change = F.when(F.col("old").isNull(), "set").when(F.col("new").isNull(), "cleared").otherwise("changed")
    return both.select("node", change.alias("change"), F.coalesce("new.status", "old.status").alias("status"))


def follow_snapshots(stream: DataFrame, folder: str, on_change: Callable[[DataFrame, int], None] | None = None, once: bool = False) -> StreamingQuery:
    """Follows whole review files and keeps what changed from one to the next as a table by batch, below ``folder``.

    The state after batch n is a table of its own, written once and under the batch's number, so a batch that runs
    again after a failure compares with the state before it and writes the same. A file that cannot be read as JSON
    is passed over: the state stays.
    """

    def path(kind: str, number: int) -> str:
        return f"{folder}/{kind}/batch={number}"

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        before = spark.read.schema(_STATE).parquet(path("state", number - 1)) if number else spark.createDataFrame([], _STATE)
        readable = df.where(F.try_parse_json(F.decode("content", "UTF-8")).isNotNull())
        readable = materialise(readable)
        now = before if readable.isEmpty() else entries_of(readable)
        now.write.mode("overwrite").parquet(path("state", number))
        deltas(before, spark.read.schema(_STATE).parquet(path("state", number))).write.mode("overwrite").parquet(path("changes", number))
        if on_change:
            on_change(spark.read.parquet(path("changes", number)), number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()
