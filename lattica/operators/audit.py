"""Review state and imported findings, held against a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialise

STATUSES = ("reviewed", "flagged", "follow-up", "ignored")
# Impacts, most severe first.
IMPACTS = ("High", "Medium", "Low", "Informational", "Optimization")

#: Bytes of a file whose spans and points are joined with each other.
CELL = 4096

REVIEW = "node string, status string, body_hash string, reviewer string, note string, at timestamp"
FINDING = "id string, check string, impact string, confidence string, description string, nodes array<struct<id:string,body_hash:string>>, locations array<struct<file:string,offset:bigint,length:bigint>>"


def set_reviews(reviews: DataFrame, nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """``reviews`` with ``updates`` (node, status, reviewer, note, at) in place of those of the same node, at its current hash."""
    fresh = updates.join(nodes.select(F.col("id").alias("node"), F.coalesce("body_hash", F.lit("")).alias("body_hash")), "node")
    return reviews.join(fresh.select("node"), "node", "left_anti").unionByName(fresh.select(*reviews.columns))


def clear_reviews(reviews: DataFrame, ids: list[str]) -> DataFrame:
    return reviews.where(~F.col("node").isin(ids))


def review_staleness(reviews: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``state``: orphaned without its node, stale after a change of the body, else current."""
    known = nodes.select(F.col("id").alias("node"), F.coalesce("body_hash", F.lit("")).alias("_now"))
    state = F.when(F.col("_now").isNull(), "orphaned").when(F.col("_now") != F.coalesce("body_hash", F.lit("")), "stale").otherwise("current")
    return reviews.join(known, "node", "left").withColumn("state", state).drop("_now")


def migrate_reviews(reviews: DataFrame, matches: DataFrame) -> DataFrame:
    """Reviews under the ids of the later graph; unmatched ones keep theirs."""
    moved = reviews.join(matches.select(F.col("before").alias("node"), "after"), "node", "left")
    return moved.withColumn("node", F.coalesce("after", "node")).drop("after")


def findings_staleness(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, state): orphaned if no node is left, stale if any body changed or is gone, else current; without nodes current."""
    each = findings.select("id", F.explode_outer("nodes").alias("n"))
    known = nodes.select(F.col("id").alias("nid"), F.coalesce("body_hash", F.lit("")).alias("_now"))
    joined = each.select("id", F.col("n.id").alias("nid"), F.coalesce(F.col("n.body_hash"), F.lit("")).alias("h")).join(known, "nid", "left")
    has = F.col("nid").isNotNull()
    by = joined.groupBy("id").agg(F.count_if(has).alias("n"), F.count_if(has & F.col("_now").isNull()).alias("gone"), F.count_if(has & (F.col("_now") != F.col("h"))).alias("changed"))
    return by.select("id", F.when((F.col("n") > 0) & (F.col("gone") == F.col("n")), "orphaned").when(F.col("gone") + F.col("changed") > 0, "stale").otherwise("current").alias("state"))


def impact_rank(column: str = "impact"):
    return F.coalesce(*(F.when(F.col(column) == x, i) for i, x in enumerate(IMPACTS)), F.lit(len(IMPACTS)))


def audit_projection(reviews: DataFrame, findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, status, review_state, findings, worst): review and findings by node, findings by impact."""
    state = review_staleness(reviews, nodes).select("node", "status", F.col("state").alias("review_state"))
    each = findings.select("id", "impact", F.explode("nodes").alias("n")).select(F.col("n.id").alias("node"), F.struct(impact_rank().alias("rank"), "id").alias("f"), "impact")
    by = each.groupBy("node").agg(F.sort_array(F.collect_set("f")).alias("fs"), F.min_by("impact", "f").alias("worst"))
    by = by.select("node", F.transform("fs", lambda x: x["id"]).alias("findings"), "worst")
    return state.join(by, "node", "full_outer").withColumn("findings", F.coalesce("findings", F.array().cast("array<string>")))


def audit_summary(reviews: DataFrame, findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row of counters: reviews by status and state, findings by state."""
    r = review_staleness(reviews, nodes).agg(*(F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in STATUSES), F.count_if(F.col("state") == "stale").alias("stale_reviews"), F.count_if(F.col("state") == "orphaned").alias("orphaned_reviews"))
    f = findings_staleness(findings, nodes).agg(F.count("*").alias("findings"), F.count_if(F.col("state") == "stale").alias("stale_findings"))
    return r.withColumn("_", F.lit(1)).join(f.withColumn("_", F.lit(1)), "_").drop("_")


def cells(offset: Column, length: Column) -> Column:
    """The stretches of a file, CELL bytes each, that a span touches; a span and a point meet by (file, cell)."""
    return F.sequence(F.floor(offset / CELL), F.floor((offset + F.greatest(length, F.lit(0))) / CELL))


def containing(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """``spans`` (key, file, offset, length) with node: the smallest node that contains each, ties by id; null if none does."""
    held = nodes.select(F.col("file").alias("f"), F.col("id").alias("node"), F.col("offset").alias("o"), F.col("length").alias("l"), F.explode(cells(F.col("offset"), F.col("length"))).alias("cell"))
    fits = (F.col("file") == F.col("f")) & (F.col("at_cell") == F.col("cell")) & (F.col("o") <= F.col("offset")) & (F.col("offset") + F.col("length") <= F.col("o") + F.col("l"))
    hit = spans.withColumn("at_cell", F.floor(F.col("offset") / CELL)).join(held, fits).groupBy("key").agg(F.min_by("node", F.struct("l", "node")).alias("node"))
    return spans.join(hit, "key", "left")


def _suffixes(path: Column) -> Column:
    """What stands behind each ``/`` of a path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def match_paths(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, file): a file of that path, else one of which either is a suffix at a ``/``; of several the one that shares most, then the least.

    Either side's suffixes are joined by equality, so files of one name meet only where they fit.
    """
    exact = paths.join(files, paths["path"] == files["file"]).select("path", "file")
    rest = materialise(paths.join(exact.select("path"), "path", "left_anti"))
    inside = rest.select("path", F.explode(_suffixes(F.col("path"))).alias("file")).where("file <> ''").join(files.select("file"), "file").select("path", "file")
    around = files.select("file", F.explode(_suffixes(F.col("file"))).alias("path")).join(rest, "path").select("path", "file")
    shared = F.least(F.length("file"), F.length("path"))
    best = inside.unionByName(around).groupBy("path").agg(F.min_by("file", F.struct(-shared, "file")).alias("file"))
    return exact.unionByName(best)


def import_findings(results: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, unmapped) of scanner results (seq, check, impact, confidence, description, elements).

    ``seq`` is a result's place in its report. An element (paths, offset, length) has up to
    three spellings of its file, of which the first that is a file's path counts, else the
    first that fits one by suffix. It maps to the smallest node containing it; all places
    are kept, those of unknown files under the first spelling. A result is named
    ``check@file:offset`` by its first place, later ones of that name get ``#1`` and on. One
    without any mapped element is unmapped, for one of three reasons.
    """
    rows = materialise(results.select("seq", F.coalesce("check", F.lit("unknown")).alias("check"), F.coalesce("impact", F.lit("Unknown")).alias("impact"), F.coalesce("confidence", F.lit("Unknown")).alias("confidence"), F.trim(F.coalesce("description", F.lit(""))).alias("description"), "elements"))
    each = rows.select("seq", F.posexplode("elements").alias("pos", "e")).where("e.offset is not null").select("seq", "pos", "e.paths", "e.offset", F.coalesce("e.length", F.lit(0).cast("long")).alias("length"))
    each = materialise(each.withColumn("paths", F.filter("paths", lambda p: p.isNotNull() & (p != ""))))
    said = each.select("seq", "pos", F.posexplode("paths").alias("i", "path"))
    files = nodes.select("file").distinct()
    known = materialise(match_paths(said.select("path").distinct(), files))
    order = F.struct(F.when(F.col("path") == F.col("file"), 0).otherwise(1), "i")
    held = said.join(known, "path").groupBy("seq", "pos").agg(F.min_by("file", order).alias("file"))
    placed = materialise(each.join(held, ["seq", "pos"], "left").withColumn("at", F.coalesce("file", F.get("paths", F.lit(0)), F.lit(""))))
    hit = containing(placed.where("file is not null").select(F.struct("seq", "pos").alias("key"), "file", "offset", "length"), nodes).where("node is not null").select("key.seq", "node")
    hashes = nodes.select(F.col("id").alias("node"), F.coalesce("body_hash", F.lit("")).alias("body_hash"))
    by = hit.distinct().join(hashes, "node").groupBy("seq").agg(F.sort_array(F.collect_list(F.struct(F.col("node").alias("id"), "body_hash"))).alias("nodes"))
    place = F.struct(F.col("at").alias("file"), "offset", "length")
    places = placed.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", place.alias("l")))), lambda x: x["l"]).alias("locations"))
    first = F.col("locations")[0]
    found = rows.join(by, "seq").join(places, "seq").withColumn("base", F.concat("check", F.lit("@"), first["file"], F.lit(":"), first["offset"]))
    n = F.row_number().over(Window.partitionBy("base").orderBy("seq")) - 1
    named = found.withColumn("id", F.when(n == 0, F.col("base")).otherwise(F.concat("base", F.lit("#"), n)))
    why = F.when(F.coalesce(F.size("elements"), F.lit(0)) <= 0, "the finding names no source element").when(F.col("locations").isNull(), "no element carries a source mapping").otherwise("no node contains any of its places")
    lost = rows.join(by.select("seq"), "seq", "left_anti").join(places, "seq", "left").select("check", "description", why.alias("reason"))
    return named.select("id", "check", "impact", "confidence", "description", "nodes", "locations"), lost
