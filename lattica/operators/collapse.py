"""From one row per site to one row per edge, and what follows from edges alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CALL_KINDS, RESOLUTIONS, STRUCTURAL_KINDS, Graph, named, rank_of
from .closure import SMALL_SIDE

THRESHOLD = 0.7


def edge_id() -> Column:
    return F.concat_ws("|", "from_id", "to_id", "kind", F.coalesce("subkind", F.lit("")))


def known_drafts(drafts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Drafts of which both ends are nodes."""
    ids = nodes.select("id")
    return drafts.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def collapse(drafts: DataFrame) -> DataFrame:
    """One edge per (from, to, kind, subkind), by order of ``seq``.

    Sites stay in order, the weakest resolution wins, and a draft's reason replaces
    the edge's only if the draft is weaker than all before it and has one.
    """
    row = F.struct("seq", "site", rank_of("resolution", RESOLUTIONS).alias("rank"), "reason", "linearization_index", "targets", F.coalesce("cross_trust_boundary", F.lit(False)).alias("cross"))
    grouped = drafts.groupBy("from_id", "to_id", "kind", "subkind").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    first = F.struct(F.lit(-1).alias("rank"), F.lit(None).cast("string").alias("reason"))
    weaker = lambda a, x: F.struct(F.greatest(a["rank"], x["rank"]).alias("rank"), F.when(x["rank"] > a["rank"], F.coalesce(x["reason"], a["reason"])).otherwise(a["reason"]).alias("reason"))
    seen = F.array_distinct(F.flatten(F.transform("rows", lambda x: F.coalesce(x["targets"], F.array().cast("array<string>")))))
    return grouped.withColumn("w", F.aggregate("rows", first, weaker)).select(
        edge_id().alias("id"), "kind", "subkind", "from_id", "to_id", named(F.col("w.rank"), RESOLUTIONS).alias("resolution"),
        F.transform("rows", lambda x: x["site"]).alias("sites"), F.size("rows").cast("long").alias("count"), seen.alias("possible_targets"),
        F.exists("rows", lambda x: x["cross"]).alias("cross_trust_boundary"), F.col("rows")[0]["linearization_index"].alias("linearization_index"), F.col("w.reason").alias("reason"),
    )


def collapse_counts(drafts: DataFrame) -> DataFrame:
    """The edge's key, count, weakest resolution and first offset, by mergeable aggregates.

    What most queries need, without gathering the sites of an edge in one row.
    """
    weakest = F.max(rank_of("resolution", RESOLUTIONS))
    return drafts.groupBy("from_id", "to_id", "kind", "subkind").agg(F.count("*").alias("count"), weakest.alias("rank"), F.min(F.struct("seq", "site.offset")).alias("first")).select(
        edge_id().alias("id"), "from_id", "to_id", "kind", "subkind", "count", named(F.col("rank"), RESOLUTIONS).alias("resolution"), F.col("first.offset").alias("first_offset"),
    )


def resolution_score(edges: DataFrame, excluded_files: DataFrame | None = None) -> DataFrame:
    """A row each for 'overall' and 'calls': sites by resolution, total and the confident share.

    Edges whose first site is in an excluded file do not count.
    """
    if excluded_files is not None:
        edges = edges.withColumn("_file", F.col("sites")[0]["file"]).join(excluded_files.select(F.col("file").alias("_file")), "_file", "left_anti")
    counted = edges.where(~F.col("kind").isin(*STRUCTURAL_KINDS))
    kinds = F.when(F.col("kind").isin(*CALL_KINDS), F.array(F.lit("overall"), F.lit("calls"))).otherwise(F.array(F.lit("overall")))
    sums = [F.coalesce(F.sum(F.when(F.col("resolution") == r, F.col("count"))), F.lit(0)).cast("long").alias(r) for r in RESOLUTIONS]
    score = counted.select(F.explode(kinds).alias("scope"), "resolution", "count").groupBy("scope").agg(*sums)
    both = edges.sparkSession.createDataFrame([("overall",), ("calls",)], "scope string")
    out = both.join(score, "scope", "left").na.fill(0)
    total = sum((F.col(r) for r in RESOLUTIONS), F.lit(0))
    return out.withColumn("total", total.cast("long")).withColumn("confident", F.when(F.col("total") == 0, 1.0).otherwise((F.col("semantic") + F.col("heuristic")) / F.col("total")))


def percent(value: float) -> str:
    """A share as a whole percentage, halves up."""
    return f"{int(value * 100 + 0.5)}%"


def select_mode(score: DataFrame, threshold: float = THRESHOLD) -> tuple[str, str]:
    """(mode, reason): full with any compiler-certain site, else by the confident share of call sites."""
    by = {r["scope"]: r for r in score.collect()}
    overall, calls = by["overall"], by["calls"]
    if overall["semantic"] > 0:
        return "full", f"Compiler artifacts were found; {percent(overall['semantic'] / max(1, overall['total']))} of edges are certain."
    if calls["total"] == 0:
        return "structural", "There are no call sites, so there is no call graph; everything else is complete."
    share, least = percent(calls["confident"]), percent(threshold)
    if calls["confident"] >= threshold:
        return "heuristic", f"No compiler artifacts; {share} of call edges resolved confidently, which is not below {least}."
    return "structural", f"No compiler artifacts, and {share} of call edges resolved confidently, which is below {least}; call edges are withheld."


def structural(graph: Graph) -> Graph:
    """Without call edges, and without placeholders that no edge refers to any more."""
    edges = graph.edges.where(~F.col("kind").isin(*CALL_KINDS))
    lost = graph.nodes.where("kind = 'Unresolved'")
    used = edges.select(F.col("from_id").alias("id")).unionByName(edges.select(F.col("to_id").alias("id")))
    if lost.count() <= SMALL_SIDE:  # edges are many times the placeholders
        used = used.join(F.broadcast(lost.select("id")), "id", "left_semi").distinct()
    kept = graph.nodes.where("kind != 'Unresolved'").unionByName(lost.join(used, "id", "left_semi"))
    return Graph(kept, edges)


def placeholders(drafts: DataFrame) -> DataFrame:
    """Project-wide Unresolved nodes of drafts to ``?category:name``; the first draft gives reason and file."""
    lost = drafts.where(F.col("to_id").startswith("?")).groupBy("to_id").agg(F.min_by(F.struct("reason", "site"), "seq").alias("x"))
    colon = F.locate(":", F.col("to_id"))
    return lost.select(
        F.col("to_id").alias("id"), F.lit("Unresolved").alias("kind"), F.substring("to_id", colon + 1, F.length("to_id")).alias("name"), F.col("x.site.file").alias("file"),
        F.lit(None).cast("string").alias("scope"), F.col("x.site").alias("src"), F.lit(True).alias("synthetic"), F.substring("to_id", F.lit(2), colon - 2).alias("category"), F.col("x.reason").alias("reason"),
    )


def mark_trust_boundaries(edges: DataFrame, nodes: DataFrame, matches: Column | None) -> DataFrame:
    """Marks call edges into files for which ``matches`` (over ``file``) holds; marks are never taken away."""
    if matches is None:
        return edges
    outside = nodes.where(matches).select(F.col("id").alias("to_id"), F.lit(True).alias("_out"))
    marked = F.coalesce("cross_trust_boundary", F.lit(False)) | (F.col("kind").isin(*CALL_KINDS) & F.coalesce("_out", F.lit(False)))
    return edges.join(outside, "to_id", "left").withColumn("cross_trust_boundary", marked).select(*edges.columns)


def with_state_flags(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ors reads and writes edges into the flags, and lists applied modifiers in order."""
    by = edges.groupBy(F.col("from_id").alias("id")).agg(
        F.max(F.col("kind") == "reads").alias("_r"), F.max(F.col("kind") == "writes").alias("_w"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "modifiedBy", F.struct(F.col("sites")[0]["offset"].alias("o"), "to_id")))), lambda x: x["to_id"]).alias("_m"),
    )
    function = F.col("kind") == "Function"
    flags = F.col("flags").withField("readsState", F.coalesce(F.col("flags.readsState"), F.lit(False)) | F.coalesce("_r", F.lit(False))).withField("writesState", F.coalesce(F.col("flags.writesState"), F.lit(False)) | F.coalesce("_w", F.lit(False)))
    out = nodes.join(by, "id", "left").withColumn("flags", F.when(function, flags).otherwise(F.col("flags")))
    return out.withColumn("modifiers", F.when(function, F.array_distinct(F.coalesce("_m", F.array().cast("array<string>")))).otherwise(F.col("modifiers"))).select(*nodes.columns)
