"""Point queries and tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CALL_KINDS, EXTERNAL_SUBKINDS, Graph, kind_is
from .audit import CELL, cells


def externals(functions: DataFrame, unprotected: bool = False, payable: bool = False) -> DataFrame:
    """Functions declared callable from outside, with mutates_state."""
    out = functions.where((~F.col("subkind").isin("modifier", "constructor")) & F.col("visibility").isin("public", "external"))
    out = out.withColumn("mutates_state", ~F.col("state_mutability").isin("view", "pure"))
    if unprotected:
        out = out.where((F.col("access") == "none") & F.col("mutates_state"))
    return out.where("state_mutability = 'payable'") if payable else out


def accessors(edges: DataFrame, functions: DataFrame, variable: str, kind: str) -> DataFrame:
    """Functions with an edge of ``kind`` ('reads' or 'writes') to a variable."""
    hit = edges.where((F.col("to_id") == variable) & (F.col("kind") == kind))
    return hit.join(functions.select(F.col("id").alias("from_id"), "visibility"), "from_id").select(F.col("from_id").alias("function"), "count", "resolution", "visibility")


def unresolved_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    target = nodes.where("kind = 'Unresolved'").select(F.col("id").alias("to_id"), F.col("name").alias("callee"), "category", F.col("reason").alias("_reason"))
    out = edges.where("resolution = 'unresolved'").join(target, "to_id")
    return out.withColumn("reason", F.coalesce("reason", "_reason")).drop("_reason").orderBy("category", "from_id", "to_id")


def tally(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("count"))


def unresolved_categories(nodes: DataFrame) -> DataFrame:
    """(category, count) of placeholder nodes, most first, then by name."""
    return tally(nodes.where("kind = 'Unresolved'"), "category").orderBy(F.desc("count"), "category")


def graph_stats(graph: Graph) -> DataFrame:
    """(measure, key, count): every counter of a graph in long form."""
    nodes, edges = graph.nodes, graph.edges
    contracts, functions = nodes.where("kind = 'Contract'"), nodes.where("kind = 'Function'")
    callable_ = (~F.col("subkind").isin("modifier", "constructor")) & F.col("visibility").isin("public", "external")
    mutates = ~F.col("state_mutability").isin("view", "pure")
    real = lambda measure, df, **counts: df.agg(*(F.count_if(c).alias(k) for k, c in counts.items())).select(F.lit(measure).alias("measure"), F.explode(F.map_from_arrays(F.array(*map(F.lit, counts)), F.array(*map(F.col, counts)))).alias("key", "count"))
    by = lambda measure, df, key: df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("count")).select(F.lit(measure).alias("measure"), "key", "count")
    parts = [
        by("nodes", nodes, "kind"), by("edges", edges, "kind"), by("resolution", edges, "resolution"), by("contract_kind", contracts, "contract_kind"),
        by("unresolved", nodes.where("kind = 'Unresolved'"), "category"),
        real("contracts", contracts, total=F.lit(True), test=F.col("is_test"), mock=F.col("is_mock"), real=~F.col("is_test") & ~F.col("is_mock")),
        real("functions", functions, total=F.lit(True), callable=callable_, reachable=F.col("externally_reachable"), unprotected=callable_ & mutates & (F.col("access_control.confidence") == "none"),
             payable=F.col("state_mutability") == "payable", assembly=F.col("flags.hasAssembly"), delegatecall=F.col("flags.hasDelegatecall"), lowlevel=F.col("flags.hasLowLevelCall"),
             call_then_write=F.col("reentrancy.externalCallThenWrite")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def inspect_node(graph: Graph, node: str) -> DataFrame:
    """(direction, edge_kind, virtual, other, name, resolution, count): members, incoming and outgoing relations.

    Virtual arms of calls are relations to each possible target, and ambiguous.
    """
    edges = graph.edges
    base = edges.select("kind", "from_id", "to_id", "resolution", "count", F.lit(False).alias("virtual"))
    arms = edges.where(kind_is(*CALL_KINDS)).select("kind", "from_id", "to_id", "count", F.explode("possible_targets").alias("t")).where("t <> to_id")
    every = base.unionByName(arms.select("kind", "from_id", F.col("t").alias("to_id"), F.lit("ambiguous").alias("resolution"), "count", F.lit(True).alias("virtual")))
    out_ = every.where((F.col("from_id") == node) & (F.col("kind") != "declares")).select(F.lit("outgoing").alias("direction"), F.col("to_id").alias("other"), F.col("kind").alias("edge_kind"), "virtual", "resolution", "count")
    in_ = every.where((F.col("to_id") == node) & (F.col("kind") != "declares")).select(F.lit("incoming").alias("direction"), F.col("from_id").alias("other"), F.col("kind").alias("edge_kind"), "virtual", "resolution", "count")
    members = graph.nodes.where(F.col("scope") == node).select(F.lit("member").alias("direction"), F.col("id").alias("other"), F.lit("declares").alias("edge_kind"), F.lit(False).alias("virtual"), F.lit("heuristic").alias("resolution"), F.lit(1).cast("long").alias("count"))
    names = graph.nodes.select(F.col("id").alias("other"), "name")
    return out_.unionByName(in_).unionByName(members).join(names, "other", "left").orderBy("direction", "edge_kind", "virtual", "other")


def file_lenses(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, callers, external_sites, written, read): one pass over the edges for the functions given."""
    ids = functions.select("id")
    out = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").groupBy(F.col("from_id").alias("id")).agg(
        F.count_distinct(F.when(F.col("kind") == "writes", F.col("to_id"))).alias("written"), F.count_distinct(F.when(F.col("kind") == "reads", F.col("to_id"))).alias("read"),
        F.coalesce(F.sum(F.when((F.col("kind") == "calls") & F.col("subkind").isin(*EXTERNAL_SUBKINDS), F.col("count"))), F.lit(0)).alias("external_sites"),
    )
    into = edges.where(F.col("kind").isin(*CALL_KINDS)).select("from_id", F.col("to_id").alias("id"))
    if "possible_targets" in edges.columns:
        into = into.unionByName(edges.where(F.col("kind").isin(*CALL_KINDS)).select("from_id", F.explode("possible_targets").alias("id")))
    callers = into.join(ids, "id", "left_semi").groupBy("id").agg(F.count_distinct("from_id").alias("callers"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return ids.join(callers, "id", "left").join(out, "id", "left").select("id", zero("callers"), zero("external_sites"), zero("written"), zero("read"))


def lens_title(lenses: DataFrame) -> DataFrame:
    """Adds ``title``: the non-zero counts of a lens in words."""
    def part(c: str, one: str, many: str):
        return F.when(F.col(c) == 1, f"1 {one}").when(F.col(c) > 1, F.concat(F.col(c).cast("string"), F.lit(f" {many}")))

    words = F.concat_ws(" · ", part("callers", "caller", "callers"), part("external_sites", "external call", "external calls"), part("written", "write", "writes"), part("read", "read", "reads"))
    return lenses.withColumn("title", words)


def nodes_in_file(nodes: DataFrame, file: str) -> DataFrame:
    return nodes.where((~F.coalesce("synthetic", F.lit(False))) & (F.col("src.file") == file)).orderBy("src.offset", "id")


def node_at(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """(file, at, id): the smallest node whose half-open span holds each point; of equal spans the deepest kind.

    ``points`` has (file, at). They meet by file and stretch of it, the span is a residual condition.
    """
    depth = F.when(F.col("kind") == "SourceUnit", 0).when(F.col("kind") == "Contract", 1).otherwise(2)
    spans = nodes.where("src is not null").select(F.col("src.file").alias("file"), "id", F.col("src.offset").alias("o"), F.col("src.length").alias("l"), depth.alias("d"), F.explode(cells(F.col("src.offset"), F.col("src.length"))).alias("cell"))
    hit = points.withColumn("cell", F.floor(F.col("at") / CELL)).join(spans, ["file", "cell"]).where("at >= o and at < o + l")
    return hit.groupBy("file", "at").agg(F.min_by("id", F.struct("l", -F.col("d"), "id")).alias("id"))
