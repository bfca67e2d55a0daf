"""Entrypoints, reachability, access control and call-then-write order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ACCESS_RANK, EXTERNAL_SUBKINDS, Graph
from .closure import close_over_callers, closure, direct_external_callers, reached
from .reach import Counts

# Names of modifiers recognised without configuration.
ACCESS_MODIFIERS = ("onlyOwner", "onlyRole", "auth", "requiresAuth", "restricted")
REENTRANCY_GUARDS = ("nonReentrant",)
ENTRY_SUBKINDS, ENTRY_VISIBILITIES, DEPLOYABLE = ("function", "fallback", "receive"), ("public", "external"), ("contract", "library")


def deployable_scopes(contracts: DataFrame, inherits: DataFrame | None = None) -> DataFrame:
    """(id): contracts and libraries, and all that they inherit from, by their orders or, where given, over inherits (from_id, to_id) without orders."""
    own = contracts.where(F.col("contract_kind").isin(*DEPLOYABLE))
    if inherits is not None:
        return reached(own.select("id"), inherits.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")))
    bases = own.select(F.explode("linearized_bases").alias("id"))
    return own.select("id").unionByName(bases).distinct()


def entrypoints(functions: DataFrame, scopes: DataFrame, configured: list[str] | None = None) -> DataFrame:
    """Functions that can be called from outside, and configured ones.

    A configured contract names its callable functions, a configured function itself; both need a body.
    """
    callable_ = F.col("subkind").isin(*ENTRY_SUBKINDS) & F.col("visibility").isin(*ENTRY_VISIBILITIES)
    declared = functions.where(callable_ & F.col("has_body")).join(scopes.select(F.col("id").alias("scope")), "scope", "left_semi").select(*functions.columns)
    if not configured:
        return declared
    extra = functions.where(F.col("has_body") & (F.col("id").isin(configured) | (F.col("scope").isin(configured) & callable_)))
    return declared.unionByName(extra.join(declared.select("id"), "id", "left_anti").select(*functions.columns))


def successors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) between functions: calls with their possible targets, applied modifiers, constructors of what is created."""
    functions = nodes.where("kind = 'Function'").select("id", "subkind", "scope")
    ids = functions.select("id")
    calls = edges.where("kind in ('calls', 'modifiedBy')").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    if "possible_targets" in edges.columns:
        arms = edges.where("kind = 'calls'").select(F.col("from_id").alias("src"), F.explode("possible_targets").alias("dst"))
        calls = calls.unionByName(arms)
    builders = functions.where("subkind = 'constructor'").select(F.col("scope").alias("to_id"), F.col("id").alias("dst"))
    made = edges.where("kind = 'creates'").select(F.col("from_id").alias("src"), "to_id").join(builders, "to_id").select("src", "dst")
    return calls.unionByName(made).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst").distinct()


def reachability(entries: DataFrame, arcs: DataFrame) -> DataFrame:
    """(origin, id): each entrypoint with every function it reaches, itself included."""
    return closure(entries.select(F.col("id").alias("origin"), "id"), arcs)


def _scopes(graph: Graph) -> DataFrame:
    """Deployable scopes of a graph, over its inherits edges where its contracts have no orders."""
    contracts = graph.nodes.where("kind = 'Contract'")
    return deployable_scopes(contracts, None if "linearized_bases" in contracts.columns else graph.edges.where("kind = 'inherits'"))


def entrypoint_counts(graph: Graph, configured: list[str] | None = None) -> DataFrame:
    """(id, origins): how many entrypoints reach each function that any reaches, without the sets."""
    entries = entrypoints(graph.nodes.where("kind = 'Function'"), _scopes(graph), configured)
    return Counts(entries, successors(graph.nodes, graph.edges)).origins()


def externally_reachable(entries: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id): functions that some entrypoint reaches, without the pairs."""
    edges = arcs.select(F.col("dst").alias("from_id"), F.col("src").alias("to_id"), F.lit("calls").alias("kind"))
    return close_over_callers(edges, entries.select("id"))


def applied_modifiers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_id, name, checks_sender): resolved or not."""
    target = nodes.select(F.col("id").alias("to_id"), "name", (F.coalesce(F.col("flags.checksSender"), F.lit(False)) & (F.col("kind") == "Function")).alias("checks_sender"))
    return edges.where("kind = 'modifiedBy'").select("from_id", "to_id").join(target, "to_id").select("from_id", "name", "checks_sender")


def access_control(functions: DataFrame, applied: DataFrame, recognised: tuple[str, ...] = ACCESS_MODIFIERS) -> DataFrame:
    """(id, guards, access): a recognised modifier gives high; a sender check in a modifier or the body low.

    ``functions`` has (id, checks_sender); ``applied`` (from_id, name, checks_sender).
    """
    known = F.col("name").isin(*recognised)
    by = applied.groupBy(F.col("from_id").alias("id")).agg(
        F.max(F.when(known, ACCESS_RANK["high"]).when(F.col("checks_sender"), ACCESS_RANK["low"]).otherwise(0)).alias("r"),
        F.sort_array(F.collect_set(F.when(known | F.col("checks_sender"), F.col("name")))).alias("guards"),
    )
    rank = F.greatest(F.coalesce("r", F.lit(0)), F.when(F.col("checks_sender"), ACCESS_RANK["low"]).otherwise(0))
    access = F.when(rank == 2, "high").when(rank == 1, "low").otherwise("none")
    return functions.select("id", "checks_sender").join(by, "id", "left").select("id", F.coalesce("guards", F.array().cast("array<string>")).alias("guards"), access.alias("access"))


def guarded(applied: DataFrame, guards: tuple[str, ...] = REENTRANCY_GUARDS) -> DataFrame:
    return applied.where(F.col("name").isin(*guards)).select(F.col("from_id").alias("id")).distinct()


def classify_calls(edges: DataFrame) -> DataFrame:
    """calls edges with ``class``: external, reaches-external or internal."""
    reaches = close_over_callers(edges, direct_external_callers(edges)).select(F.col("id").alias("to_id"), F.lit(True).alias("_r"))
    kind = F.when(F.col("subkind").isin(*EXTERNAL_SUBKINDS), "external").when(F.col("_r"), "reaches-external").otherwise("internal")
    return edges.where("kind = 'calls'").join(reaches, "to_id", "left").withColumn("class", kind).drop("_r")


def call_then_write(edges: DataFrame, writers: DataFrame | None = None, transitive: bool = True) -> DataFrame:
    """(id): functions with a write after their earliest external call, by site offset.

    ``edges`` has first_offset and last_offset. Transitively, a call that reaches an
    external call counts as one, and a call that reaches a writer is a write.
    """
    calls = edges.where("kind = 'calls'")
    out = calls.where(F.col("subkind").isin(*EXTERNAL_SUBKINDS))
    writes = edges.where("kind = 'writes'").select("from_id", "last_offset")
    if transitive:
        classed = classify_calls(edges)
        out = classed.where("class <> 'internal'")
        seeds = writers if writers is not None else edges.where("kind = 'writes'").select(F.col("from_id").alias("id")).distinct()
        reach = close_over_callers(edges, seeds).select(F.col("id").alias("to_id"))
        writes = writes.unionByName(calls.join(reach, "to_id", "left_semi").select("from_id", "last_offset"))
    first = out.groupBy("from_id").agg(F.min("first_offset").alias("first"))
    last = writes.groupBy("from_id").agg(F.max("last_offset").alias("last"))
    return first.join(last, "from_id").where("last > first").select(F.col("from_id").alias("id"))


def analyse(graph: Graph, recognised: tuple[str, ...] = ACCESS_MODIFIERS, guards: tuple[str, ...] = REENTRANCY_GUARDS, configured: list[str] | None = None, pairs: bool = True) -> Graph:
    """The graph with the four analysed fields on its functions."""
    nodes, edges = graph.nodes, graph.edges
    functions = nodes.where("kind = 'Function'")
    entries = entrypoints(functions, _scopes(graph), configured)
    arcs = successors(nodes, edges)
    if pairs:
        reach = reachability(entries, arcs).groupBy("id").agg(F.sort_array(F.collect_set("origin")).alias("_e"))
    else:
        reach = externally_reachable(entries, arcs).select("id", F.array().cast("array<string>").alias("_e"))
    reach = reach.withColumn("_x", F.lit(True))
    applied = applied_modifiers(nodes, edges)
    access = access_control(functions.select("id", F.coalesce(F.col("flags.checksSender"), F.lit(False)).alias("checks_sender")), applied, recognised)
    timed = edges.withColumns({"first_offset": F.array_min(F.transform("sites", lambda s: s["offset"])), "last_offset": F.array_max(F.transform("sites", lambda s: s["offset"]))})
    writers = functions.where("flags.writesState").select("id")
    late = call_then_write(timed, writers).withColumn("_late", F.lit(True))
    safe = guarded(applied, guards).withColumn("_safe", F.lit(True))
    out = nodes.join(reach, "id", "left").join(access, "id", "left").join(late, "id", "left").join(safe, "id", "left")
    own = F.col("kind") == "Function"
    out = out.withColumns({
        "externally_reachable": F.when(own, F.coalesce("_x", F.lit(False))),
        "entrypoints": F.when(own, F.coalesce("_e", F.array().cast("array<string>"))),
        "access_control": F.when(own, F.struct(F.col("guards").alias("modifiers"), F.col("access").alias("confidence"))),
        "reentrancy": F.when(own, F.struct(F.coalesce("_late", F.lit(False)).alias("externalCallThenWrite"), F.coalesce("_safe", F.lit(False)).alias("guarded"))),
    })
    return Graph(out.select(*nodes.columns), edges)
