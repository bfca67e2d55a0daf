"""Comparing two graphs: matching nodes in tiers, statuses, and what follows for an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigrams, name_similarity
from ..plans.storage import materialise
from ..schema import ACCESS_RANK, DANGEROUS, EXTERNAL_SUBKINDS, Graph, rank_of

FUZZY_THRESHOLD = 0.55
#: Shares of a fuzzy score: signature, name, neighbourhood.
WEIGHTS = (0.4, 0.3, 0.3)

# The attributes whose change is a change of the node, by kind; positions and what follows from other nodes are not among them.
COMPARED = {
    "SourceUnit": ("name", "file", "pragma", "version_support", "recovered", "unresolved_imports"),
    "Contract": ("name", "file", "scope", "contract_kind", "base_names", "linearized_bases", "linearization_certainty", "is_fully_implemented", "is_test", "is_mock"),
    "Function": ("name", "file", "scope", "subkind", "visibility", "state_mutability", "is_virtual", "is_override", "modifiers", "params", "returns", "has_body", "body_hash", "interface_hash", "flags", "access_control"),
    "StateVariable": ("name", "file", "scope", "type", "visibility", "is_constant", "is_immutable", "is_transient", "is_mapping"),
    "Event": ("name", "file", "scope", "params", "is_anonymous"),
    "Error": ("name", "file", "scope", "params"),
    "Struct": ("name", "file", "scope"),
    "Enum": ("name", "file", "scope"),
    "UserDefinedValueType": ("name", "file", "scope"),
    "Unresolved": ("name", "category"),
}
EDGE_COMPARED = ("count", "cross_trust_boundary", "linearization_index")
SEVERITY = {
    "new-external-entrypoint": "medium", "access-control-weakened": "high", "new-external-call": "info", "became-payable": "medium",
    "storage-layout-changed": "high", "became-externally-reachable": "medium", "new-dangerous-op": "high",
}
SEVERITIES = ("high", "medium", "low", "info")
# The order in which changes are told.
STATUSES = ("removed", "added", "renamed", "moved", "modified")


def _left(side: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    return side.join(matches.select(F.col(key).alias("id")), "id", "left_anti")


def match_exact(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("id").join(after.select("id"), "id").select(F.col("id").alias("before"), F.col("id").alias("after"), F.lit("exact").alias("tier"), F.lit(1.0).alias("confidence"))


def _unique_pairs(before: DataFrame, after: DataFrame, on: list[str], tier: str, confidence: float) -> DataFrame:
    """Pairs of the keys that one node on either side has."""
    one = lambda side, name: side.groupBy(*on).agg(F.count("*").alias("n"), F.min("id").alias(name)).where("n = 1").drop("n")
    return one(before, "before").join(one(after, "after"), on).select("before", "after", F.lit(tier).alias("tier"), F.lit(confidence).alias("confidence"))


def match_body(before: DataFrame, after: DataFrame) -> DataFrame:
    """Equal bodies: those of one name first, then of one scope, then whatever is alone on both sides."""
    has = lambda side: materialise(side.where("kind = 'Function' and body_hash <> ''").select("id", "name", "scope", "body_hash"))
    b, a, parts = has(before), has(after), []
    for extra in (["name"], ["scope"], []):
        found = materialise(_unique_pairs(b, a, ["body_hash", *extra], "body", 0.95))
        parts.append(found)
        b, a = materialise(_left(b, found, "before")), materialise(_left(a, found, "after"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def match_signature(before: DataFrame, after: DataFrame) -> DataFrame:
    """One name in one container, of one kind, alone on both sides."""
    key = lambda side: side.withColumn("container", F.coalesce("scope", "file", F.lit("")))
    return _unique_pairs(key(before), key(after), ["kind", "container", "name"], "signature", 0.9)


def _changed(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, scope, name, params, returns, near, tokens) of functions of a container; tokens are what two of any likeness share."""
    near = arcs.groupBy(F.col("from_id").alias("id")).agg(F.sort_array(F.collect_set("name")).alias("near"))
    kind = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<name:string,type:string,indexed:boolean,storageLocation:string>>")), lambda p: p["type"])
    f = nodes.where("kind = 'Function' and scope is not null").select("id", "scope", "name", kind("params").alias("params"), kind("returns").alias("returns"))
    f = f.join(near, "id", "left").withColumn("near", F.coalesce("near", F.array().cast("array<string>")))
    tag = lambda sigil, words: F.transform(words, lambda w: F.concat(F.lit(sigil), w))
    return materialise(f.withColumn("tokens", F.array_distinct(F.concat(F.array(F.concat(F.lit("="), F.lower("name"))), tag("b", bigrams(F.col("name"))), tag("c", F.col("near"))))))


def scored_pairs(before: DataFrame, after: DataFrame, threshold: float) -> DataFrame:
    """(before, after, score) of pairs of a container that share part of their names or what they call, and score enough.

    They meet in an inverted index of tokens. A score weighs the likeness of parameters
    and returns, of names (bigrams), and of the names that the functions call.
    """
    one = before.select("scope", F.explode("tokens").alias("token"), F.col("id").alias("before"))
    two = after.select("scope", F.explode("tokens").alias("token"), F.col("id").alias("after"))
    met = one.join(two, ["scope", "token"]).select("before", "after").distinct()
    left = before.select(F.col("id").alias("before"), *(F.col(c).alias(f"x_{c}") for c in ("name", "params", "returns", "near")))
    right = after.select(F.col("id").alias("after"), *(F.col(c).alias(f"y_{c}") for c in ("name", "params", "returns", "near")))
    both = met.join(left, "before").join(right, "after")
    signature = (F.when(F.col("x_params") == F.col("y_params"), 0.5).otherwise(0.0) + F.when(F.col("x_returns") == F.col("y_returns"), 0.5).otherwise(0.0)).alias("signature")
    either = F.size(F.array_union("x_near", "y_near"))
    near = F.when(either > 0, F.size(F.array_intersect("x_near", "y_near")) / either).otherwise(F.when(F.col("signature") == 1, 1.0).otherwise(0.0))
    both = both.select("before", "after", "x_name", "y_name", "x_near", "y_near", signature)
    score = F.lit(WEIGHTS[0]) * F.col("signature") + F.lit(WEIGHTS[1]) * name_similarity(F.col("x_name"), F.col("y_name")) + F.lit(WEIGHTS[2]) * near
    return both.select("before", "after", score.alias("score")).where(F.col("score") >= threshold)


def greedy_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs that a walk by score, then ids, takes: in rounds, those that are the best of both their ends, materialised."""
    rest, parts = materialise(pairs), []
    while not rest.isEmpty():
        order = lambda other: F.struct(-F.col("score"), F.col(other))
        best = rest.groupBy("before").agg(F.min_by(F.struct("after", "score"), order("after")).alias("b")).select("before", "b.after", "b.score")
        back = rest.groupBy("after").agg(F.min_by("before", order("before")).alias("before"))
        taken = materialise(best.join(back, ["before", "after"]).select("before", "after", "score"))
        parts.append(taken)
        rest = materialise(rest.join(taken.select("before"), "before", "left_anti").join(taken.select("after"), "after", "left_anti").select("before", "after", "score"))
    out = parts[0] if parts else rest
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def match_fuzzy(before: DataFrame, after: DataFrame, arcs_before: DataFrame, arcs_after: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """The best remaining pairs of functions of a container, greedily: best score first, then by ids.

    Pairs that share nothing of their names score only where parameters and returns are
    equal and neither calls anything, and then all alike: such are paired by the order of
    their ids, after what scores as much or more and before what scores less.
    """
    b, a = _changed(before, arcs_before), _changed(after, arcs_after)
    alike = WEIGHTS[0] * 1.0 + WEIGHTS[1] * 0.0 + WEIGHTS[2] * 1.0
    pairs = materialise(scored_pairs(b, a, threshold))
    first = greedy_pairs(pairs.where(F.col("score") >= alike))
    left = lambda side, key, found: side.join(found.select(F.col(key).alias("id")), "id", "left_anti")
    if alike >= threshold:
        group = ["scope", "params", "returns"]
        numbered = lambda side, key: left(side, key, first).where(F.size("near") == 0).withColumn("i", F.row_number().over(Window.partitionBy(*group).orderBy("id"))).select(*group, "i", F.col("id").alias(key))
        same = numbered(b, "before").join(numbered(a, "after"), [*group, "i"]).select("before", "after", F.lit(alike).alias("score"))
        first = materialise(first.unionByName(same))
    rest = pairs.where(F.col("score") < alike).join(first.select("before"), "before", "left_anti").join(first.select("after"), "after", "left_anti")
    return first.unionByName(greedy_pairs(rest.select("before", "after", "score"))).select("before", "after", F.lit("fuzzy").alias("tier"), F.round("score", 6).alias("confidence"))


def call_names(graph: Graph) -> DataFrame:
    """(from_id, name): the names a function's edges lead to."""
    return graph.edges.select("from_id", "to_id").join(graph.nodes.select(F.col("id").alias("to_id"), "name"), "to_id").select("from_id", "name")


def match_certain(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before, after, tier, confidence) of nodes: exact, body and signature matches, each of what is left, materialised."""
    out = materialise(match_exact(before, after))
    for tier in (match_body, match_signature):
        b, a = materialise(_left(before, out, "before")), materialise(_left(after, out, "after"))
        out = materialise(out.unionByName(tier(b, a)))
    return out


def match_nodes(before: Graph, after: Graph, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """(before, after, tier, confidence): certain matches, then fuzzy ones of what is left."""
    out = match_certain(before.nodes, after.nodes)
    b, a = materialise(_left(before.nodes, out, "before")), materialise(_left(after.nodes, out, "after"))
    return out.unionByName(match_fuzzy(b, a, call_names(before), call_names(after), threshold))


def changed_attributes(kind: Column, b: str, a: str, available: set[str]) -> Column:
    """The compared attributes of structs ``b`` and ``a`` that differ, sorted."""
    out = None
    for name, fields in COMPARED.items():
        fields = sorted(f for f in fields if f in available)
        differ = F.array_compact(F.array(*(F.when(~F.to_json(F.struct(F.col(f"{b}.{f}").alias("x"))).eqNullSafe(F.to_json(F.struct(F.col(f"{a}.{f}").alias("x")))), F.lit(f)) for f in fields)))
        out = F.when(kind == name, differ) if out is None else out.when(kind == name, differ)
    return out


def status_of(changes: Column, b: str, a: str) -> Column:
    moved = ~F.col(f"{b}.file").eqNullSafe(F.col(f"{a}.file")) | ~F.col(f"{b}.scope").eqNullSafe(F.col(f"{a}.scope"))
    return F.when(F.size(changes) == 0, "unchanged").when(moved, "moved").when(F.col(f"{b}.name") != F.col(f"{a}.name"), "renamed").otherwise("modified")


def diff_nodes(before: DataFrame, after: DataFrame, matches: DataFrame) -> DataFrame:
    """(status, id, kind, before, after, tier, confidence, changes): a row per matched, added or removed node."""
    b = before.select(F.col("id").alias("b_id"), F.struct(*before.columns).alias("b"))
    a = after.select(F.col("id").alias("a_id"), F.struct(*after.columns).alias("a"))
    both = matches.join(b, matches["before"] == b["b_id"]).join(a, matches["after"] == a["a_id"]).drop("before", "after", "b_id", "a_id")
    changes = F.when(F.col("b.kind") != F.col("a.kind"), F.array(F.lit("kind"))).otherwise(changed_attributes(F.col("a.kind"), "b", "a", set(before.columns) & set(after.columns)))
    both = both.withColumn("changes", changes).withColumn("status", status_of(F.col("changes"), "b", "a"))
    none = F.array().cast("array<string>")
    gone = _left(before, matches, "before").select(F.struct(*before.columns).alias("b")).withColumns({"status": F.lit("removed"), "changes": none})
    new = _left(after, matches, "after").select(F.struct(*after.columns).alias("a")).withColumns({"status": F.lit("added"), "changes": none})
    every = both.unionByName(gone, allowMissingColumns=True).unionByName(new, allowMissingColumns=True)
    return every.select("status", F.coalesce(F.col("a.id"), F.col("b.id")).alias("id"), F.coalesce(F.col("a.kind"), F.col("b.kind")).alias("kind"), F.col("b").alias("before"), F.col("a").alias("after"), "tier", "confidence", "changes")


def diff_edges(before: DataFrame, after: DataFrame, matches: DataFrame) -> DataFrame:
    """(status, key, from_id, to_id, kind, subkind, before, after, changes), keyed by ids of the earlier graph."""
    back = matches.select("after", "before")
    project = lambda df, end: df.join(back.select(F.col("after").alias(end), F.col("before").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    later = project(project(after, "from_id"), "to_id")
    key = F.concat_ws("|", "kind", F.coalesce("subkind", F.lit("")), "from_id", "to_id")
    fields = [c for c in EDGE_COMPARED if c in before.columns]
    one = before.select(key.alias("key"), F.struct("from_id", "to_id", "kind", "subkind", *fields).alias("b"))
    two = later.select(key.alias("key"), F.struct("from_id", "to_id", "kind", "subkind", *fields).alias("a"))
    both = one.join(two, "key", "full_outer")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in fields)))
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.size(differ) == 0, "unchanged").otherwise("modified")
    end = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c)
    matched = F.col("b").isNotNull() & F.col("a").isNotNull()
    return both.select(status.alias("status"), "key", end("from_id"), end("to_id"), end("kind"), end("subkind"), F.col("b").alias("before"), F.col("a").alias("after"), F.when(matched, differ).otherwise(F.array().cast("array<string>")).alias("changes"))


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count("*").alias("count"))


def storage_layout(variables: DataFrame, order: str = "k") -> DataFrame:
    """(scope, layout): names of a contract's stored variables in declaration order."""
    stored = variables
    for c in ("is_constant", "is_immutable", "is_transient"):
        if c in variables.columns:
            stored = stored.where(~F.coalesce(c, F.lit(False)))
    rows = stored.where("scope is not null").groupBy("scope").agg(F.sort_array(F.collect_list(F.struct(order, "name"))).alias("v"))
    return rows.select("scope", F.array_join(F.transform("v", lambda x: x["name"]), ",").alias("layout"))


def _qualified(node: str) -> Column:
    scope = F.substring_index(F.col(f"{node}.scope"), ":", -1)
    return F.when(F.col(f"{node}.scope").isNull(), F.col(f"{node}.name")).otherwise(F.concat(scope, F.lit("."), F.col(f"{node}.name")))


def _rank(c: Column) -> Column:
    out = F.lit(0)
    for name, r in ACCESS_RANK.items():
        out = F.when(c == name, r).otherwise(out)
    return out


def findings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, severity, node, message, evidence) of diff rows of nodes and edges, most severe first.

    A finding on a node that is itself unchanged is a consequence, others are direct.
    """
    both = nodes.where("before is not null and after is not null")
    evidence = F.when(F.col("status") == "unchanged", "consequence").otherwise("direct")
    functions = both.where("before.kind = 'Function' and after.kind = 'Function'")
    q = _qualified("after")
    row = lambda df, kind, message, ev=evidence: df.select(F.lit(kind).alias("kind"), F.lit(SEVERITY[kind]).alias("severity"), F.col("id").alias("node"), message.alias("message"), (ev if isinstance(ev, Column) else F.lit(ev)).alias("evidence"))
    parts = []
    added = nodes.where("status = 'added' and kind = 'Function'")
    fresh = added.where("array_contains(after.entrypoints, after.id)")
    open_ = F.when(F.col("after.access_control.confidence") == "none", ", without recognised access control").otherwise("")
    parts.append(row(fresh, "new-external-entrypoint", F.concat(F.lit("New "), F.col("after.visibility"), F.lit(" entrypoint "), q, open_), "direct"))
    for flag in DANGEROUS:
        parts.append(row(added.where(F.col(f"after.flags.{flag}")), "new-dangerous-op", F.concat(F.lit("New function "), q, F.lit(f" uses {flag}")), "direct"))
        turned = ~F.coalesce(F.col(f"before.flags.{flag}"), F.lit(False)) & F.coalesce(F.col(f"after.flags.{flag}"), F.lit(False))
        parts.append(row(functions.where(turned), "new-dangerous-op", F.concat(q, F.lit(f" now uses {flag}"))))
    parts.append(row(functions.where("before.state_mutability <> 'payable' and after.state_mutability = 'payable'"), "became-payable", F.concat(q, F.lit(" became payable"))))
    b, a = F.col("before.access_control.confidence"), F.col("after.access_control.confidence")
    weaker = functions.where(F.col("after.state_mutability").isin("nonpayable", "payable") & (_rank(a) < _rank(b)))
    lost = F.array_except("before.access_control.modifiers", "after.access_control.modifiers")
    tail = F.when(F.size(lost) == 0, "").otherwise(F.concat(F.lit(" (lost "), F.array_join(lost, ", "), F.lit(")")))
    parts.append(row(weaker, "access-control-weakened", F.concat(q, F.lit(" changes state and its access control went from "), b, F.lit(" to "), a, tail)))
    parts.append(row(functions.where("not before.externally_reachable and after.externally_reachable"), "became-externally-reachable", F.concat(q, F.lit(" can now be reached from outside"))))
    outward = lambda side: edges.where((F.col(f"{side}.kind") == "calls") & F.col(f"{side}.subkind").isin(*EXTERNAL_SUBKINDS)).select(F.col("from_id").alias("b_id")).distinct()
    newly = outward("after").join(outward("before"), "b_id", "left_anti")
    parts.append(row(functions.withColumn("b_id", F.col("before.id")).join(newly, "b_id", "left_semi"), "new-external-call", F.concat(q, F.lit(" now calls out of its contract"))))
    layout = lambda side: storage_layout(nodes.where(f"{side}.kind = 'StateVariable'").select(F.col(f"{side}.scope").alias("scope"), F.col(f"{side}.name").alias("name"), F.col(f"{side}.src.offset").alias("k"), *(F.col(f"{side}.{c}").alias(c) for c in ("is_constant", "is_immutable", "is_transient"))))
    c = both.where("kind = 'Contract'").withColumns({"s_b": F.col("before.id"), "s_a": F.col("after.id")})
    c = c.join(layout("before").select(F.col("scope").alias("s_b"), F.col("layout").alias("l_b")), "s_b", "left").join(layout("after").select(F.col("scope").alias("s_a"), F.col("layout").alias("l_a")), "s_a", "left").na.fill("", ["l_b", "l_a"])
    parts.append(row(c.where("l_b <> l_a"), "storage-layout-changed", F.concat(F.lit("Storage layout of "), F.col("after.name"), F.lit(" changed from ["), "l_b", F.lit("] to ["), "l_a", F.lit("]")), "direct"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = F.coalesce(*(F.when(F.col("severity") == s, i) for i, s in enumerate(SEVERITIES)))
    return out.orderBy(order, "kind", "node", "message")


def diff_graphs(before: Graph, after: Graph, threshold: float = FUZZY_THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, findings) of two analysed graphs."""
    matches = materialise(match_nodes(before, after, threshold))
    nodes, edges = materialise(diff_nodes(before.nodes, after.nodes, matches)), materialise(diff_edges(before.edges, after.edges, matches))
    return nodes, edges, findings(nodes, edges)


def told(nodes: DataFrame) -> DataFrame:
    """The changed nodes in the order in which they are told: by status, then id."""
    return nodes.where("status <> 'unchanged'").orderBy(rank_of("status", STATUSES), "id")
