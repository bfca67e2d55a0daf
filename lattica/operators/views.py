"""Views: selections of a graph, and their clustering by directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise
from ..schema import CALL_KINDS, RESOLUTIONS, Graph, ViewError, kind_is, named, rank_of
from .closure import call_index, traverse

RENDER_CAP = 1500
CALLS_UP, CALLS_DOWN = 2, 3
ROOT = "."


def containers(nodes: DataFrame) -> DataFrame:
    """(id, container, scaffold): the contract that stands for a node, and whether it is a test or a mock."""
    contracts = nodes.where("kind = 'Contract'").select(F.col("id").alias("container"), (F.col("is_test") | F.col("is_mock")).alias("scaffold"))
    own = nodes.select("id", F.when(F.col("kind") == "Contract", F.col("id")).otherwise(F.col("scope")).alias("container"))
    return own.join(contracts, "container").select("id", "container", "scaffold")


def induced(edges: DataFrame, keep: DataFrame, accept: Column | None = None) -> DataFrame:
    """Edges of which both ends are kept."""
    ids = keep.select("id").distinct()
    out = edges if accept is None else edges.where(accept)
    return out.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*edges.columns)


def rollup(edges: DataFrame, held: DataFrame) -> DataFrame:
    """Call edges lifted to pairs of different containers: summed counts, the weakest resolution.

    ``held`` has (id, container). kind and subkind are those of the contributing edge with the least id.
    """
    a = held.select(F.col("id").alias("from_id"), F.col("container").alias("a"))
    b = held.select(F.col("id").alias("to_id"), F.col("container").alias("b"))
    lifted = edges.where(kind_is(*CALL_KINDS)).join(a, "from_id").join(b, "to_id").where("a <> b")
    return lifted.groupBy("a", "b").agg(F.sum("count").alias("count"), F.max(rank_of("resolution", RESOLUTIONS)).alias("r"), F.min_by(F.struct("kind", "subkind"), "id").alias("k")).select(
        F.concat(F.lit("rollup:"), "a", F.lit("->"), "b").alias("id"), F.col("k.kind").alias("kind"), F.col("k.subkind").alias("subkind"), F.col("a").alias("from_id"), F.col("b").alias("to_id"),
        named(F.col("r"), RESOLUTIONS).alias("resolution"), "count",
    )


def protocol_view(graph: Graph, include_tests: bool = False) -> Graph:
    keep = graph.nodes.where("kind = 'Contract'")
    keep = keep if include_tests else keep.where("not (is_test or is_mock)")
    held = containers(graph.nodes).join(keep.select(F.col("id").alias("container")), "container", "left_semi")
    edges = induced(graph.edges, keep, F.col("kind") == "inherits")
    return Graph(keep, edges.unionByName(rollup(graph.edges, held), allowMissingColumns=True))


def contract_view(graph: Graph, focus: str) -> Graph:
    """A contract, or a member's contract: its members, bases and their members."""
    row = graph.nodes.where(F.col("id") == focus).select("kind", "scope").first()
    if row is None:
        raise ViewError(f'"{focus}" is not a node of this graph')
    own = focus if row["kind"] == "Contract" else row["scope"]
    node = graph.nodes.where((F.col("id") == own) & (F.col("kind") == "Contract"))
    if own is None or node.isEmpty():
        raise ViewError(f'"{focus}" is neither a contract nor in one; a contract view needs one')
    bases = node.select(F.explode(F.array_union(F.array("id"), F.coalesce("linearized_bases", F.array().cast("array<string>")))).alias("id"))
    direct = graph.edges.where((F.col("from_id") == own) & kind_is("declares", "inherits")).select(F.col("to_id").alias("id"))
    members = graph.nodes.join(bases.select(F.col("id").alias("scope")), "scope", "left_semi").select("id")
    keep = bases.unionByName(direct).unionByName(members).distinct()
    return Graph(graph.nodes.join(keep, "id", "left_semi"), induced(graph.edges, keep))


def call_view(graph: Graph, focus: str | None, up: int = CALLS_UP, down: int = CALLS_DOWN) -> Graph:
    if focus is None:
        raise ViewError("a call view needs a focus: the whole function graph is not readable")
    if graph.edges.where(kind_is(*CALL_KINDS)).isEmpty():
        raise ViewError("this graph has no call edges: there are no call sites, or they were withheld for low confidence")
    index = call_index(graph.edges, graph.nodes)
    own = graph.nodes.sparkSession.createDataFrame([(focus,)], "id string")
    keep = own.unionByName(traverse(index, focus, "callers", up).select("id")).unionByName(traverse(index, focus, "callees", down).select("id")).distinct()
    return Graph(graph.nodes.join(keep, "id", "left_semi"), induced(graph.edges, keep, kind_is(*CALL_KINDS)))


def state_access_view(graph: Graph, focus: str | None = None, include_tests: bool = False) -> Graph:
    held = containers(graph.nodes)
    a = held.select(F.col("id").alias("from_id"), F.col("container").alias("_a"), F.col("scaffold").alias("_sa"))
    b = held.select(F.col("id").alias("to_id"), F.col("container").alias("_b"), F.col("scaffold").alias("_sb"))
    edges = graph.edges.where(kind_is("reads", "writes")).join(a, "from_id", "left").join(b, "to_id", "left")
    if not include_tests:
        edges = edges.where(~F.coalesce("_sa", F.lit(False)) & ~F.coalesce("_sb", F.lit(False)))
    if focus is not None:
        edges = edges.where((F.col("_a") == focus) | (F.col("_b") == focus))
    edges = edges.select(*graph.edges.columns)
    keep = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return Graph(graph.nodes.join(keep, "id", "left_semi"), edges)


def inheritance_view(graph: Graph, include_tests: bool = False) -> Graph:
    """Contracts, their bases, and the members on either end of an override."""
    contracts = graph.nodes.where("kind = 'Contract'")
    contracts = contracts if include_tests else contracts.where("not (is_test or is_mock)")
    held = containers(graph.nodes).join(contracts.select(F.col("id").alias("container")), "container", "left_semi").select("id")
    members = induced(graph.edges, held, kind_is("overrides", "implements"))
    ends = members.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    keep = contracts.select("id").unionByName(ends).distinct()
    return Graph(graph.nodes.join(keep, "id", "left_semi"), induced(graph.edges, contracts, F.col("kind") == "inherits").unionByName(members))


def select_view(graph: Graph, view: str, focus: str | None = None, include_tests: bool = False, up: int = CALLS_UP, down: int = CALLS_DOWN) -> Graph:
    if view == "protocol":
        return protocol_view(graph, include_tests)
    if view == "inheritance":
        return inheritance_view(graph, include_tests)
    if view == "state-access":
        return state_access_view(graph, focus, include_tests)
    if view == "contract":
        if focus is None:
            raise ViewError("a contract view needs a focus contract")
        return contract_view(graph, focus)
    if view == "call":
        return call_view(graph, focus, up, down)
    raise ViewError(f'there is no view "{view}"')


# Directories


def dir_of(file: Column) -> Column:
    return F.when(F.instr(file, "/") > 1, F.regexp_replace(file, "/[^/]*$", "")).otherwise(ROOT)


def ancestors(directory: Column) -> Column:
    """The directory and all above it, as paths."""
    parts = F.split(directory, "/")
    return F.when(directory == ROOT, F.array(F.lit(ROOT))).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def label_of(directory: Column) -> Column:
    return F.when(directory == ROOT, "(project root)").otherwise(F.substring_index(directory, "/", -1))


def clusters(nodes: DataFrame) -> DataFrame:
    """(path, parent, label, depth, members): directories with the nodes at any depth below them."""
    each = nodes.select(F.explode(ancestors(dir_of(F.col("file")))).alias("path"))
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", ""))
    depth = F.when(F.col("path") == ROOT, 0).otherwise(F.size(F.split("path", "/")) - 1)
    return each.groupBy("path").agg(F.count("*").alias("members")).select("path", parent.alias("parent"), label_of(F.col("path")).alias("label"), depth.alias("depth"), "members")


def open_paths(expand: list[str], known: list[str]) -> set[str]:
    """The directories to draw open: those asked for and all above them."""
    out: set[str] = set()
    for raw in expand:
        path = raw.rstrip("/") or ROOT
        if path not in known:
            shown = ", ".join(sorted(known)[:12])
            raise ViewError(f'"{raw}" is not a directory of this view; there are {shown}')
        parts = path.split("/")
        out |= {"/".join(parts[: i + 1]) for i in range(len(parts))}
    return out


def representatives(nodes: DataFrame, opened: set[str]) -> DataFrame:
    """(id, rep): the node itself if its directory is open, else the nearest drawn directory above it."""
    path = dir_of(F.col("file"))
    chain = ancestors(path)
    shut = F.filter(chain, lambda p: ~p.isin(*opened)) if opened else chain
    return nodes.select("id", F.when(F.size(shut) == 0, F.col("id")).otherwise(F.concat(F.lit("dir:"), shut[0])).alias("rep"))


def lift_edges(edges: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, kind, from_id, to_id, count, pairs, resolution, type): edges between what is drawn.

    Edges between drawn nodes stay; others are summed by kind and ends; those within one box are its internal edges.
    """
    a = reps.select(F.col("id").alias("from_id"), F.col("rep").alias("a"))
    b = reps.select(F.col("id").alias("to_id"), F.col("rep").alias("b"))
    drawn = edges.join(a, "from_id").join(b, "to_id")
    kept = drawn.where("a = from_id and b = to_id").select("id", "kind", "from_id", "to_id", "count", F.lit(1).cast("long").alias("pairs"), "resolution", F.lit("edge").alias("type"))
    lifted = drawn.where("not (a = from_id and b = to_id)")
    rank = F.max(rank_of("resolution", RESOLUTIONS))
    summed = lifted.where("a <> b").groupBy("kind", "a", "b").agg(F.sum("count").alias("count"), F.count("*").alias("pairs"), rank.alias("r"))
    agg = summed.select(F.concat(F.lit("agg:"), "kind", F.lit(":"), "a", F.lit("->"), "b").alias("id"), "kind", F.col("a").alias("from_id"), F.col("b").alias("to_id"), "count", "pairs", named(F.col("r"), RESOLUTIONS).alias("resolution"), F.lit("aggregate").alias("type"))
    inside = lifted.where("a = b").groupBy("a").agg(F.sum("count").alias("count"), F.count("*").alias("pairs"), rank.alias("r"))
    own = inside.select(F.concat(F.lit("in:"), "a").alias("id"), F.lit(None).cast("string").alias("kind"), F.col("a").alias("from_id"), F.col("a").alias("to_id"), "count", "pairs", named(F.col("r"), RESOLUTIONS).alias("resolution"), F.lit("internal").alias("type"))
    return kept.unionByName(agg).unionByName(own)


def auto_expand(view: Graph, cap: int = RENDER_CAP) -> set[str]:
    """Directories opened breadth first while what is drawn stays within ``cap``; directory counts only reach the driver."""
    table = {r["path"]: r for r in clusters(view.nodes).collect()}
    own = {r["d"]: r["n"] for r in view.nodes.select(dir_of(F.col("file")).alias("d")).groupBy("d").agg(F.count("*").alias("n")).collect()}
    children: dict = {}
    for r in table.values():
        children.setdefault(r["parent"], []).append(r["path"])
    queue, opened = sorted(children.get(None, [])), set()
    drawn = len(queue)
    while queue:
        path = queue.pop(0)
        more = len(children.get(path, [])) + own.get(path, 0)
        if drawn + more > cap:
            continue
        drawn += more
        opened.add(path)
        queue += sorted(children.get(path, []))
    return opened


def aggregate(view: Graph, expand: list[str] | None = None, cap: int = RENDER_CAP) -> Graph:
    """The view with closed directories in place of what is in them; refuses more than ``cap`` elements."""
    known = [r["path"] for r in clusters(view.nodes).select("path").collect()]
    opened = open_paths(expand, known) if expand is not None else auto_expand(view, cap)
    reps = representatives(view.nodes, opened)
    edges = lift_edges(view.edges, reps)
    drawn = reps.select("rep").distinct().select(F.col("rep").alias("id"))
    if drawn.limit(cap + 1).count() > cap:
        raise ViewError(f"more than {cap} elements would be drawn; expand fewer directories, or focus on one")
    names = view.nodes.select("id", "name", "kind")
    return Graph(drawn.join(names, "id", "left"), edges)


def _within(nodes: DataFrame, edges: DataFrame, cap: int) -> None:
    """Raises if nodes and edges together are more than ``cap``; no more than that are counted."""
    if nodes.limit(cap + 1).count() + edges.limit(cap + 1).count() > cap:
        raise ViewError(f"more than {cap} elements would be drawn; expand fewer directories, or focus on one")


def nested(view: Graph, cap: int = RENDER_CAP) -> Graph:
    """The view with ``parent`` on its nodes: members lie in their contract, if that is drawn, and the ``declares`` edge that says so goes."""
    held = view.nodes.where("kind = 'Contract'").select(F.col("id").alias("parent"))
    nodes = view.nodes.join(held, F.col("scope") == F.col("parent"), "left")
    shown = nodes.where("parent is not null").select(F.col("parent").alias("from_id"), F.col("id").alias("to_id"), F.lit("declares").alias("kind"))
    edges = view.edges.join(shown, ["from_id", "to_id", "kind"], "left_anti").select(*view.edges.columns)
    _within(nodes, edges, cap)
    return Graph(nodes, edges)


def compound(view: Graph, expand: list[str], cap: int = RENDER_CAP) -> Graph:
    """The view by directories: nodes (id, type, parent, expanded, members, internal) and edges as lift_edges has them.

    A directory is a box if all above it are open, and holds its nodes and directories if
    it is open itself; a shut one stands for all below it, with the edges inside counted.
    """
    tree = materialise(clusters(view.nodes))
    opened = open_paths(expand, [r["path"] for r in tree.select("path").collect()])
    is_open = lambda c: c.isin(*opened) if opened else F.lit(False)
    dir_id = lambda c: F.concat(F.lit("dir:"), c)
    above = ancestors(F.col("path"))
    present = tree.where(F.forall(F.slice(above, F.lit(1), F.greatest(F.size(above) - 1, F.lit(0))), is_open))
    edges = materialise(lift_edges(view.edges, representatives(view.nodes, opened)))
    inside = edges.where("type = 'internal'").select(F.col("from_id").alias("id"), F.col("count").alias("internal"))
    boxes = present.select(dir_id(F.col("path")).alias("id"), F.lit("cluster").alias("type"), dir_id(F.col("parent")).alias("parent"), is_open(F.col("path")).alias("expanded"), "members")
    own = view.nodes.withColumn("path", dir_of(F.col("file"))).where(F.forall(ancestors(F.col("path")), is_open))
    drawn = boxes.unionByName(own.select("id", F.lit("node").alias("type"), dir_id(F.col("path")).alias("parent"), F.lit(False).alias("expanded"), F.lit(0).cast("long").alias("members")))
    nodes = drawn.join(inside, "id", "left").withColumn("internal", F.coalesce("internal", F.lit(0).cast("long")))
    edges = edges.where("type <> 'internal'")
    _within(nodes, edges, cap)
    return Graph(nodes, edges)


def call_endpoints(edges: DataFrame) -> DataFrame:
    """(id): nodes with a call edge on either end."""
    return edges.where(kind_is(*CALL_KINDS)).select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()


# Filters of what is drawn


def faded(nodes: DataFrame, visibilities: tuple[str, ...] = (), payable: bool = False) -> DataFrame:
    """(id): functions that match none of the traits chosen; other kinds always match."""
    if not visibilities and not payable:
        return nodes.where(F.lit(False)).select("id")
    hit = F.col("visibility").isin(*visibilities) if visibilities else F.lit(False)
    if payable:
        hit = hit | (F.col("state_mutability") == "payable")
    return nodes.where((F.col("kind") == "Function") & ~F.coalesce(hit, F.lit(False))).select("id")


def edge_width(count: Column) -> Column:
    return F.least(F.lit(6.0), 1 + F.log2(F.greatest(F.lit(1), count)))
