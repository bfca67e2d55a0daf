"""The catalogue: queries over the derived graph and the text tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.globs import glob_to_regex
from ..functions.text import name_similarity, normalise_path
from ..operators import analysis, audit, closure, diff, inherit, inspect, reach, search, views
from ..operators.collapse import collapse, resolution_score, select_mode
from ..operators.export import dot_edges, dot_nodes, mermaid_edges
from ..operators.resolve import Resolver
from ..schema import EXTERNAL_SUBKINDS, MUTABILITIES, RESOLUTIONS, Graph, rank_of
from ..sources import ingest
from . import graphs
from .stargraph import GUARDS, Star
from .storage import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORIGIN, TARGET, CALLEE = "f:42", "v:14", "f:133"


def query(f: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
    QUERIES[f.__name__] = lambda spark, path: f(Star(spark, path))
    return f


def _access(g: Star) -> DataFrame:
    """(id, guards, access) of all functions."""
    return analysis.access_control(g.functions(), graphs.applied(g), GUARDS)


def _stored(graph: Graph) -> Graph:
    return Graph(materialise(graph.nodes), materialise(graph.edges))


def _guarded_functions(g: Star) -> DataFrame:
    return g.functions().join(_access(g), "id")


def _entries(g: Star) -> DataFrame:
    return analysis.entrypoints(g.functions(), graphs.scopes(g))


@query
def flagship_surface(g: Star) -> DataFrame:
    """Every function callable from outside, with its contract, guard and whether it is an entrypoint."""
    entry = _entries(g).select("id", F.lit(True).alias("is_entry"))
    contracts = g.contracts().select(F.col("id").alias("scope"), F.col("name").alias("contract"), "file", "is_test", "is_mock")
    out = inspect.externals(_guarded_functions(g)).join(contracts, "scope").join(entry, "id", "left")
    return out.select("id", "name", "contract", "file", "visibility", "state_mutability", "mutates_state", "access", F.array_join("guards", ",").alias("guards"), F.coalesce("is_entry", F.lit(False)).alias("is_entry"), (F.col("is_test") | F.col("is_mock")).alias("scaffolding"))


@query
def edge_collapse(g: Star) -> DataFrame:
    every = g.edges(g.calls().drop("callee"), g.accesses(), g.emits())
    return every.select("id", "from_id", "to_id", "kind", "subkind", "count", "resolution")


@query
def edge_sites(g: Star) -> DataFrame:
    """The full collapse: an edge's sites, here as their least and greatest offset and number."""
    drafts = g.calls().drop("callee").withColumns({"site": F.struct("offset"), "reason": F.col("resolution"), "linearization_index": F.lit(None).cast("int"), "targets": F.array("to_id"), "cross_trust_boundary": F.col("subkind") == "external"})
    at = F.transform("sites", lambda s: s["offset"])
    return collapse(drafts).select("id", "count", "resolution", F.array_min(at).alias("lo"), F.array_max(at).alias("hi"), F.size("sites").cast("long").alias("n_sites"), "cross_trust_boundary")


@query
def resolution_scores(g: Star) -> DataFrame:
    every = g.edges(g.calls().drop("callee"), g.accesses(), g.emits())
    return resolution_score(every).select("scope", *RESOLUTIONS, "total", F.round("confident", 6).alias("confident"))


@query
def mode_select(g: Star) -> DataFrame:
    mode, _ = select_mode(resolution_score(g.call_edges()))
    return g.spark.createDataFrame([(mode,)], "mode string")


@query
def graph_stats_nodes(g: Star) -> DataFrame:
    kinds = [("SourceUnit", g.files()), ("Contract", g.contracts()), ("Function", g.functions()), ("StateVariable", g.variables()), ("Event", g.events())]
    out = None
    for kind, df in kinds:
        one = df.agg(F.count("*").alias("count")).select(F.lit(kind).alias("kind"), "count")
        out = one if out is None else out.unionByName(one)
    lost = g.calls().where("resolution = 'unresolved'").select("to_id").distinct().agg(F.count("*").alias("count")).select(F.lit("Unresolved").alias("kind"), "count")
    return out.unionByName(lost)


@query
def graph_stats_edges(g: Star) -> DataFrame:
    return inspect.tally(g.edges(g.calls().drop("callee"), g.accesses(), g.emits()), "kind", "resolution")


@query
def contract_stats(g: Star) -> DataFrame:
    c = g.contracts()
    return c.groupBy("contract_kind").agg(F.count("*").alias("total"), F.count_if("is_test").alias("test"), F.count_if("is_mock").alias("mock"), F.count_if(~F.col("is_test") & ~F.col("is_mock")).alias("real"))


@query
def symbol_stats(g: Star) -> DataFrame:
    return g.functions().groupBy("subkind", "visibility", "state_mutability").agg(F.count("*").alias("count"), F.count_if("has_body").alias("with_body"), F.count_if("checks_sender").alias("checks_sender"))


@query
def graph_stats_full(g: Star) -> DataFrame:
    """Every counter of the whole graph object, analysed."""
    whole = g.graph()
    up = graphs.contracts(g).select("id", F.col("linearized_bases").alias("_up"))
    nodes = whole.nodes.join(up, "id", "left").withColumn("linearized_bases", F.col("_up")).drop("_up")
    return inspect.graph_stats(_stored(analysis.analyse(_stored(Graph(nodes, whole.edges)), GUARDS, pairs=False)))


@query
def externals(g: Star) -> DataFrame:
    return inspect.externals(_guarded_functions(g)).select("id", "name", "scope", "visibility", "state_mutability", "mutates_state", "access")


@query
def externals_unprotected(g: Star) -> DataFrame:
    return inspect.externals(_guarded_functions(g), unprotected=True).select("id", "name", "scope", "visibility", "state_mutability")


@query
def externals_payable(g: Star) -> DataFrame:
    return inspect.externals(_guarded_functions(g), payable=True).select("id", "name", "scope", "access")


@query
def unresolved_edges(g: Star) -> DataFrame:
    edges = g.call_edges().withColumn("reason", F.lit(None).cast("string"))
    return inspect.unresolved_edges(edges, graphs.lost_nodes(g)).select("from_id", "to_id", "category", "callee", "count")


@query
def unresolved_by_category(g: Star) -> DataFrame:
    return inspect.unresolved_categories(graphs.lost_nodes(g))


def _accessors(g: Star, kind: str) -> DataFrame:
    return inspect.accessors(g.edges(g.accesses()), g.functions(), TARGET, kind)


@query
def writers_of(g: Star) -> DataFrame:
    return _accessors(g, "writes").select("function", "count", "visibility")


@query
def readers_of(g: Star) -> DataFrame:
    return _accessors(g, "reads").select("function", "count", "visibility")


@query
def writer_counts(g: Star) -> DataFrame:
    """Of every variable, the distinct functions that write and read it."""
    e = g.edges(g.accesses())
    return e.groupBy("to_id").agg(F.count_if(F.col("kind") == "writes").alias("writers"), F.count_if(F.col("kind") == "reads").alias("readers"), F.sum("count").alias("sites"))


@query
def callers_of_d1(g: Star) -> DataFrame:
    return closure.traverse(closure.call_index(g.call_edges()), CALLEE, "callers", 1).select("id", "depth")


@query
def callees_of_d2(g: Star) -> DataFrame:
    return closure.traverse(closure.call_index(g.call_edges()), ORIGIN, "callees", 2).select("id", "depth")


@query
def reachable_from(g: Star) -> DataFrame:
    edges = g.call_edges().where("kind = 'calls' and resolution <> 'unresolved'")
    origin = g.spark.createDataFrame([(ORIGIN,)], "id string")
    return closure.reached(origin, closure.call_index(edges)).where(F.col("id") != ORIGIN)


@query
def shortest_path_depth(g: Star) -> DataFrame:
    """The number of hops from one function to all within four."""
    return closure.traverse(closure.call_index(g.call_edges()), ORIGIN, "callees", 4).select("id", F.size("via").alias("hops"))


def _arcs(g: Star) -> DataFrame:
    return graphs.arcs(g)


@query
def entrypoints(g: Star) -> DataFrame:
    return _entries(g).select("id", "scope")


@query
def externally_reachable(g: Star) -> DataFrame:
    return analysis.externally_reachable(_entries(g), _arcs(g)).select("id")


@query
def entrypoint_reachability(g: Star) -> DataFrame:
    """How many functions each entrypoint reaches, itself included."""
    return reach.Counts(_entries(g), _arcs(g)).reached()


@query
def backward_closure_writes(g: Star) -> DataFrame:
    seeds = g.accesses().where("kind = 'writes'").select(F.col("from_id").alias("id")).distinct()
    return closure.close_over_callers(g.call_edges(), seeds)


@query
def call_classes(g: Star) -> DataFrame:
    return analysis.classify_calls(g.call_edges()).select("id", "class")


def _timed(g: Star) -> DataFrame:
    drafts = g.calls().drop("callee").unionByName(g.accesses())
    return drafts.groupBy("from_id", "to_id", "kind", "subkind").agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


@query
def reentrancy_shape(g: Star) -> DataFrame:
    return analysis.call_then_write(_timed(g), transitive=False)


@query
def reentrancy_transitive(g: Star) -> DataFrame:
    return analysis.call_then_write(materialise(_timed(g)))


@query
def access_control(g: Star) -> DataFrame:
    return _access(g).select("id", "access", F.array_join("guards", ",").alias("guards"))


@query
def derived_from(g: Star) -> DataFrame:
    """Of every contract, how many derive from it, at any distance."""
    return inherit.derived_from(graphs.linear(g)).groupBy("id").agg(F.count_distinct("derived").alias("derived"))


@query
def c3_depth(g: Star) -> DataFrame:
    return inherit.ancestors(g.inherits()).groupBy("id").agg(F.count_distinct("base").alias("ancestors"))


@query
def c3_linearization(g: Star) -> DataFrame:
    return inherit.linearise(g.contracts().select("id"), g.inherits()).select("id", F.array_join("linearized", ",").alias("linearized"), "certainty")


@query
def member_shadowing(g: Star) -> DataFrame:
    """The function that a contract's member name means: its own, else that of the nearest base by number."""
    found = inherit.inherited_members(graphs.linear(g), graphs.first_members(g))
    return found.select(F.col("contract").alias("id"), "name", F.col("id").alias("member"))


@query
def override_pairs(g: Star) -> DataFrame:
    """Members with the kind and name of one in an ancestor: an override of a body, else an implementation."""
    return inherit.overrides(graphs.linear(g), graphs.members(g))


@query
def protocol_rollup(g: Star) -> DataFrame:
    held = views.containers(graphs.nodes(g)).select("id", "container")
    return views.rollup(g.call_edges().where("resolution <> 'unresolved'"), held).select("from_id", "to_id", "count", "resolution")


@query
def cluster_members(g: Star) -> DataFrame:
    nodes = g.contracts().select("id", "file").unionByName(g.functions().join(g.contracts().select(F.col("id").alias("scope"), "file"), "scope").select("id", "file"))
    return views.clusters(nodes).select("path", "parent", "label", "depth", "members")


@query
def cluster_edges(g: Star) -> DataFrame:
    """Inheritance between the directories of contracts, all closed."""
    nodes = g.contracts().select("id", "file")
    edges = g.inherits().select(F.concat_ws("|", "from_id", "to_id").alias("id"), F.lit("inherits").alias("kind"), "from_id", "to_id", F.lit(1).cast("long").alias("count"), F.lit("heuristic").alias("resolution"))
    return views.lift_edges(edges, views.representatives(nodes, set())).select("from_id", "to_id", "count", "pairs", "type")


@query
def call_view_nodes(g: Star) -> DataFrame:
    return views.call_view(graphs.graph(g), ORIGIN).nodes.select("id")


@query
def state_access_view(g: Star) -> DataFrame:
    """Reads and writes between members of contracts that are neither tests nor mocks."""
    return views.state_access_view(graphs.graph(g)).edges.select("from_id", "to_id", "kind", "count")


@query
def inheritance_view(g: Star) -> DataFrame:
    """Base contracts, and members that override or implement others, of contracts that are neither tests nor mocks."""
    return views.inheritance_view(graphs.graph(g)).edges.select("from_id", "to_id", "kind")


@query
def contract_view(g: Star) -> DataFrame:
    """One contract, its bases and all their members."""
    return views.contract_view(graphs.graph(g), "c:9").nodes.select("id")


@query
def induced_edges(g: Star) -> DataFrame:
    """Calls between functions that are callable from outside."""
    keep = inspect.externals(_guarded_functions(g)).select("id")
    return views.induced(g.call_edges(), keep).select("id", "count")


@query
def call_endpoints(g: Star) -> DataFrame:
    return views.call_endpoints(g.call_edges())


@query
def faded_functions(g: Star) -> DataFrame:
    return views.faded(g.functions().withColumn("kind", F.lit("Function")), ("external",), payable=True)


@query
def search_palette(g: Star) -> DataFrame:
    """The best hits for a word, fuzzy ones aside."""
    nodes = g.functions().select("id", "name", F.lit("Function").alias("kind")).unionByName(g.variables().select("id", "name", F.lit("StateVariable").alias("kind"))).unionByName(g.contracts().select("id", "name", F.lit("Contract").alias("kind")))
    hits, _ = search.search(nodes, "supplier#00000000", 50)
    return hits.where("match <> 'fuzzy'")


@query
def search_fuzzy(g: Star) -> DataFrame:
    nodes = g.contracts().select(F.concat(F.col("file"), F.lit(":"), "name").alias("id"), "name", F.lit("Contract").alias("kind"))
    hits, _ = search.search(nodes, "spl", 50)
    return hits


@query
def node_ref_resolve(g: Star) -> DataFrame:
    ids = g.functions().join(g.contracts().select(F.col("id").alias("scope"), F.col("name").alias("c"), "file"), "scope")
    nodes = ids.select(F.concat("file", F.lit(":"), "c", F.lit("."), F.regexp_replace("name", " ", "_"), F.lit("("), "state_mutability", F.lit(")")).alias("id"), F.lit("Function").alias("kind")).distinct()
    name = g.functions().where("k = 42").select(F.regexp_replace("name", " ", "_")).first()[0]
    return search.resolve_ref(nodes, name).select(F.col("form").cast("long").alias("form"), "id")


@query
def name_similarities(g: Star) -> DataFrame:
    """Pairs of different part names with a similarity of 0.4 or more; the names are a fixed small set."""
    names = g.table("part").select("p_name").distinct()
    first = F.substring_index("p_name", " ", 1)
    a, b = names.select(F.col("p_name").alias("a"), first.alias("w")), names.select(F.col("p_name").alias("b"), first.alias("w"))
    return a.join(b, "w").where("a < b").select("a", "b", F.round(name_similarity(F.col("a"), F.col("b")), 6).alias("similarity")).where("similarity >= 0.4")


def _spans(g: Star) -> DataFrame:
    place = g.contracts().select(F.col("id").alias("scope"), "file")
    return g.functions().join(place, "scope").select("id", "file", (F.col("k") * 100).alias("offset"), F.lit(80).cast("long").alias("length"))


def _findings(g: Star) -> DataFrame:
    """Distinct (file, offset, length) of scanner findings."""
    lines = g.table("lineitem").where("l_orderkey % 50 = 0").select("l_partkey", "l_linenumber")
    at = _spans(g).select(F.regexp_extract("id", r"(\d+)$", 1).cast("long").alias("l_partkey"), "file")
    return lines.join(at, "l_partkey").select("file", (F.col("l_partkey") * 100 + F.col("l_linenumber") * 12).cast("long").alias("offset"), F.lit(5).cast("long").alias("length")).distinct()


@query
def containment_join(g: Star) -> DataFrame:
    spans = _findings(g).withColumn("key", F.concat_ws("@", "file", "offset"))
    return audit.containing(spans, _spans(g)).select("file", "offset", "node")


@query
def node_at_offset(g: Star) -> DataFrame:
    nodes = _spans(g).select("id", F.lit("Function").alias("kind"), F.struct("file", "offset", "length").alias("src"))
    return inspect.node_at(nodes, _findings(g).select("file", F.col("offset").alias("at"))).select("file", "at", "id")


@query
def path_normalise(g: Star) -> DataFrame:
    raw = F.concat(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), F.lit("/./x/../y//z"))
    return g.table("pages").select("page_id", normalise_path(raw).alias("path"))


@query
def lookup_fallback(g: Star) -> DataFrame:
    """Parts of a name in the caller's contract, else all of that name in its first base's, never both."""
    want = g.calls().where("kind = 'calls' and resolution = 'unresolved'").select("from_id", F.regexp_extract("to_id", ":(.*)$", 1).alias("name")).distinct()
    f = g.functions().select(F.col("id").alias("target"), "scope", F.col("p_name").alias("name"))
    at = want.join(g.functions().select(F.col("id").alias("from_id"), "scope"), "from_id")
    local = at.join(f, ["scope", "name"]).select("from_id", "name", "target", F.lit("local").alias("via"))
    first = g.inherits().where("idx = 0").select(F.col("from_id").alias("scope"), "to_id")
    rest = at.join(local.select("from_id", "name"), ["from_id", "name"], "left_anti").join(first, "scope").select("from_id", "name", F.col("to_id").alias("scope"))
    return local.unionByName(rest.join(f, ["scope", "name"]).select("from_id", "name", "target", F.lit("base").alias("via")))


@query
def shadow_anti_join(g: Star) -> DataFrame:
    """Reads whose variable is not hidden by a part of the same number as a local."""
    e = g.edges(g.accesses()).where("kind = 'reads'").select("from_id", "to_id")
    local = g.calls().select("from_id", F.regexp_replace("to_id", "^f:", "v:").alias("to_id")).distinct()
    return e.join(local, ["from_id", "to_id"], "left_anti")


@query
def diff_nodes(g: Star) -> DataFrame:
    d = diff.diff_nodes(graphs.revision(g, False).drop("k"), graphs.revision(g, True).drop("k"), graphs.matches(g))
    return d.select("status", "id", F.array_join("changes", ",").alias("changes"))


@query
def diff_summary(g: Star) -> DataFrame:
    return diff.summary(diff.diff_nodes(graphs.revision(g, False).drop("k"), graphs.revision(g, True).drop("k"), graphs.matches(g)))


def _later_edges(g: Star) -> DataFrame:
    """Call edges of the later revision: every 29th caller's are gone, every 31st caller's doubled."""
    k = F.regexp_extract("from_id", r"(\d+)$", 1).cast("long")
    e = g.call_edges().where("kind = 'calls'").where(k % 29 != 0)
    return e.withColumn("count", F.when(k % 31 == 0, F.col("count") * 2).otherwise(F.col("count")))


@query
def diff_edges(g: Star) -> DataFrame:
    none = g.spark.createDataFrame([], "before string, after string")
    return diff.diff_edges(g.call_edges().where("kind = 'calls'"), _later_edges(g), none).select("status", "key", F.array_join("changes", ",").alias("changes"))


@query
def body_match(g: Star) -> DataFrame:
    """Tier 2 of the matcher on what an exact match leaves."""
    b, a = graphs.revision(g, False), graphs.revision(g, True)
    rest_b = b.join(a.select("id"), "id", "left_anti")
    rest_a = a.join(b.select("id"), "id", "left_anti")
    return diff.match_body(rest_b, rest_a).select("before", "after", "tier")


@query
def signature_match(g: Star) -> DataFrame:
    b, a = graphs.revision(g, False), graphs.revision(g, True)
    return diff.match_signature(b.join(a.select("id"), "id", "left_anti"), a.join(b.select("id"), "id", "left_anti")).select("before", "after", "tier")


@query
def fuzzy_match(g: Star) -> DataFrame:
    none = F.array().cast("array<struct<name:string,type:string,indexed:boolean,storageLocation:string>>")
    b, a = (graphs.revision(g, x).withColumns({"params": none, "returns": none}) for x in (False, True))
    names = g.calls().select("from_id", F.col("to_id").alias("name")).distinct()
    return diff.match_fuzzy(b.join(a.select("id"), "id", "left_anti"), a.join(b.select("id"), "id", "left_anti"), names, names)


def _reviews(g: Star) -> DataFrame:
    r = g.functions().where("k % 10 = 0").select(F.col("id").alias("node"), F.lit("reviewed").alias("status"), "body_hash")
    lost = g.table("supplier").where("s_suppkey % 7 = 0").select(F.concat(F.lit("gone:"), "s_suppkey").alias("node"), F.lit("flagged").alias("status"), F.lit("x").alias("body_hash"))
    return r.unionByName(lost)


@query
def review_staleness(g: Star) -> DataFrame:
    return audit.review_staleness(_reviews(g), graphs.revision(g, True)).select("node", "status", "state")


@query
def review_migration(g: Star) -> DataFrame:
    return audit.migrate_reviews(_reviews(g), graphs.matches(g).select("before", "after")).select("node", "status")


def _imported(g: Star) -> DataFrame:
    each = g.table("lineitem").where("l_orderkey % 50 = 0").select(F.concat(F.lit("find:"), "l_orderkey").alias("id"), F.concat(F.lit("f:"), "l_partkey").alias("nid")).distinct()
    known = g.functions().select(F.col("id").alias("nid"), "body_hash")
    return each.join(known, "nid").groupBy("id").agg(F.collect_list(F.struct(F.col("nid").alias("id"), "body_hash")).alias("nodes"))


@query
def findings_staleness(g: Star) -> DataFrame:
    return audit.findings_staleness(_imported(g), graphs.revision(g, True))


@query
def audit_projection(g: Star) -> DataFrame:
    f = _imported(g).withColumn("impact", F.when(F.substring("id", -1, 1) == "0", "High").otherwise("Low"))
    return audit.audit_projection(_reviews(g), f, g.functions()).select("node", "status", "review_state", F.size("findings").cast("long").alias("findings"))


@query
def storage_layout(g: Star) -> DataFrame:
    return diff.storage_layout(g.variables())


@query
def line_offsets(g: Star) -> DataFrame:
    """Byte offset of each line of each document, by prefix sums."""
    lines = g.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    before = F.coalesce(F.sum(F.octet_length("text") + 1).over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), before.cast("long").alias("offset"), F.octet_length("text").cast("long").alias("length"))


@query
def doc_metrics(g: Star) -> DataFrame:
    t = F.col("text")
    return g.table("documents").select("doc_id", F.octet_length(t).cast("long").alias("n_bytes"), F.length(t).cast("long").alias("chars"), F.size(F.split(t, "\n")).cast("long").alias("n_lines"))


@query
def glob_filter(g: Star) -> DataFrame:
    keep, drop = glob_to_regex("**/{en,fr}/*"), glob_to_regex("**/en/1*")
    path = F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)
    return g.table("pages").select("page_id", path.alias("path")).where(F.col("path").rlike(keep) & ~F.col("path").rlike(drop))


@query
def json_props(g: Star) -> DataFrame:
    """Events by type with the number and the length of their property documents."""
    return g.table("events").groupBy("event_type").agg(F.count("*").alias("count"), F.sum(F.length("props")).alias("chars"), F.count(F.get_json_object("props", "$")).alias("valid"))


@query
def dot_export(g: Star) -> DataFrame:
    nodes = g.contracts().select("id", "name", F.lit("Contract").alias("kind"))
    edges = g.inherits().select("from_id", "to_id", F.lit("inherits").alias("kind"), F.lit("heuristic").alias("resolution"), F.lit(1).alias("count"))
    return dot_nodes(nodes).unionByName(dot_edges(edges))


@query
def mermaid_export(g: Star) -> DataFrame:
    nodes = g.contracts().select("id", "name")
    edges = g.inherits().select("from_id", "to_id", F.lit("inherits").alias("kind"), F.lit(None).cast("string").alias("subkind"), F.lit("heuristic").alias("resolution"), F.lit(1).alias("count"))
    return mermaid_edges(nodes, edges)


@query
def file_lenses(g: Star) -> DataFrame:
    return inspect.file_lenses(g.functions(), g.edges(g.calls().drop("callee"), g.accesses()))


@query
def edge_widths(g: Star) -> DataFrame:
    return g.edges(g.emits()).select("id", F.round(views.edge_width(F.col("count")), 6).alias("width"))


@query
def weakest_resolution(g: Star) -> DataFrame:
    """Of every caller, the weakest confidence among its call sites."""
    rank = g.calls().groupBy("from_id").agg(F.max(rank_of("resolution", RESOLUTIONS)).cast("long").alias("rank"), F.count("*").alias("sites"))
    return rank


@query
def mutability_ranks(g: Star) -> DataFrame:
    return g.functions().groupBy(rank_of("state_mutability", MUTABILITIES).cast("long").alias("rank")).agg(F.count("*").alias("count"))


@query
def parse_sources(g: Star) -> DataFrame:
    """Functions that the parser finds in the graph written as source text."""
    found = ingest.symbols(ingest.parse_units(g.sources())).where("kind = 'Function'")
    return found.select("id", "visibility", "state_mutability", "has_body", F.col("metrics.cyclomatic").cast("long").alias("cyclomatic"))


@query
def body_walk(g: Star) -> DataFrame:
    """What bodies read and write, by name."""
    found = ingest.symbols(ingest.parse_units(g.sources())).where("kind = 'Function'")
    return found.select("id", F.explode("uses").alias("u")).select("id", F.col("u.name").alias("name"), F.col("u.write").alias("write"))


@query
def resolve_sources(g: Star) -> DataFrame:
    """Drafts of the source text by kind and confidence: parsed, bound and linearised."""
    drafts = Resolver(materialise(ingest.parse_units(g.sources()))).drafts()
    return drafts.groupBy("kind", "resolution").agg(F.count("*").alias("count"))


QUERIES |= graphs.QUERIES
