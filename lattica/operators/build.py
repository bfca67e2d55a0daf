"""Sources to an analysed graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.globs import matches_any
from ..plans.storage import materialise
from ..schema import EDGE, NODE, Graph, conform
from ..sources import ingest
from . import inherit
from .analysis import ACCESS_MODIFIERS, REENTRANCY_GUARDS, analyse
from .collapse import THRESHOLD, collapse, known_drafts, mark_trust_boundaries, placeholders, resolution_score, select_mode, structural, with_state_flags
from .resolve import TEST_BASES, Remappings, Resolver


@dataclass
class BuildOptions:
    remappings: list[str] = field(default_factory=list)
    roots: tuple[str, ...] = ("src", "contracts")
    entrypoints: list[str] = field(default_factory=list)
    access_modifiers: tuple[str, ...] = ACCESS_MODIFIERS
    reentrancy_guards: tuple[str, ...] = REENTRANCY_GUARDS
    external: list[str] = field(default_factory=list)
    threshold: float = THRESHOLD
    overlay: object | None = None


@dataclass
class Built:
    graph: Graph
    mode: str
    reason: str
    score: DataFrame
    diagnostics: DataFrame
    resolver: Resolver


def assemble_nodes(r: Resolver, drafts: DataFrame) -> DataFrame:
    """Source files, declarations and placeholders as nodes."""
    u = r.units
    place = lambda src: F.struct(F.col("file"), F.col(f"{src}.offset").alias("offset"), F.col(f"{src}.length").alias("length"), F.col(f"{src}.line").alias("line"), F.col(f"{src}.column").alias("column"))
    lost = r.imports.where("target is null").groupBy("file").agg(F.sort_array(F.collect_set("path")).alias("unresolved_imports"))
    start = F.struct(F.col("file"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length"), F.lit(1).alias("line"), F.lit(0).alias("column"))
    files = u.join(lost, "file", "left").select(F.col("file").alias("id"), F.lit("SourceUnit").alias("kind"), F.substring_index("file", "/", -1).alias("name"), "file", start.alias("src"), "pragma", "version_support", "recovered",
                                                F.coalesce("unresolved_imports", F.array().cast("array<string>")).alias("unresolved_imports"))
    s = r.symbols.drop("calls", "uses", "refs", "locals").withColumn("src", place("src"))
    linear = r.linear.select("id", F.col("linearized").alias("linearized_bases"), F.col("certainty").alias("linearization_certainty"))
    full = inherit.fully_implemented(r.contracts, r.linear, r.all.where("scope is not null"))
    is_test = F.arrays_overlap("base_names", F.array(*map(F.lit, TEST_BASES))) | F.col("file").rlike("(^|/)tests?/")
    is_mock = F.col("name").rlike("(?i)mock") | F.col("file").rlike("(^|/)mocks?/")
    s = s.join(linear, "id", "left").join(full, "id", "left")
    own = F.col("kind") == "Contract"
    s = s.withColumns({"is_test": F.when(own, is_test), "is_mock": F.when(own, is_mock)})
    return conform(files, NODE).unionByName(conform(s, NODE)).unionByName(conform(placeholders(drafts), NODE))


def build(sources: DataFrame, options: BuildOptions | None = None, cache: DataFrame | None = None) -> Built:
    """The graph of (file, content): parse, resolve, collapse, score, withhold if need be, analyse."""
    o = options or BuildOptions()
    parsed = materialise(ingest.parse_units(sources, cache))
    r = Resolver(parsed, Remappings.parse(o.remappings), o.roots)
    drafts = r.drafts()
    if o.overlay is not None:
        drafts = materialise(o.overlay.apply(drafts))
    nodes = assemble_nodes(r, drafts)
    if o.overlay is not None:
        nodes = o.overlay.annotate(nodes)
    nodes = materialise(nodes)
    edges = conform(collapse(known_drafts(drafts, nodes)), EDGE)
    edges = materialise(mark_trust_boundaries(edges, nodes, matches_any(F.col("file"), o.external) if o.external else None))
    nodes = with_state_flags(nodes, edges)
    bad = r.units.where("version_support <> 'supported'").select("file")
    score = resolution_score(edges, bad)
    mode, reason = select_mode(score, o.threshold)
    graph = Graph(materialise(nodes), edges)
    if mode == "structural":
        graph = structural(graph)
    graph = analyse(graph, o.access_modifiers, o.reentrancy_guards, o.entrypoints)
    return Built(Graph(materialise(graph.nodes), materialise(graph.edges)), mode, reason, score, ingest.diagnostics(parsed), r)
