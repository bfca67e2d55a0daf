"""The commands as functions, and a small command line over them.

Exit codes: 0 nothing found, 1 something found, 2 an error.
"""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import audit, closure, diff, export, inspect, overlay, search, views
from .operators.build import BuildOptions, Built, build
from .plans.storage import materialise
from .schema import Graph, GraphError, ViewError
from .sources import incremental, ingest, project, store


def session(name: str = "lattica") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def options_of(p: project.Project, config: project.Config) -> BuildOptions:
    o = BuildOptions(remappings=p.remappings, roots=tuple(p.sources), entrypoints=config.entrypoints, external=config.trustBoundaries.get("external", []))
    if config.accessControlModifiers is not None:
        o.access_modifiers = tuple(config.accessControlModifiers)
    if config.reentrancyGuards is not None:
        o.reentrancy_guards = tuple(config.reentrancyGuards)
    return o


def build_project(spark: SparkSession, root: str, config_path: str | None = None, artifacts: bool = True) -> tuple[Built, list[str]]:
    """Builds and stores a project's graph; its parse cache saves what has not changed."""
    p, (config, notes) = project.detect_project(root), project.load_config(root, config_path)
    notes = [*p.diagnostics, *notes]
    files = project.list_sources(p, config.include, config.exclude)
    sources = ingest.read_sources(spark, root).join(spark.createDataFrame([(f,) for f in files], "file string"), "file", "left_semi")
    folder = project.managed_dir(root)
    parsed = materialise(incremental.update(sources, str(folder / "cache"))[0])
    o = options_of(p, config)
    if artifacts:
        o.overlay, more = overlay.load_overlay(spark, overlay.discover(root, p.out), sources, ingest.symbols(parsed))
        notes += more
    built = build(sources, o, parsed)
    store.write_graph(built.graph, str(folder / "graph"), {"mode": built.mode, "modeReason": built.reason, "settings": project.canonical_settings(config), "kind": p.kind, "files": len(files)})
    return built, notes


def load_project(spark: SparkSession, root: str, rebuild: bool = False, stale: bool = False) -> Graph:
    """The stored graph if it is fresh, else a new build."""
    p, (config, _) = project.detect_project(root), project.load_config(root)
    path = os.path.join(root, project.OUTPUT_DIR, "graph")
    if not rebuild and os.path.exists(path):
        stored = store.read_header(spark, path).get("settings", "")
        if project.is_fresh(os.path.join(path, "header"), project.newest_input(p, config.include, config.exclude), project.canonical_settings(config), stored, stale):
            return store.read_graph(spark, path)
    return build_project(spark, root)[0].graph


def query(spark: SparkSession, root: str, name: str, *args: str, depth: int | None = 1, **flags: bool) -> DataFrame:
    """One of the point queries by name."""
    g = load_project(spark, root, stale=flags.pop("stale", False))
    one = lambda i=0, kinds=None: search.require_node(g.nodes, args[i], kinds)
    functions = g.nodes.where("kind = 'Function'").withColumn("access", F.col("access_control.confidence"))
    if name in ("callers-of", "callees-of"):
        return closure.traverse(closure.call_index(g.edges, g.nodes), one(), name.split("-")[0], depth)
    if name == "reachable-from":
        return closure.reachable_from(closure.call_index(g.edges, g.nodes), one())
    if name == "path":
        hops = closure.call_path(closure.call_index(g.edges, g.nodes), one(0), one(1))
        return spark.createDataFrame(hops or [], "src string, dst string, edge_id string, virtual boolean")
    if name in ("writers-of", "readers-of"):
        return inspect.accessors(g.edges, functions, one(0, ("StateVariable",)), {"writers-of": "writes", "readers-of": "reads"}[name])
    if name == "externals":
        return inspect.externals(functions, flags.get("unprotected", False), flags.get("payable", False)).select("id", "visibility", "state_mutability", "access")
    if name == "unresolved":
        return inspect.unresolved_edges(g.edges, g.nodes).select("category", "from_id", "to_id", "count", "reason")
    reviews, findings, _ = store.audit_files(spark, root)
    if name == "stale-reviews":
        return audit.review_staleness(reviews, g.nodes).where("state <> 'current'")
    if name == "findings":
        if findings is None:
            raise GraphError("there are no imported findings")
        return findings.join(audit.findings_staleness(findings, g.nodes), "id").select("id", "check", "impact", "state").orderBy(audit.impact_rank(), "id")
    raise GraphError(f'there is no query "{name}"')


def diff_revisions(spark: SparkSession, before: str, after: str, repository: str = ".") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, findings) between two folders or revisions, built under the later one's configuration."""
    places = [project.resolve_revision(r, repository) for r in (before, after)]
    try:
        config, _ = project.load_config(places[1][0])
        graphs = []
        for folder, _ in places:
            p = project.detect_project(folder)
            files = project.list_sources(p, config.include, config.exclude)
            sources = ingest.read_sources(spark, folder).join(spark.createDataFrame([(f,) for f in files], "file string"), "file", "left_semi")
            graphs.append(build(sources, options_of(p, config)).graph)
        return tuple(materialise(x) for x in diff.diff_graphs(*graphs))
    finally:
        for folder, temporary in places:
            if temporary:
                subprocess.run(["git", "-C", repository, "worktree", "remove", "--force", folder], capture_output=True)


def export_view(spark: SparkSession, root: str, view: str, form: str, focus: str | None = None, include_tests: bool = False) -> str:
    g = load_project(spark, root)
    node = search.require_node(g.nodes, focus) if focus else None
    chosen = views.select_view(g, view, node, include_tests)
    if form == "html":
        return export.to_html({"protocol": [(view, export.to_json(chosen))]}, title=view)
    return {"dot": export.to_dot, "mermaid": export.to_mermaid, "json": export.to_json, "svg": export.to_svg}[form](chosen)


def set_review(spark: SparkSession, root: str, ref: str, status: str, reviewer: str | None = None, note: str | None = None) -> str:
    if status not in audit.STATUSES:
        raise GraphError(f'"{status}" is none of {", ".join(audit.STATUSES)}')
    g, path = load_project(spark, root), project.managed_dir(root) / "review.json"
    node = search.require_node(g.nodes, ref)
    now = datetime.now(UTC).replace(tzinfo=None, microsecond=0)
    update = spark.createDataFrame([(node, status, reviewer, note, now)], "node string, status string, reviewer string, note string, at timestamp")
    store.write_reviews(materialise(audit.set_reviews(store.read_reviews(spark, str(path)), g.nodes, update)), str(path))
    return node


def import_findings(spark: SparkSession, root: str, report: str) -> tuple[int, int]:
    """(mapped, unmapped) results of a scanner's report, stored beside the graph."""
    g = load_project(spark, root)
    spans = g.nodes.where("src is not null and kind <> 'Unresolved'").select("id", "file", F.col("src.offset").alias("offset"), F.col("src.length").alias("length"), "body_hash")
    found, lost = audit.import_findings(store.read_detectors(spark, Path(report).read_text()), spans)
    found = materialise(found)
    stamp = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    store.write_findings(found, str(project.managed_dir(root) / "findings.json"), {"tool": "slither", "file": report, "at": stamp})
    return found.count(), lost.count()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lattica")
    parser.add_argument("--root", default=".")
    parser.add_argument("--json", action="store_true")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("build")
    sub.add_parser("stats")
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("args", nargs="*")
    q.add_argument("--depth", type=int, default=1)
    for flag in ("unprotected", "payable", "stale"):
        q.add_argument(f"--{flag}", action="store_true")
    d = sub.add_parser("diff")
    d.add_argument("before")
    d.add_argument("after")
    e = sub.add_parser("export")
    e.add_argument("view")
    e.add_argument("--format", choices=("dot", "mermaid", "json", "svg", "html"), default="dot")
    e.add_argument("--focus")
    e.add_argument("--include-tests", action="store_true")
    r = sub.add_parser("review")
    r.add_argument("node")
    r.add_argument("status")
    r.add_argument("--reviewer")
    r.add_argument("--note")
    i = sub.add_parser("import-findings")
    i.add_argument("report")
    a = parser.parse_args(argv)
    spark = session()

    def show(df: DataFrame) -> int:
        """Prints every row as it comes, a partition in memory at a time."""
        some = False
        for row in df.toLocalIterator():
            x = row.asDict(True)
            if a.json:
                print("," if some else "[", json.dumps(x, default=str))
            else:
                print("\t".join(str(v) for v in x.values()))
            some = True
        if a.json:
            print("]" if some else "[]")
        return int(some)

    try:
        if a.command == "build":
            built, notes = build_project(spark, a.root)
            print("\n".join([f"{built.mode}: {built.reason}", *notes]))
            return 0
        if a.command == "stats":
            show(inspect.graph_stats(load_project(spark, a.root)))
            return 0
        if a.command == "query":
            return show(query(spark, a.root, a.name, *a.args, depth=a.depth, unprotected=a.unprotected, payable=a.payable, stale=a.stale))
        if a.command == "diff":
            nodes, edges, found = diff_revisions(spark, a.before, a.after, a.root)
            changed = show(diff.told(nodes).select("status", "id", F.array_join("changes", ",").alias("changes"))) | show(found)
            return int(bool(changed) or not edges.where("status <> 'unchanged'").isEmpty())
        if a.command == "export":
            print(export_view(spark, a.root, a.view, a.format, a.focus, a.include_tests), end="")
            return 0
        if a.command == "review":
            print(set_review(spark, a.root, a.node, a.status, a.reviewer, a.note))
            return 0
        mapped, lost = import_findings(spark, a.root, a.report)
        print(f"{mapped} mapped, {lost} not")
        return int(mapped > 0)
    except (GraphError, ViewError, LookupError, project.ConfigError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
