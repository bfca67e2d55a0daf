"""Review state, imported findings, closures on both paths, the stream and the commands."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lattica import api, protocol
from lattica.operators import audit, closure, collapse
from lattica.schema import GraphError
from lattica.sources import store
from lattica.streaming import watch

NODES = [("a", "x/f.sol", 0, 100, "h1"), ("b", "x/f.sol", 10, 20, "h2"), ("c", "x/g.sol", 0, 50, "")]


@pytest.fixture
def nodes(spark):
    return spark.createDataFrame(NODES, "id string, file string, offset long, length long, body_hash string")


def test_reviews(spark, nodes, tmp_path):
    path = str(tmp_path / "review.json")
    assert store.read_reviews(spark, path).isEmpty()
    (tmp_path / "review.json").write_text(json.dumps({"a": {"status": "reviewed", "bodyHash": "old", "at": "2024-01-02T03:04:05Z"}, "gone": {"status": "flagged", "bodyHash": "x", "at": "2024-01-02T03:04:05Z"}}))
    reviews = store.read_reviews(spark, path)
    states = lambda r: {x["node"]: x["state"] for x in audit.review_staleness(r, nodes).collect()}
    assert states(reviews) == {"a": "stale", "gone": "orphaned"}
    update = spark.createDataFrame([("a", "ignored", None, "fine", None)], "node string, status string, reviewer string, note string, at timestamp").withColumn("at", F.to_timestamp(F.lit("2024-05-06T07:08:09Z")))
    now = audit.set_reviews(reviews, nodes, update)
    assert states(now) == {"a": "current", "gone": "orphaned"}
    store.write_reviews(now, path)
    assert json.loads((tmp_path / "review.json").read_text())["a"] == {"status": "ignored", "bodyHash": "h1", "note": "fine", "at": "2024-05-06T07:08:09Z"}
    moved = audit.migrate_reviews(reviews, spark.createDataFrame([("a", "b")], "before string, after string"))
    assert {r["node"] for r in moved.collect()} == {"b", "gone"}
    assert audit.clear_reviews(reviews, ["a"]).count() == 1
    (tmp_path / "review.json").write_text('{"a": {"status": "maybe"}}')
    with pytest.raises(GraphError):
        store.read_reviews(spark, path)
    assert store.audit_files(spark, str(tmp_path))[0].isEmpty()


def test_import_findings(spark, nodes, tmp_path):
    place = lambda file, start, length: {"type": "node", "name": "n", "source_mapping": {"start": start, "length": length, "filename_relative": file}}
    found = [
        {"check": "one", "impact": "High", "confidence": "Low", "description": "d1", "elements": [place("x/f.sol", 12, 3)]},
        {"check": "one", "impact": "High", "confidence": "Low", "description": "d2", "elements": [place("root/x/f.sol", 12, 4), place("x/f.sol", 50, 1)]},
        {"check": "two", "impact": "Low", "confidence": "Low", "description": "d3", "elements": []},
        {"check": "two", "impact": "Low", "confidence": "Low", "description": "d4", "elements": [place("other.sol", 1, 1)]},
        {"check": "two", "impact": "Low", "confidence": "Low", "description": "d5", "elements": [place("x/g.sol", 49, 9)]},
    ]
    for text in (json.dumps(found), json.dumps({"success": True, "results": {"detectors": found}})):
        mapped, lost = audit.import_findings(store.read_detectors(spark, text), nodes)
        ids = {r["description"]: (r["id"], [n["id"] for n in r["nodes"]], len(r["locations"])) for r in mapped.collect()}
        assert ids == {"d1": ("one@x/f.sol:12", ["b"], 1), "d2": ("one@x/f.sol:12#1", ["a", "b"], 2)}
        nowhere = "no node contains any of its places"
        assert {r["description"]: r["reason"] for r in lost.collect()} == {"d3": "the finding names no source element", "d4": nowhere, "d5": nowhere}
    with pytest.raises(GraphError):
        store.read_detectors(spark, '{"success": false, "error": "boom"}')
    path = str(tmp_path / "findings.json")
    assert store.read_findings(spark, path) is None
    store.write_findings(mapped, path, {"tool": "t", "file": "f", "at": "now"})
    back = store.read_findings(spark, path)
    assert {r["id"]: r["state"] for r in audit.findings_staleness(back, nodes).collect()} == {"one@x/f.sol:12": "current", "one@x/f.sol:12#1": "current"}
    changed = nodes.withColumn("body_hash", F.when(F.col("id") == "a", "new").otherwise(F.col("body_hash")))
    assert {r["state"] for r in audit.findings_staleness(back.where("size(nodes) = 2"), changed).collect()} == {"stale"}
    assert {r["state"] for r in audit.findings_staleness(back, nodes.where("id = 'c'")).collect()} == {"orphaned"}
    reviews = spark.createDataFrame([("b", "flagged", "h2")], "node string, status string, body_hash string")
    row = audit.audit_projection(reviews, back, nodes).where("node = 'b'").first()
    assert row["worst"] == "High" and len(row["findings"]) == 2 and row["review_state"] == "current"
    assert audit.audit_summary(reviews, back, nodes).first()["findings"] == 2


def test_collapse_keeps_the_weakest_and_its_reason(spark):
    rows = [(1, "heuristic", None), (2, "ambiguous", None), (3, "heuristic", "no"), (4, "unresolved", "why"), (5, "ambiguous", "late")]
    drafts = spark.createDataFrame([(s, "calls", "internal", "a", "b", r, (0,), w, ["t", "u"] if s > 3 else None, s == 2, s) for s, r, w in rows],
                                   "seq long, kind string, subkind string, from_id string, to_id string, resolution string, site struct<offset:int>, reason string, targets array<string>, cross_trust_boundary boolean, linearization_index int")
    e = collapse.collapse(drafts.orderBy(F.desc("seq"))).first()
    assert (e["count"], e["resolution"], e["reason"], e["possible_targets"], e["cross_trust_boundary"], e["linearization_index"], e["id"]) == (5, "unresolved", "why", ["t", "u"], True, 1, "a|b|calls|internal")
    assert collapse.collapse(drafts.where("seq < 3")).first()["reason"] is None


def test_closures_agree_on_both_paths(spark, monkeypatch):
    arcs = [(f"n{i}", f"n{(i * 7 + d) % 40}") for i in range(40) for d in (1, 3)] + [("n1", "n1")]
    index = spark.createDataFrame([(a, b, f"{a}{b}", False) for a, b in arcs], "src string, dst string, edge_id string, virtual boolean")
    edges = spark.createDataFrame([(a, b, "calls") for a, b in arcs], "from_id string, to_id string, kind string")
    seeds = spark.createDataFrame([("n3",), ("n8",)], "id string")
    def both():
        walk = sorted((r["id"], r["depth"], len(r["via"])) for r in closure.traverse(index, "n0", "callees", 4).collect())
        pairs = sorted(map(tuple, closure.closure(seeds.select(F.col("id").alias("origin"), "id"), index).collect()))
        return walk, pairs, sorted(r["id"] for r in closure.close_over_callers(edges, seeds).collect())
    small = both()
    monkeypatch.setattr(closure, "SMALL_INDEX", 0)
    assert both() == small and small[0]
    assert closure.call_path(index, "n0", "n0") == [] and closure.call_path(index, "n0", "nowhere") is None
    path = closure.call_path(index, "n0", "n8")
    assert path[0]["src"] == "n0" and path[-1]["dst"] == "n8" and all(a["dst"] == b["src"] for a, b in zip(path, path[1:], strict=False))


def test_review_stream(spark, nodes, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"node": "a", "status": "reviewed", "body_hash": "h1", "at": "2024-01-01T00:00:00Z"}\n{"node": "z", "status": "flagged", "body_hash": "", "at": "2024-01-01T00:00:00Z"}\n')
    seen = []
    stream = watch.review_stream(spark, str(tmp_path / "in"))
    watch.follow(stream, nodes, lambda df, n: seen.extend((r["node"], r["state"]) for r in df.collect()), str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert sorted(seen) == [("a", "current"), ("z", "orphaned")]


def test_requests():
    r = protocol.ViewRequest.decode({"view": "call", "focus": "x", "up": "1", "expand": "b,a", "includeTests": "true"})
    assert (r.up, r.down, r.include_tests) == (1, 3, True) and r == protocol.ViewRequest.decode({"view": "call", "focus": "x", "up": 1, "expand": ["a", "b"], "includeTests": "1"})
    for bad in ({"view": "none"}, {"view": "call", "up": "-1"}, {"view": "call", "down": "x"}, {"view": "call", "includeTests": "maybe"}):
        with pytest.raises(protocol.RequestError):
            protocol.ViewRequest.decode(bad)
    assert protocol.meta({"schemaVersion": 5, "mode": "full", "nodes": [1]}) == {"schemaVersion": 5, "mode": "full"}


def test_commands(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/A.sol").write_text("pragma solidity ^0.8.0;\ncontract A { uint x; function f() public { x = 1; g(); } function g() internal {} }")
    (tmp_path / "foundry.toml").write_text("[profile.default]\nsrc = 'src'\n")
    built, notes = api.build_project(spark, str(tmp_path))
    assert built.mode == "heuristic" and notes == []
    root = str(tmp_path)
    assert [r["id"] for r in api.query(spark, root, "callers-of", "A.g").collect()] == ["src/A.sol:A.f()"]
    assert [r["function"] for r in api.query(spark, root, "writers-of", "A.x").collect()] == ["src/A.sol:A.f()"]
    assert api.query(spark, root, "externals", unprotected=True).count() == 1 and api.query(spark, root, "unresolved").isEmpty()
    assert [r["dst"] for r in api.query(spark, root, "path", "A.f", "A.g").collect()] == ["src/A.sol:A.g()"]
    assert api.set_review(spark, root, "A.f", "reviewed") == "src/A.sol:A.f()" and api.query(spark, root, "stale-reviews").isEmpty()
    assert "digraph" in api.export_view(spark, root, "protocol", "dot")
    with pytest.raises(GraphError):
        api.query(spark, root, "nothing")


def test_paths_match_the_file_that_shares_most(spark):
    files = spark.createDataFrame([(f,) for f in ("a/b.src", "b.src", "x/index.src", "y/index.src", "lib/deep/c.src")], "file string")
    asked = ["a/b.src", "/work/a/b.src", "/work/b.src", "index.src", "deep/c.src", "/w/lib/deep/c.src", "eep/c.src", "none.src", "/b.src", "b.src/"]
    got = {r["path"]: r["file"] for r in audit.match_paths(spark.createDataFrame([(p,) for p in asked], "path string"), files).collect()}
    assert got == {"a/b.src": "a/b.src", "/work/a/b.src": "a/b.src", "/work/b.src": "b.src", "index.src": "x/index.src", "deep/c.src": "lib/deep/c.src", "/w/lib/deep/c.src": "lib/deep/c.src", "/b.src": "b.src"}


def test_findings_take_the_spelling_that_is_a_file(spark, nodes):
    mapping = lambda start, **names: {"source_mapping": {"start": start, "length": 1, **{f"filename_{k}": v for k, v in names.items()}}}
    found = [
        {"check": "c", "description": " d ", "elements": [mapping(12, relative="../f.sol", short="f.sol", absolute="x/f.sol")]},
        {"check": None, "elements": [mapping(None, relative="x/f.sol"), {"type": "node"}]},
        {"elements": [mapping(12, relative="gone.sol"), mapping(12, relative="x/f.sol")]},
    ]
    mapped, lost = audit.import_findings(store.read_detectors(spark, json.dumps(found)), nodes)
    assert {(r["id"], r["description"], r["impact"], len(r["locations"])) for r in mapped.collect()} == {("c@x/f.sol:12", "d", "Unknown", 1), ("unknown@gone.sol:12", "", "Unknown", 2)}
    assert [(r["check"], r["reason"]) for r in lost.collect()] == [("unknown", "no element carries a source mapping")]


def test_review_parts_are_the_review_file(spark, tmp_path):
    rows = [("a\"b", "flagged", "h", None, "said, so", None), ("c", "reviewed", "", "r", None, None), ("zé", "ignored", "x", None, None, None)]
    reviews = spark.createDataFrame(rows, audit.REVIEW).repartition(3)
    store.write_review_parts(reviews, str(tmp_path / "parts"))
    whole = tmp_path / "review.json"
    whole.write_text("".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*"))))
    same = lambda df: sorted(map(repr, df.select("node", "status", "body_hash", "reviewer", "note").collect()))
    assert same(store.read_review_parts(spark, str(tmp_path / "parts"))) == same(store.read_reviews(spark, str(whole))) == same(reviews)
    store.write_review_parts(reviews.limit(0), str(tmp_path / "none"))
    assert store.read_review_parts(spark, str(tmp_path / "none")).count() == 0
    store.write_review_parts(reviews.withColumn("status", F.lit("odd")), str(tmp_path / "odd"))
    with pytest.raises(GraphError):
        store.read_review_parts(spark, str(tmp_path / "odd"))
