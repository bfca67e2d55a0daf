"""Layers, circles, builds by change, and artifacts, against plain versions and after awkward histories."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from lattica.operators import layers
from lattica.sources import buildinfo, incremental, ingest


def _reach(arcs, start):
    seen, todo = set(), [start]
    while todo:
        at = todo.pop()
        new = {b for a, b in arcs if a == at} - seen
        seen |= new
        todo += new
    return seen


def _plain(nodes, arcs):
    far = {n: _reach(arcs, n) for n in nodes}
    component = {n: min([m for m in nodes if m in far[n] and n in far[m]] or [n]) for n in nodes}
    level = {component[n]: 0 for n in nodes}
    for _ in nodes:
        for a, b in arcs:
            x, y = component[a], component[b]
            if x != y:
                level[y] = max(level[y], level[x] + 1)
    circles = {n: c for n, c in component.items() if any(m != n and d == c for m, d in component.items())}
    return circles, {n: level[component[n]] for n in nodes}


def test_layers_and_circles_equal_plain(spark):
    draw = random.Random(5)
    nodes = [f"n{i:02}" for i in range(24)]
    arcs = sorted({(draw.choice(nodes), draw.choice(nodes)) for _ in range(30)} | {("n03", "n11"), ("n11", "n07"), ("n07", "n03"), ("n20", "n21"), ("n21", "n20"), ("n07", "n20")})
    circles, level = _plain(nodes, arcs)
    df = spark.createDataFrame([*arcs, arcs[0]], "src string, dst string")
    assert circles and {r["id"]: r["component"] for r in layers.components(df).collect()} == circles
    assert {r["id"]: r["layer"] for r in layers.layers(spark.createDataFrame([(n,) for n in nodes], "id string"), df).collect()} == level


def test_layers_of_no_arcs(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert [(r["id"], r["layer"]) for r in layers.layers(spark.createDataFrame([("a",)], "id string"), none).collect()] == [("a", 0)]
    assert layers.components(none).isEmpty() and layers.layers(none.select(F.col("src").alias("id")), none).isEmpty()


def test_builds_parse_what_changed(spark, tmp_path):
    folder = str(tmp_path / "cache")
    files = lambda rows: spark.createDataFrame(rows, "file string, content string, modified long").withColumn("modified", F.timestamp_seconds("modified"))
    told = lambda rows: sorted((r["file"], r["status"], r["parsed"]) for r in rows.collect())
    a, b = "contract A {}", "contract B {}"
    units, done = incremental.update(files([("a.sol", a, 1), ("b.sol", b, 1)]), folder)
    assert told(done) == [("a.sol", "added", True), ("b.sol", "added", True)] and units.count() == 2
    # touched, but with the same text: not parsed; back to an older text: its unit is still there
    _, done = incremental.update(files([("a.sol", a, 2), ("b.sol", b + " ", 2)]), folder)
    assert told(done) == [("a.sol", "changed", False), ("b.sol", "changed", True)]
    units, done = incremental.update(files([("b.sol", b, 3)]), folder)
    assert told(done) == [("a.sol", "removed", False), ("b.sol", "changed", False)] and [r["file"] for r in ingest.units(units).collect()] == ["b.sol"]
    # a run that ended between units and log, then the same unit twice
    spark.read.parquet(f"{folder}/units").write.mode("append").parquet(f"{folder}/units")
    now = files([("b.sol", b, 3)])
    units, done = incremental.update(now, folder)
    assert told(done) == [("b.sol", "same", False)] and units.count() == 1 and incremental.is_fresh(now, incremental.state(spark, folder))
    incremental.compact(spark, folder, str(tmp_path / "small"))
    assert spark.read.parquet(str(tmp_path / "small/units")).count() == 1 and incremental.is_fresh(now, incremental.state(spark, str(tmp_path / "small")))
    units, done = incremental.update(files([]), folder)
    assert told(done) == [("b.sol", "removed", False)] and units.isEmpty()


def test_build_info_takes_what_is_there(spark):
    deep = {"nodeType": "Identifier", "src": "7:1:0", "referencedDeclaration": 2}
    for _ in range(150):
        deep = {"expression": deep}
    tree = {"nodeType": "SourceUnit", "id": 1, "src": "0:9:0", "nodes": [
        {"nodeType": "VariableDeclaration", "id": 2, "src": "3:1:0"}, deep, {"nodeType": "FunctionDefinition", "id": "odd", "src": "x", "modifiers": "none"},
        {"nodeType": "FunctionCall", "src": "8:1:0", "expression": {"referencedDeclaration": 99}}, {"nodeType": "ContractDefinition", "id": 5, "src": "4:1:0", "baseContracts": [None, {"baseName": {"referencedDeclaration": 5}}]},
    ]}
    info = {"output": {"sources": {"a.sol": {"ast": tree}, "b.sol": {}}, "contracts": [1]}}
    texts = spark.createDataFrame([("good", json.dumps(info)), ("list", "[1]"), ("null", None), ("none", "{}"), ("bare", '{"output":{"sources":{"x":{}}}}')], "path string, text string")
    facts = sorted(tuple(r)[1:6] for r in buildinfo.facts_of(texts).collect())
    assert facts == [("a.sol", "declaration", 3, None, None), ("a.sol", "declaration", 4, None, None), ("a.sol", "inherits", 4, "a.sol", 4), ("a.sol", "variable", 7, "a.sol", 3)]
    assert {r["artifact"]: r["error"] for r in buildinfo.unusable(texts).collect()} == {"list": "not a JSON object", "null": "not a JSON object", "none": "no output section", "bare": "no syntax trees in its output"}
