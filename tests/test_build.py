"""Sources to an analysed graph."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lattica.operators import diff, inherit, overlay, search, views
from lattica.operators.build import BuildOptions, build
from lattica.operators.export import to_dot, to_html, to_json, to_mermaid, to_svg
from lattica.operators.inspect import file_lenses, graph_stats, inspect_node, lens_title, node_at, nodes_in_file
from lattica.operators.resolve import Remappings, resolve_imports
from lattica.schema import Graph, GraphError, ViewError, check_graph
from lattica.sources.parser import parse_source
from lattica.sources import buildinfo, ingest, store

from .projects import BROKEN, HIERARCHY, VAULT

OPEN = {"threshold": 0.0}


@pytest.fixture(scope="module")
def vault(spark):
    return build(ingest.sources_of(spark, VAULT), BuildOptions(**OPEN))


@pytest.fixture(scope="module")
def edges(vault):
    return {(r["kind"], r["subkind"], r["from_id"].rpartition(":")[2], r["to_id"].rpartition(":")[2] if not r["to_id"].startswith("?") else r["to_id"]): r for r in vault.graph.edges.collect()}


def test_inheritance_edges(edges, vault):
    assert ("inherits", None, "Token", "IToken") in edges and ("inherits", None, "Child", "Vault") in edges
    linear = {r["name"]: [x.rpartition(":")[2] for x in r["linearized_bases"]] for r in vault.graph.nodes.where("kind = 'Contract'").collect()}
    assert linear["Child"] == ["Child", "Vault", "Owned"] and linear["Token"] == ["Token", "Owned", "IToken"]
    full = {r["name"]: r["is_fully_implemented"] for r in vault.graph.nodes.where("kind = 'Contract'").collect()}
    assert full == {"IToken": False, "Owned": False, "Token": True, "Math": True, "Vault": True, "Child": True}


def test_overrides(edges):
    assert ("implements", None, "Token.mint(address,uint256)", "IToken.mint(address,uint256)") in edges
    assert ("implements", None, "Vault._hook(uint256)", "Owned._hook(uint256)") in edges
    assert ("overrides", None, "Child._hook(uint256)", "Vault._hook(uint256)") in edges


def test_calls(edges):
    deposit, close, run = "Vault.deposit(uint256)", "Vault.close(address)", [k for k in edges if k[2].startswith("Child.run")][0][2]
    assert ("calls", "library", deposit, "Math.half(uint256)") in edges
    assert edges[("calls", "library", deposit, "Math.twice(uint256)")]["resolution"] == "heuristic"
    assert ("calls", "internal", deposit, "helper(uint256)") in edges
    mint = edges[("calls", "external", deposit, "IToken.mint(address,uint256)")]
    assert mint["cross_trust_boundary"] and [t.rpartition(":")[2] for t in mint["possible_targets"]] == ["Token.mint(address,uint256)"]
    assert edges[("calls", "lowlevel", deposit, "?dynamic-receiver:call")]["resolution"] == "unresolved"
    assert ("calls", "external", close, "IToken.balanceOf(address)") in edges
    assert ("calls", "external", close, deposit) in edges
    assert ("calls", "internal", close, "helper(uint256)") in edges
    assert ("calls", "internal", close, "?not-found:missing") in edges
    assert ("calls", "delegatecall", close, "?low-level:delegatecall") in edges
    assert ("calls", "external", close, "?dynamic-receiver:mint") in edges
    assert ("creates", None, close, "?not-found:Token2") in edges
    assert ("calls", "super", "Child._hook(uint256)", "Vault._hook(uint256)") in edges
    assert ("calls", "internal", run, "?function-pointer:f") in edges and ("calls", "internal", run, "Child._hook(uint256)") in edges
    assert ("calls", "internal", "Child.constructor(IToken)", "Vault.constructor(T)") in edges or ("calls", "internal", "Child.constructor(T)", "Vault.constructor(T)") in edges
    assert not any(k[0] == "calls" and k[3] == "?not-found:require" for k in edges)


def test_state_events_errors(edges):
    deposit = "Vault.deposit(uint256)"
    total = edges[("writes", None, deposit, "Vault.total")]
    assert total["count"] == 2 and len(total["sites"]) == 2
    assert ("writes", None, "Token.mint(address,uint256)", "Token.history") in edges
    assert ("emits", None, deposit, "Vault^Deposited(address,uint256)") in edges
    assert ("emits", None, "Token.mint(address,uint256)", "IToken^Moved(address,address,uint256)") in edges
    assert ("reverts", None, "Owned#onlyOwner()", "!NotOwner(address)") in edges
    assert ("modifiedBy", None, "Vault.close(address)", "Owned#onlyOwner()") in edges
    assert ("modifiedBy", None, deposit, "?not-found:nonReentrant") in edges
    assert ("declares", None, "src/Vault.sol", "Vault") in edges and ("declares", None, "Vault", "Vault.total") in edges


def test_analyses(vault):
    f = {r["id"].rpartition(":")[2]: r for r in vault.graph.nodes.where("kind = 'Function'").collect()}
    assert f["Vault.deposit(uint256)"]["reentrancy"].asDict() == {"externalCallThenWrite": True, "guarded": True}
    assert f["Vault.close(address)"]["access_control"].asDict() == {"modifiers": ["onlyOwner"], "confidence": "high"}
    assert f["Vault.deposit(uint256)"]["access_control"]["confidence"] == "none"
    assert f["Math.half(uint256)"]["externally_reachable"] and "src/Vault.sol:Vault.deposit(uint256)" in f["Math.half(uint256)"]["entrypoints"]
    assert not f["IToken.mint(address,uint256)"]["has_body"]
    assert f["Owned.constructor(address)"]["externally_reachable"] is False
    assert vault.mode == "heuristic" and "%" in vault.reason
    missing = vault.graph.nodes.where("id = 'src/Vault.sol'").first()["unresolved_imports"]
    assert missing == ["./Missing.sol"]


def test_partitions_and_cache_do_not_matter(spark, vault):
    sources = ingest.sources_of(spark, VAULT)
    cache = ingest.parse_units(sources).where(F.crc32("key") % 2 == 0)
    again = build(sources.repartition(5), BuildOptions(**OPEN), cache)
    strip = lambda df: sorted(map(repr, df.drop("seq").collect()))
    assert strip(again.graph.nodes) == strip(vault.graph.nodes) and strip(again.graph.edges) == strip(vault.graph.edges)


def test_linear_orders(spark):
    g = build(ingest.sources_of(spark, HIERARCHY), BuildOptions(**OPEN)).graph
    n = {r["name"]: ([x.rpartition(":")[2] for x in r["linearized_bases"]], r["linearization_certainty"]) for r in g.nodes.where("kind = 'Contract'").collect()}
    assert n["Ring"] == (["Ring", "Ore", "Dust", "Gem", "Stone"], "certain") and n["Coin"] == (["Coin", "Gem", "Ore", "Stone"], "certain")
    assert n["Swap"][1] == "ambiguous" and set(n["Swap"][0]) == {"Swap", "Gem", "Stone"}
    assert n["Egg"][1] == "ambiguous" and set(n["Egg"][0]) == {"Egg", "Chick"}
    calls = {(r["from_id"].rpartition(":")[2], r["to_id"].rpartition(":")[2]) for r in g.edges.where("subkind = 'super'").collect()}
    assert ("Ring.weigh()", "Ore.weigh()") in calls and ("Coin.weigh()", "Gem.weigh()") in calls and ("Ring.weigh()", "Gem.weigh()") not in calls


def test_merge_finds_contradictions():
    assert inherit.merge([["b", "a"], ["c", "a"], ["b", "c"]]) == ["b", "c", "a"]
    assert inherit.merge([["a", "b"], ["b", "a"]]) is None


def test_orders_of_long_chains_and_wide_circles(spark):
    chain = {f"c{i}": [f"c{i - 1}"] for i in range(1, 3000)}
    assert inherit.linear_order("c2999", chain) == ([f"c{i}" for i in range(2999, -1, -1)], "certain")
    ring = {str(i): [str(j) for j in range(14)] for i in range(14)}
    order, certainty = inherit.linear_order("3", ring)
    assert sorted(order) == sorted(ring) and order[0] == "3" and certainty == "ambiguous"
    arcs = spark.createDataFrame([("a", "a", 0), ("b", "a", 0), ("b", "c", 1), ("c", "d", 0)], "from_id string, to_id string, idx int")
    got = {r["id"]: (r["linearized"], r["certainty"]) for r in inherit.linearise(spark.createDataFrame([(x,) for x in "abcd"], "id string"), arcs).collect()}
    assert got == {"a": (["a"], "ambiguous"), "b": (["b", "c", "d", "a"], "ambiguous"), "c": (["c", "d"], "certain"), "d": (["d"], "certain")}


def test_a_body_nested_too_deeply_keeps_declarations(spark):
    text = "contract A { uint v; function f() public { v = " + "(" * 5000 + "1" + ")" * 5000 + "; } function g() public { v = 2; } }"
    unit = parse_source("a.sol", text)
    names = {x["name"] for x in unit["symbols"]}
    assert {"A", "v", "f", "g"} <= names and unit["recovered"] and any("too deeply" in d for d in unit["diagnostics"])


def test_structural_mode_withholds_calls(spark):
    built = build(ingest.sources_of(spark, VAULT), BuildOptions(threshold=1.01))
    assert built.mode == "structural" and built.graph.edges.where("kind in ('calls', 'creates')").isEmpty()
    assert {r["category"] for r in built.graph.nodes.where("kind = 'Unresolved'").collect()} == {"not-found"}
    with pytest.raises(ViewError):
        views.select_view(built.graph, "call", "src/Vault.sol:Vault.close(address)")


def test_broken_project(spark):
    built = build(ingest.sources_of(spark, BROKEN), BuildOptions(**OPEN))
    assert built.graph.nodes.where("kind = 'Contract'").count() == 3 and built.diagnostics.count() >= 2
    assert built.score.where("scope = 'overall' and total = 0").count() == 1


def test_imports(spark):
    texts = {"src/a/A.sol": 'import "../b/B.sol"; import "@x/C.sol"; import "D.sol"; import "gone.sol";', "src/b/B.sol": "", "lib/x/src/C.sol": "", "src/D.sol": ""}
    units = ingest.units(ingest.parse_units(ingest.sources_of(spark, texts)))
    out = {r["path"]: r["target"] for r in resolve_imports(units, Remappings.parse(["@x/=lib/x/src/", "other:@x/=nowhere/"])).collect()}
    assert out == {"../b/B.sol": "src/b/B.sol", "@x/C.sol": "lib/x/src/C.sol", "D.sol": "src/D.sol", "gone.sol": None}


def test_views(vault):
    g = vault.graph
    assert {r["name"] for r in views.select_view(g, "protocol").nodes.collect()} == {"IToken", "Owned", "Token", "Math", "Vault", "Child"}
    rolled = {(r["from_id"].rpartition(":")[2], r["to_id"].rpartition(":")[2]): r["count"] for r in views.select_view(g, "protocol").edges.where("id like 'rollup:%'").collect()}
    assert rolled[("Vault", "Math")] == 2 and rolled[("Vault", "IToken")] == 2
    one = views.select_view(g, "contract", "src/Vault.sol:Vault.total")
    assert {"src/Vault.sol:Vault", "src/Owned.sol:Owned", "src/Owned.sol:Owned.owner"} <= {r["id"] for r in one.nodes.collect()}
    calls = views.select_view(g, "call", "src/Vault.sol:Vault.deposit(uint256)", up=1, down=1)
    assert "src/Vault.sol:Vault.close(address)" in {r["id"] for r in calls.nodes.collect()}
    assert views.select_view(g, "state-access", "src/Token.sol:Token").edges.count() >= 3
    assert views.select_view(g, "inheritance").edges.where("kind = 'implements'").count() == 5
    for bad in (("contract", None), ("call", None), ("nothing", None), ("contract", "absent"), ("contract", "src/Math.sol:helper(uint256)")):
        with pytest.raises(ViewError):
            views.select_view(g, *bad)
    shut = views.aggregate(g, [])
    assert {r["id"] for r in shut.nodes.where("id is not null and id like 'dir:%'").collect()} == {"dir:src"}
    assert views.aggregate(g).nodes.count() >= g.nodes.where("file like 'src/%'").count()
    with pytest.raises(ViewError):
        views.aggregate(g, ["nowhere"])
    with pytest.raises(ViewError):
        views.aggregate(g, ["src"], cap=3)


def test_search_and_references(vault):
    n = vault.graph.nodes
    assert search.require_node(n, "Vault.deposit") == "src/Vault.sol:Vault.deposit(uint256)"
    assert search.require_node(n, "Owned#onlyOwner") == "src/Owned.sol:Owned#onlyOwner()"
    with pytest.raises(search.NodeRefError) as e:
        search.require_node(n, "balanceOf")
    assert len(e.value.candidates) == 2
    with pytest.raises(search.NodeRefError) as e:
        search.require_node(n, "depos")
    assert any("deposit" in c for c in e.value.candidates)
    hits, total = search.search(n, "dpst")
    assert [r["id"] for r in hits.collect()] == ["src/Vault.sol:Vault.deposit(uint256)", "src/Vault.sol:Vault^Deposited(address,uint256)"] and total == 2
    assert search.search(n, "vdpst")[1] == 0
    hits, total = search.search(n, "Vault.deposit(uint256)")
    assert hits.first()["match"] == "exact"
    assert search.search(n, " ")[1] == 0 and search.search(n, "?not-found")[1] >= 3 and search.search(n, "missing")[1] == 0


def test_inspection(vault):
    g = vault.graph
    rows = inspect_node(g, "src/IToken.sol:IToken.mint(address,uint256)").collect()
    assert {r["edge_kind"] for r in rows if r["direction"] == "incoming"} == {"calls", "implements"}
    stats = {(r["measure"], r["key"]): r["count"] for r in graph_stats(g).collect()}
    assert stats[("contracts", "total")] == 6 and stats[("functions", "call_then_write")] >= 1 and stats[("unresolved", "low-level")] == 1
    lens = {r["id"]: r for r in lens_title(file_lenses(g.nodes.where("kind = 'Function' and file = 'src/Vault.sol'"), g.edges)).collect()}
    assert lens["src/Vault.sol:Vault.deposit(uint256)"]["written"] == 2 and "write" in lens["src/Vault.sol:Vault.deposit(uint256)"]["title"]
    assert nodes_in_file(g.nodes, "src/Math.sol").first()["id"] == "src/Math.sol"
    at = VAULT["src/Math.sol"].encode().index(b"x / 2")
    points = g.nodes.sparkSession.createDataFrame([("src/Math.sol", at)], "file string, at long")
    assert node_at(g.nodes, points).first()["id"] == "src/Math.sol:Math.half(uint256)"


def test_round_trip_and_checks(spark, vault, tmp_path):
    store.write_graph(vault.graph, str(tmp_path / "g"), {"mode": vault.mode})
    back = store.read_graph(spark, str(tmp_path / "g"))
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert same(back.nodes, vault.graph.nodes) and same(back.edges, vault.graph.edges) and store.read_header(spark, str(tmp_path / "g"))["mode"] == vault.mode
    path = str(tmp_path / "exchange")
    store.write_exchange(vault.graph, path, {"name": "x"})
    parts = "".join(p.read_text() for p in sorted((tmp_path / "exchange").glob("part-*")))
    assert json.loads(parts)["name"] == "x" and [n["id"] for n in json.loads(parts)["nodes"]] == sorted(r["id"] for r in vault.graph.nodes.select("id").collect())
    (tmp_path / "one.json").write_text(json.dumps(json.loads(parts), indent=2))
    (tmp_path / "old.json").write_text(json.dumps(json.loads(parts) | {"schemaVersion": 4}))
    same = lambda x, y: sorted(map(str, x.drop("seq").collect())) == sorted(map(str, y.drop("seq").collect()))
    for where in (path, str(tmp_path / "one.json")):
        got = store.read_exchange(spark, where)
        assert {r["id"] for r in got.nodes.collect()} == {r["id"] for r in vault.graph.nodes.collect()}
        assert same(got.edges.select("id", "kind", "from_id", "to_id", "count", "resolution", "sites"), vault.graph.edges.select("id", "kind", "from_id", "to_id", "count", "resolution", "sites"))
    with pytest.raises(GraphError):
        store.read_exchange(spark, str(tmp_path / "old.json"))
    text = store.graph_json(vault.graph)
    assert store.graph_json(vault.graph) == text and store.parse_graph(spark, text).edges.count() == vault.graph.edges.count()
    with pytest.raises(GraphError):
        store.parse_graph(spark, json.dumps(json.loads(text) | {"schemaVersion": 4}))
    with pytest.raises(GraphError):
        check_graph(Graph(vault.graph.nodes.where("id not like '%deposit%'"), vault.graph.edges))


def test_slices(spark, vault):
    sources = ingest.sources_of(spark, VAULT)
    nodes = vault.graph.nodes.where("id = 'src/Math.sol:Math.half(uint256)'")
    row = store.slice_nodes(nodes, sources).first()
    assert row["text"] == "function half(uint256 x) internal pure returns (uint256) { return x / 2; }" and not row["drifted"] and not row["truncated"]
    row = store.slice_nodes(nodes, sources, 1, 1, limit=60).first()
    assert row["truncated"] and row["text"] == "library Math {\n"
    assert store.slice_nodes(nodes, sources.withColumn("content", F.lit("short"))).first()["drifted"]


def test_exports(vault):
    view = views.select_view(vault.graph, "inheritance")
    dot, mermaid, js, svg = to_dot(view), to_mermaid(view), to_json(view), to_svg(view)
    assert dot.startswith("digraph") and '"src/Vault.sol:Child" -> "src/Vault.sol:Vault"' in dot
    assert "flowchart LR" in mermaid and '-->|"inherits (heuristic)"|' in mermaid
    assert {n["id"] for n in json.loads(js)["nodes"]} >= {"src/Vault.sol:Vault"} and svg.count("<rect") == view.nodes.count()
    page = to_html({"protocol": [("a", '{"x":"</script>"}')], "source": [("b", '"' + "y" * 100 + '"')]}, budget=60)
    assert "</script><p>0" in page or "\\u003c/script" in page


def test_self_diff_is_empty_and_mirrors(spark, vault):
    nodes, edges, found = diff.diff_graphs(vault.graph, vault.graph)
    assert {r["status"] for r in nodes.collect()} == {"unchanged"} and {r["status"] for r in edges.collect()} == {"unchanged"} and found.isEmpty()
    changed = dict(VAULT)
    changed["src/Math.sol"] = VAULT["src/Math.sol"].replace("half", "halve").replace("return x * 2; }", "return x + x; }")
    changed["src/Vault.sol"] = VAULT["src/Vault.sol"].replace("amount.half()", "amount.halve()").replace("function close(address who) public onlyOwner", "function close(address who) public payable").replace("uint256 total;", "uint256 extra; uint256 total;").replace("contract Child", "contract Extra { function open() external { assembly {} } }\ncontract Child")
    later = build(ingest.sources_of(spark, changed), BuildOptions(**OPEN)).graph
    nodes, edges, found = diff.diff_graphs(vault.graph, later)
    status = {r["id"].rpartition(":")[2]: (r["status"], r["changes"], r["tier"]) for r in nodes.collect()}
    assert status["Math.halve(uint256)"][0] == "renamed" and status["Math.halve(uint256)"][2] == "body"
    assert status["Math.twice(uint256)"] == ("modified", ["body_hash"], "exact")
    assert status["Extra.open()"][0] == "added" and status["Vault.extra"][0] == "added"
    kinds = {(r["kind"], r["node"].rpartition(":")[2]) for r in found.collect()}
    assert {("became-payable", "Vault.close(address)"), ("access-control-weakened", "Vault.close(address)"), ("storage-layout-changed", "Vault"), ("new-external-entrypoint", "Extra.open()"), ("new-dangerous-op", "Extra.open()")} <= kinds
    back = {r["status"]: r["count"] for r in diff.summary(diff.diff_graphs(later, vault.graph)[0]).collect()}
    forth = {r["status"]: r["count"] for r in diff.summary(nodes).collect()}
    assert back.get("added", 0) == forth.get("removed", 0) and back["removed"] == forth["added"] and back["renamed"] == forth["renamed"]


def test_overlay(spark):
    texts = {"src/A.sol": "pragma solidity ^0.8.0;\ncontract A { function f(uint x) public {} function f(bytes y) public {} function g() external { f(1); h(); } uint s; }"}
    src = texts["src/A.sol"]
    at = lambda needle: src.index(needle)
    node = lambda kind, i, pos, **more: {"nodeType": kind, "id": i, "src": f"{pos}:5:0", **more}
    call = node("FunctionCall", 9, at("f(1)"), expression=node("Identifier", 10, at("f(1)"), referencedDeclaration=2))
    info = {"input": {"sources": {"src/A.sol": {"content": src}}}, "output": {"sources": {"src/A.sol": {"id": 0, "ast": {"nodeType": "SourceUnit", "id": 1, "src": "0:1:0", "nodes": [
        node("FunctionDefinition", 2, at("function f(uint"), functionSelector="aabbccdd"), node("FunctionDefinition", 3, at("function f(bytes")), call, node("VariableDeclaration", 4, at("uint s"))]}}},
        "contracts": {"src/A.sol": {"A": {"storageLayout": {"storage": [{"astId": 4, "slot": "0", "offset": 0}]}}}}}}
    sources = ingest.sources_of(spark, texts)
    symbols = ingest.symbols(ingest.parse_units(sources))
    facts = buildinfo.facts_of(spark.createDataFrame([("a.json", json.dumps(info)), ("b.json", "{broken")], "path string, text string"))
    plain = build(sources, BuildOptions(**OPEN)).graph.edges.where("kind = 'calls' and to_id like '%A.f%'")
    assert {r["resolution"] for r in plain.collect()} == {"ambiguous"} and plain.count() == 2
    over = overlay.Overlay(facts, sources, symbols)
    assert over.coverage() == (1, 0)
    built = build(sources, BuildOptions(overlay=over, **OPEN))
    hit = built.graph.edges.where("kind = 'calls' and to_id like '%A.f%'").collect()
    assert [(r["to_id"], r["resolution"]) for r in hit] == [("src/A.sol:A.f(uint)", "semantic")] and built.mode == "full"
    n = {r["id"]: r for r in built.graph.nodes.collect()}
    assert n["src/A.sol:A.f(uint)"]["selector"] == "0xaabbccdd" and n["src/A.sol:A.s"]["slot"] == "0" and n["src/A.sol:A.f(bytes)"]["selector"] is None
    stale = overlay.Overlay(facts, sources.withColumn("content", F.concat("content", F.lit(" "))), symbols)
    assert stale.coverage() == (0, 1)
