"""Reachability by bitmaps and positions in texts, against plain versions."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from lattica.functions import positions
from lattica.operators import analysis, closure, reach
from lattica.plans import graphs
from lattica.plans.stargraph import Star


@pytest.mark.parametrize(("nodes", "arcs", "parts"), [(30, 25, 1), (60, 120, 3), (200, 210, 5)])
def test_origin_sets_equal_walks(spark, nodes, arcs, parts):
    rng = random.Random(nodes)
    pairs = [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(arcs)]
    starts = [f"n{i}" for i in rng.sample(range(nodes), nodes // 3)] + ["alone"]
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    by = defaultdict(set)
    for s in starts:
        todo, seen = [s], {s}
        while todo:
            for n in out[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        for n in seen:
            by[n].add(s)
    origins = reach.numbered(spark.createDataFrame([(s,) for s in starts * 2], "id string").repartition(parts))
    sets = reach.origin_sets(origins, spark.createDataFrame(pairs, "src string, dst string"))
    assert {r["id"]: r["origins"] for r in reach.set_sizes(sets).collect()} == {n: len(v) for n, v in by.items()}
    one = origins.where("id = 'alone' or id = 'n0'")
    wanted = {r["id"] for r in one.collect()}
    assert {r["id"] for r in reach.reached_by(sets, one).collect()} == {n for n, v in by.items() if v & wanted}


@pytest.mark.parametrize(("nodes", "arcs", "words"), [(60, 80, 1), (300, 450, 2)])
def test_counts_equal_walks(spark, nodes, arcs, words):
    rng = random.Random(nodes + arcs)
    pairs = [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(arcs)]
    starts = [f"n{i}" for i in rng.sample(range(nodes), nodes // 3)] + ["alone"]
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    by, far = defaultdict(set), {}
    for s in starts:
        todo, seen = [s], {s}
        while todo:
            for n in out[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        far[s] = len(seen)
        for n in seen:
            by[n].add(s)
    counts = reach.Counts(spark.createDataFrame([(s,) for s in starts * 2], "id string"), spark.createDataFrame(pairs, "src string, dst string"), words)
    assert {r["id"]: r["origins"] for r in counts.origins().collect()} == {n: len(v) for n, v in by.items()}
    assert {r["origin"]: r["reached"] for r in counts.reached().collect()} == far


def test_counts_make_no_pairs_through_a_circle(spark):
    n = 400
    rows = [(f"i{i}", f"c{i % 9}") for i in range(n)] + [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)] + [(f"c{i % 9}", f"o{i}") for i in range(n)]
    counts = reach.Counts(spark.createDataFrame([(a,) for a, _ in rows if a[0] == "i"], "id string"), spark.createDataFrame(rows, "src string, dst string"))
    assert counts._pairs.count() == n  # each origin with itself; all pairs would be n * (n + 10)
    assert {r["reached"] for r in counts.reached().collect()} == {n + 10}
    assert {r["id"][0]: r["origins"] for r in counts.origins().collect()} == {"i": 1, "c": n, "o": n}


def test_counts_find_circles_behind_nodes_of_more_ways(spark):
    rng = random.Random(4)
    rings = [(f"r{k}-{i}", f"r{k}-{(i + 1) % 100}") for k in range(4) for i in range(100)]
    pairs = rings + [(a, f"m{m}") for a, _ in rings for m in rng.sample(range(300), 8)] + [(f"m{m}", f"s{m}-{i}") for m in range(300) for i in range(2)]
    starts = sorted({a for a, _ in rings})
    counts = reach.Counts(spark.createDataFrame([(a,) for a in starts], "id string"), spark.createDataFrame(pairs, "src string, dst string"))
    assert counts._pairs.count() < 2000  # rings without a hub: each its 10,000 pairs and those with what it leads to
    want = {k: 100 + 3 * len({b for a, b in pairs if a[0] == "r" and a.startswith(f"r{k}-") and b[0] == "m"}) for k in range(4)}
    assert {r["origin"]: r["reached"] for r in counts.reached().collect()} == {a: want[int(a[1])] for a in starts}


@pytest.mark.parametrize(("nodes", "arcs"), [(60, 110), (300, 420)])
def test_counts_by_rounds_equal_few_arcs(spark, monkeypatch, nodes, arcs):
    rng = random.Random(nodes)
    pairs = spark.createDataFrame([(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(arcs)], "src string, dst string")
    starts = spark.createDataFrame([(f"n{i}",) for i in range(0, nodes, 3)], "id string")
    few = reach.Counts(starts, pairs)
    want = [sorted(map(tuple, x.collect())) for x in (few.reached(), few.origins())]
    for name, value in (("FEW_ARCS", 0), ("SMALL_SIDE", 10), ("SMALL_INDEX", 0)):
        monkeypatch.setattr(reach, name, value)
    by = reach.Counts(starts, pairs)
    assert [sorted(map(tuple, x.collect())) for x in (by.reached(), by.origins())] == want


def test_scopes_need_no_orders(spark, monkeypatch):
    g = Star(spark, "/root/testdata/sf0.001")
    want = sorted(map(tuple, analysis.deployable_scopes(graphs.contracts(g)).collect()))
    monkeypatch.setattr(graphs, "linear", None)
    assert sorted(map(tuple, graphs.scopes(Star(spark, g.path)).collect())) == want


def test_counts_without_origins(spark):
    none = reach.Counts(spark.createDataFrame([], "id string"), spark.createDataFrame([("a", "b")], "src string, dst string"))
    assert none.origins().isEmpty() and none.reached().isEmpty()


def test_origin_sets_without_origins(spark):
    none = reach.numbered(spark.createDataFrame([], "id string"))
    assert reach.origin_sets(none, spark.createDataFrame([("a", "b")], "src string, dst string")).count() == 0


@pytest.mark.parametrize("piece", [3, 256])
def test_positions_equal_plain_ones(spark, piece):
    rng = random.Random(piece)
    texts = {f"t{i}": "".join(rng.choice(["a", "bc", " ", "\n", "é", "\u4e2d", "\U0001f600", "\r\n"]) for _ in range(rng.randint(0, 80))) for i in range(25)}
    texts |= {"empty": "", "long": "x\u00e9" * 2000, "line": "\n" * 5}
    asked, want = [], set()
    for name, text in texts.items():
        data = text.encode()
        for at in {0, len(data), *(rng.randrange(len(data) + 1) for _ in range(12))}:
            asked.append((name, at))
            cut = at
            while cut < len(data) and data[cut] & 0xC0 == 0x80:
                cut -= 1
            before = data[:cut].decode()
            utf16 = lambda s: len(s.encode("utf-16-le")) // 2
            want.add((name, at, utf16(before), before.count("\n") + 1, utf16(before.rpartition("\n")[2])))
    got = positions.locate(spark.createDataFrame(list(texts.items()), "file string, content string"), spark.createDataFrame([*asked, ("gone", 0)], "file string, offset long"), piece)
    assert {tuple(r) for r in got.collect()} == want


def test_plain_pieces_leave_their_text_behind(spark):
    texts = spark.createDataFrame([("a", "plain\nlines"), ("b", "plain\nn\u00e9")], "file string, content string")
    assert {r["text"] for r in positions._starts(texts, 256).select("piece.text").collect()} == {None, "n\u00e9"}


@pytest.mark.parametrize("small", [0, 50_000])
def test_reached_without_ways(spark, monkeypatch, small):
    monkeypatch.setattr(closure, "SMALL_INDEX", small)
    arcs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("b", "c")], "src string, dst string")
    assert sorted(r["id"] for r in closure.reached(spark.createDataFrame([("b",), ("e",)], "id string"), arcs).collect()) == ["a", "b", "c", "e"]


def test_lines_are_found_once(spark):
    g = Star(spark, "/root/testdata/sf0.001")
    assert not [f for df in (g.calls(), g.accesses()) for f in df.inputFiles() if "lineitem" in f or "orders" in f]
    assert g.calls().count() == 263
