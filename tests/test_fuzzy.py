"""Fuzzy matches against a plain greedy walk over all pairs."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from lattica.operators import diff

PARAMS = "array<struct<name:string,type:string,indexed:boolean,storageLocation:string>>"
NODES = f"id string, kind string, scope string, name string, params {PARAMS}, returns {PARAMS}"


def dice(a, b):
    a, b = a.lower(), b.lower()
    if a == b:
        return 1.0
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    total = x.total() + y.total()
    return 2 * (x & y).total() / total if total else 0.0


def plain(before, after, near, threshold):
    scored = []
    for x in before:
        for y in after:
            if x[2] != y[2]:
                continue
            signature = 0.5 * (x[4] == y[4]) + 0.5 * (x[5] == y[5])
            one, two = near.get(x[0], set()), near.get(y[0], set())
            likeness = len(one & two) / len(one | two) if one | two else 1.0 if signature == 1 else 0.0
            score = 0.4 * signature + 0.3 * dice(x[3], y[3]) + 0.3 * likeness
            if score >= threshold:
                scored.append((-score, x[0], y[0]))
    taken, out = set(), set()
    for score, b, a in sorted(scored):
        if (0, b) not in taken and (1, a) not in taken:
            taken |= {(0, b), (1, a)}
            out.add((b, a, "fuzzy", round(-score, 6)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_fuzzy_matches_equal_a_walk_over_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = ["mint", "burn", "Transfer", "transferFrom", "a", "b", "setOwner", "setFee", "getFee", "swap", "x", "zq"]
    kinds = lambda: [(None, t, None, None) for t in rng.choice([(), ("uint256",), ("address", "uint256")])]
    def side(tag):
        return [(f"{tag}{i:03}", "Function", rng.choice(["s", "t", None]) if i % 9 else "s", rng.choice(words) + rng.choice(["", "", "X", "All", "2"]), kinds(), kinds() if i % 3 else []) for i in range(60)]
    before, after = side("p"), side("q")
    near = {f[0]: set(rng.sample(words, rng.randint(1, 3))) for f in before + after if rng.random() < 0.6}
    arcs = spark.createDataFrame([(i, n) for i, ns in near.items() for n in ns], "from_id string, name string")
    frames = [spark.createDataFrame([(*f[:4], [dict(zip(("name", "type", "indexed", "storageLocation"), p, strict=True)) for p in f[4]], [dict(zip(("name", "type", "indexed", "storageLocation"), p, strict=True)) for p in f[5]]) for f in x], NODES) for x in (before, after)]
    got = {tuple(r) for r in diff.match_fuzzy(*frames, arcs, arcs).collect()}
    held = lambda x: [f for f in x if f[2] is not None]
    assert got == plain(held(before), held(after), near, diff.FUZZY_THRESHOLD)


def test_fuzzy_matches_of_nothing_and_of_functions_that_share_nothing(spark):
    none = spark.createDataFrame([], NODES)
    arcs = spark.createDataFrame([], "from_id string, name string")
    assert diff.match_fuzzy(none, none, arcs, arcs).count() == 0
    names = lambda tag, letters: spark.createDataFrame([(f"{tag}{i}", "Function", "s", letters[i % len(letters)] * 3 + str(i), [], []) for i in range(10, 60)], NODES)
    assert diff.match_fuzzy(names("p", "ab"), names("q", "xy"), arcs, arcs).count() == 50
