"""Layers and circles by rounds, by drawing together and in one task: the same rows as a plain version."""

from __future__ import annotations

import random

import pytest

from lattica.operators import layers

from .test_rounds import _plain


@pytest.mark.parametrize("few", [0, 8, 50_000])
def test_layered_equals_plain_on_each_path(spark, monkeypatch, few):
    monkeypatch.setattr(layers, "SMALL_INDEX", few)
    draw = random.Random(11)
    nodes = [f"n{i:02}" for i in range(26)]
    arcs = {(draw.choice(nodes), draw.choice(nodes)) for _ in range(24)}
    arcs |= {("n03", "n11"), ("n11", "n07"), ("n07", "n03"), ("n20", "n21"), ("n21", "n20"), ("n21", "n22"), ("n22", "n21"), ("n07", "n20"), ("n05", "n05"), ("n22", "n24"), ("n24", "n25"), ("n25", "n20")}
    circles, level = _plain(nodes, sorted(arcs))
    rows = layers.layered(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(sorted(arcs), "src string, dst string")).collect()
    assert len(rows) == len(nodes) and {r["id"]: r["layer"] for r in rows} == level
    assert circles and {r["id"]: r["component"] for r in rows if r["component"]} == circles
