"""Members along orders: the same rows whether contracts are common or not, and overrides only where they are asked for."""

from __future__ import annotations

import random

import pytest

from lattica.operators import inherit, views
from lattica.plans import graphs
from lattica.plans.stargraph import Star
from lattica.schema import kind_is

ORDERS = "id string, linearized array<string>"
MEMBERS = "id string, scope string, kind string, subkind string, name string, sig string, has_body boolean"


def _world():
    draw = random.Random(3)
    orders = [(f"c{i}", [f"c{i}", *(f"c{j}" for j in range(i - 1, -1, -1) if j < 3 or draw.random() < 0.4)]) for i in range(14)]
    members = []
    for c, _ in orders[1:]:  # one contract has none
        for name in draw.sample(["a", "b", "d", "e", "only" + c], 3):
            members.append((f"{c}.{name}", c, "Function", draw.choice(["function", "constructor"]), name, "", draw.choice([True, False, None])))
        members.append((f"{c}.v", c, "StateVariable", None, draw.choice(["a", "v"]), "", None))
    return orders, members


@pytest.mark.parametrize("most", [0, 7, 200_000])
def test_members_along_orders_equal_plain(spark, monkeypatch, most):
    monkeypatch.setattr(inherit, "SMALL_SIDE", most)
    orders, members = _world()
    linear, rows = spark.createDataFrame(orders, ORDERS), spark.createDataFrame(members, MEMBERS)
    of = {c: [m for m in members if m[1] == c] for c, _ in orders}
    over = {(a[0], b[0], "overrides" if b[6] else "implements") for c, order in orders for base in order[1:] for a in of[c] for b in of[base] if a[2] == "Function" and a[3] == "function" and (a[2], a[4], a[5]) == (b[2], b[4], b[5])}
    got = [tuple(r) for r in inherit.overrides(linear, rows).collect()]
    assert over and len(got) == len(over) and set(got) == over
    own, first = set(), {}
    for c, order in orders:
        for depth, base in enumerate(order):
            for m in of[base]:
                if (c, m[2], m[4], m[5]) not in first:
                    first[c, m[2], m[4], m[5]] = m
                    own.add((c, depth, m[0]))
    assert {(r["contract"], r["depth"], r["id"]) for r in inherit.inherited_members(linear, rows).collect()} == own
    callable_ = {}
    for c, order in orders:
        for base in order:
            for m in of[base]:
                if m[2] == "Function" and m[3] != "constructor":
                    callable_.setdefault((c, m[4]), m[6])
    whole = {c: all(b is not False for (d, _), b in callable_.items() if d == c) for c, _ in orders}
    contracts = spark.createDataFrame([(c, "interface" if c == "c5" else "contract") for c, _ in orders], "id string, contract_kind string")
    assert {r["id"]: r["is_fully_implemented"] for r in inherit.fully_implemented(contracts, linear, rows).collect()} == whole | {"c5": False}


def test_overrides_are_made_only_where_asked_for(spark):
    g = graphs.graph(Star(spark, "/root/testdata/sf0.001"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan(g.edges)
    for kinds in (("inherits",), ("reads", "writes"), ("calls", "creates")):
        assert "posexplode" not in plan(g.edges.where(kind_is(*kinds)))
    assert "posexplode" not in plan(views.state_access_view(g).edges)
