"""Members by name along chains: only of names that are asked for, however many contracts declare them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import inherit, resolve
from lattica.operators.resolve import Resolver
from lattica.plans.storage import materialise
from lattica.sources import ingest

KINDS = """pragma solidity ^0.8.0;
contract K{k}{base} {{
    uint256 only{k};
    uint256 shared;
    function idle{k}() public {{}}
    function tick(uint256 a) public virtual {{ only{k} = a; shared = 1; up{half}(); }}
    function up{k}() internal {{ this.tick(1); K{half} near; near.tick(2); }}
}}
"""


def test_members_are_those_of_whole_chains(spark):
    rows = [(f"k/K{k}.sol", KINDS.format(k=k, half=k // 2, base=f" is K{k // 2}" if k > 1 else "")) for k in range(1, 25)]
    r = Resolver(materialise(ingest.parse_units(spark.createDataFrame(rows, "file string, content string"))))
    plain = inherit.inherited_members(r.linear, r.all.where("scope is not null")).drop("scope").withColumnRenamed("contract", "scope")
    whole = {(x["scope"], x["name"]): x for x in r._meanings(plain, "scope", "m").collect()}
    own = {(x["scope"], x["name"]): x for x in r.members.collect()}
    assert own and all(whole[k] == x for k, x in own.items())
    asked = {(x["contract"], x["name"]) for x in r._asked().collect()}
    assert asked & set(whole) == set(own)
    assert {n for _, n in own} >= {"tick", "shared", "only3", "up5"} and not any(n.startswith("idle") for _, n in own)
    assert resolve.FEW < 24  # both ways are taken


def test_overrides_of_names_declared_once(spark):
    linear = spark.createDataFrame([("a", ["a", "b"], "certain"), ("b", ["b"], "certain")], inherit.LINEAR)
    member = "id string, scope string, kind string, name string, sig string, subkind string, has_body boolean"
    m = spark.createDataFrame([(f"{s}{n}", s, "Function", n, "", "function", s == "b") for s, n in (("a", "x"), ("b", "x"), ("a", "y"), ("b", "z"))], member)
    assert [tuple(x) for x in inherit.overrides(linear, m).select("from_id", "to_id", F.col("kind")).collect()] == [("ax", "bx", "overrides")]
