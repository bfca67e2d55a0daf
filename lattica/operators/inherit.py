"""Inheritance: ancestors, linear orders, and members by name along them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Generator, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise
from .closure import SMALL_SIDE, closure

LINEAR = "id string, linearized array<string>, certainty string"


def ancestors(inherits: DataFrame) -> DataFrame:
    """(id, base): every base at any distance, itself not included unless inheritance is circular."""
    arcs = inherits.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    start = inherits.select(F.col("from_id").alias("origin"), F.col("to_id").alias("id"))
    return closure(start, arcs).select(F.col("origin").alias("id"), F.col("id").alias("base"))


def merge(sequences: list[list[str]]) -> list[str] | None:
    """The C3 merge of linear orders, in steps of their number; None where they contradict each other."""
    rest, out = [s for s in sequences if s], []
    at = [0] * len(rest)
    later = Counter(x for s in rest for x in s[1:])  # how often each stands behind a head
    while live := [i for i, s in enumerate(rest) if at[i] < len(s)]:
        head = next((rest[i][at[i]] for i in live if not later[rest[i][at[i]]]), None)
        if head is None:
            return None
        out.append(head)
        for i in live:
            if rest[i][at[i]] == head:
                at[i] += 1
                if at[i] < len(rest[i]):
                    later[rest[i][at[i]]] -= 1
    return out


def linear_order(node: str, bases: dict[str, list[str]]) -> tuple[list[str], str]:
    """(order, certainty): most derived first, bases from right to left.

    A circle is cut where it closes: a base that is being worked on is left out. Where no
    consistent order exists, bases are walked in depth and each kept where it is met
    first; that order is ambiguous. Each contract is worked on once, and open ones lie on
    a list, so chains may be of any length.
    """
    done: dict[str, tuple[list[str], str]] = {}
    open_: set[str] = set()

    def visit(at: str) -> Generator[str, tuple[list[str], str], tuple[list[str], str]]:
        open_.add(at)
        declared = bases.get(at, [])
        right = [b for b in reversed(declared) if b not in open_]
        sure = len(right) == len(declared)
        parts = []
        for b in right:
            order, certainty = done[b] if b in done else (yield b)
            sure &= certainty == "certain"
            parts.append(order)
        open_.discard(at)
        tail = merge([*map(list, parts), right])
        if tail is None:
            tail, sure = list(dict.fromkeys(x for p in parts for x in p)), False
        done[at] = [at, *(x for x in tail if x != at)], "certain" if sure else "ambiguous"
        return done[at]

    work, found = [visit(node)], None
    while work:
        try:
            work.append(visit(work[-1].send(found)))
            found = None
        except StopIteration as end:
            work.pop()
            found = end.value
    return done[node]


def linearise(contracts: DataFrame, inherits: DataFrame) -> DataFrame:
    """LINEAR of each contract. ``inherits`` has idx, the bases' order of declaration.

    Each contract takes its ancestors' declarations along (the closure), so contracts
    are linearised apart from each other, on all machines.
    """
    up = ancestors(inherits).unionByName(contracts.select("id", F.col("id").alias("base"))).distinct()
    own = inherits.select(F.col("from_id").alias("base"), F.struct("idx", "to_id").alias("b")).groupBy("base").agg(F.sort_array(F.collect_list("b")).alias("bs"))
    table = up.join(own, "base").groupBy("id").agg(F.collect_list(F.struct("base", F.transform("bs", lambda b: b["to_id"]).alias("bs"))).alias("table"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for node, declared in zip(batch["id"], batch["table"], strict=True):
                bases = {} if declared is None else {d["base"]: list(d["bs"]) for d in declared}
                rows.append((node, *linear_order(node, bases)))
            yield pd.DataFrame(rows, columns=["id", "linearized", "certainty"])

    return contracts.select("id").join(table, "id", "left").mapInPandas(run, LINEAR)


def derived_from(linear: DataFrame) -> DataFrame:
    """(id, derived): the inverse of linear orders."""
    return linear.select(F.col("id").alias("derived"), F.explode("linearized").alias("id")).where("id <> derived")


def _common(linear: DataFrame, members: DataFrame) -> DataFrame | None:
    """(scope), materialised: the contracts that stand in most orders, as many as have SMALL_SIDE rows of ``members`` together; None if that is all."""
    orders = linear.select(F.explode("linearized").alias("scope")).groupBy("scope").agg(F.count("*").alias("orders"))
    load = materialise(members.groupBy("scope").agg(F.count("*").alias("rows")).join(orders, "scope").select("scope", "rows", F.floor(F.log2("orders")).alias("size")))
    held, least = 0, None
    for r in sorted(load.groupBy("size").agg(F.sum("rows").alias("rows")).collect(), key=lambda r: -r["size"]):
        held += r["rows"]
        if held > SMALL_SIDE:
            return load.where(F.col("size") >= least).select("scope") if least is not None else load.limit(0).select("scope")
        least = r["size"]
    return None


def along(chain: DataFrame, linear: DataFrame, members: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """``chain``, rows of orders by (scope, *more), with the ``members`` of each row's contract.

    Few contracts stand in most orders: their members are broadcast, and only the rows of the others are shuffled.
    """
    on, common = ["scope", *more], _common(linear, members)
    if common is None:
        return chain.join(F.broadcast(members), on)
    ids = F.broadcast(common)
    near, far = members.join(ids, "scope", "left_semi"), members.join(ids, "scope", "left_anti")
    return chain.join(F.broadcast(near), on).unionByName(chain.join(ids, "scope", "left_anti").join(far.hint("merge"), on))


def inherited_members(linear: DataFrame, members: DataFrame) -> DataFrame:
    """(contract, depth, member columns): along each order, the first member of each kind, name and signature.

    ``members`` has (id, scope, kind, name, sig).
    """
    chain = linear.select(F.col("id").alias("contract"), F.posexplode("linearized").alias("depth", "scope"))
    row = F.struct("depth", *members.columns)
    best = along(chain, linear, members).groupBy("contract", "kind", "name", "sig").agg(F.min_by(row, "depth").alias("m"))
    return best.select("contract", "m.*")


def fully_implemented(contracts: DataFrame, linear: DataFrame, members: DataFrame) -> DataFrame:
    """(id, is_fully_implemented): the first function of each name and signature has a body; interfaces are not, constructors do not count."""
    chain = linear.select(F.col("id").alias("contract"), F.posexplode("linearized").alias("depth", "scope"))
    own = along(chain, linear, members.where("kind = 'Function' and subkind <> 'constructor'").select("scope", "name", "sig", "has_body"))
    first = own.groupBy("contract", "name", "sig").agg(F.min(F.col("depth") * 4 + F.coalesce(F.col("has_body").cast("int"), F.lit(2))).alias("first"))  # a number is a buffer in place, a row would be sorted for
    by = first.groupBy(F.col("contract").alias("id")).agg(F.every(F.col("first") % 4 != 0).alias("all"))
    return contracts.join(by, "id", "left").select("id", (F.coalesce("all", F.lit(True)) & (F.col("contract_kind") != "interface")).alias("is_fully_implemented"))


def overrides(linear: DataFrame, members: DataFrame) -> DataFrame:
    """(from_id, to_id, kind): members that an ancestor has too; one without a body is implemented. What one contract alone declares has no counterpart.

    Names stand as numbers, and a contract's order comes to its members as one row, so pairs of a member and an ancestor are not shuffled but for those of rare ancestors.
    """
    key = ["kind", "name", "sig"]
    again = materialise(members.groupBy(*key).agg(F.min("scope").alias("_a"), F.max("scope").alias("_b")).where("_a <> _b").select(*key, F.monotonically_increasing_id().alias("code")))
    takes = (F.col("kind") == "Function") & (F.col("subkind") != "constructor")
    coded = materialise(members.join(F.broadcast(again) if again.count() <= SMALL_SIDE else again, key).select("id", "scope", "code", "has_body", takes.alias("takes")))
    own = coded.where("takes").select("scope", "code", F.col("id").alias("from_id")).join(linear.select(F.col("id").alias("scope"), "linearized").hint("merge"), "scope")
    chain = own.select("from_id", "code", F.posexplode("linearized").alias("pos", "scope")).where("pos > 0")
    hit = along(chain, linear, coded.select("scope", "code", F.col("id").alias("to_id"), F.col("has_body").alias("base_body")), ("code",))
    return hit.select("from_id", "to_id", F.when(F.col("base_body"), "overrides").otherwise("implements").alias("kind"))
