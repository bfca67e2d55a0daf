"""Circles of a graph as components, and layers: the longest way to a node from where nothing comes in."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise
from .closure import SMALL_INDEX

LAYERED = "id string, layer int, component string"


def strong(out: dict[str, list[str]]) -> list[list[str]]:
    """Nodes by the circles they share, each after all that it reaches; open nodes lie on a list, so ways may be of any length."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    held, inside, found = [], set(), []
    for start in list(out):
        work = [(start, iter(out[start]))] if start not in index else []
        while work:
            at, rest = work[-1]
            if at not in index:
                index[at] = low[at] = len(index)
                held.append(at)
                inside.add(at)
            to = next((n for n in rest if n not in index or n in inside), None)
            if to is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[at])
                if low[at] == index[at]:
                    own = [held.pop()]
                    while own[-1] != at:
                        own.append(held.pop())
                    found.append(own)
                    inside.difference_update(own)
            elif to in index:
                low[at] = min(low[at], index[to])
            else:
                work.append((to, iter(out.get(to, ()))))
    return found


def _layered_small(arcs: DataFrame) -> DataFrame:
    """LAYERED of the nodes of few arcs, in one task; the component is null where there is no circle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = defaultdict(list)
        for b in batches:
            for src, dst in zip(b["src"], b["dst"], strict=True):
                out[src].append(dst)
        groups = strong(out)
        of = {i: n for n, ids in enumerate(groups) for i in ids}
        level, rows = [0] * len(groups), []
        for n in reversed(range(len(groups))):
            name = min(groups[n]) if len(groups[n]) > 1 else None
            for i in groups[n]:
                rows.append((i, level[n], name))
                for to in out.get(i, ()):
                    if of[to] != n:
                        level[of[to]] = max(level[of[to]], level[n] + 1)
        yield pd.DataFrame(rows, columns=["id", "layer", "component"])

    return materialise(arcs.coalesce(1).mapInPandas(run, LAYERED))


def _trimmed(arcs: DataFrame) -> DataFrame:
    """Arcs whose ends both have arcs in and out, as long as that takes any away and they are many."""
    left = arcs.count()
    while left > SMALL_INDEX:
        starts, ends = arcs.select(F.col("src").alias("dst")).distinct(), arcs.select(F.col("dst").alias("src")).distinct()
        arcs = materialise(arcs.join(ends, "src", "left_semi").join(starts, "dst", "left_semi").select("src", "dst"))
        had, left = left, arcs.count()
        if left == had:
            break
    return arcs


def _coloured(arcs: DataFrame) -> DataFrame:
    """(id, colour): the least id that reaches a node."""
    known = materialise(arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("colour", F.col("id")))
    frontier = known
    while not frontier.isEmpty():
        sent = frontier.join(arcs, frontier["id"] == arcs["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("_new"))
        known = materialise(known.join(sent, "id", "left").select("id", F.least("colour", "_new").alias("colour"), F.coalesce(F.col("_new") < F.col("colour"), F.lit(False)).alias("grew")))
        frontier, known = known.where("grew").drop("grew"), known.drop("grew")
    return known


def _joined(pairs: DataFrame) -> DataFrame:
    """(id, colour): the least id that a node is joined with, by arcs that each lead both ways."""
    known = materialise(pairs.groupBy(F.col("src").alias("id")).agg(F.least(F.col("src"), F.min("dst")).alias("colour")))
    grew = True
    while grew:
        sent = pairs.join(known.toDF("dst", "_c"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("_c").alias("_new"))
        ahead = known.toDF("colour", "_ahead")  # a colour is a node too, whose own is as good
        step = known.join(sent, "id").join(ahead, "colour").select("id", F.least("colour", "_new", "_ahead").alias("_now"), "colour")
        step = materialise(step)
        grew, known = not step.where("_now <> colour").isEmpty(), step.select("id", F.col("_now").alias("colour"))
    return known


def components(arcs: DataFrame) -> DataFrame:
    """(id, component): nodes on circles of (src, dst), each under the least id of its component; other nodes have no row.

    What lies on no circle is trimmed, and nodes that arcs join both ways are drawn together, which makes others meet;
    when few arcs are left, one task finds their circles. Where no two nodes are joined both ways, each takes the least
    id that reaches it, and what reaches that id back within its colour is a component; without these, it begins again.
    """
    rest = _trimmed(materialise(arcs.select("src", "dst").where("src <> dst").distinct()))
    drawn, found = None, None  # (id, colour): into what a node was drawn, and by colour its circle
    left = rest.count()
    while left > SMALL_INDEX:
        pairs = materialise(rest.join(rest.toDF("dst", "src"), ["src", "dst"], "left_semi").select("src", "dst"))
        if pairs.isEmpty():
            break
        into = _joined(pairs)
        drawn = materialise(into if drawn is None else _renamed(drawn, into, "colour").unionByName(into.join(drawn, "id", "left_anti")))
        named = _renamed(_renamed(rest, into, "src"), into, "dst")
        rest = _trimmed(materialise(named.where("src <> dst").distinct()))
        left = rest.count()
    if 0 < left <= SMALL_INDEX:
        found = _layered_small(rest).where("component is not null").select("id", F.col("component").alias("colour"))
    elif left:
        found = _by_colours(rest)
    if drawn is not None and found is not None:
        found = _renamed(drawn, found, "colour").unionByName(found.join(drawn, "id", "left_anti"))
    found = drawn if found is None else found
    if found is None:
        return arcs.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    found = materialise(found.select("id", F.col("colour").alias("component")))
    return found.join(found.groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1").select("component"), "component", "left_semi").select("id", "component")


def _renamed(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """``rows`` with the colour of ``names`` (id, colour) in place of an id that has one."""
    joined = rows.join(names.toDF(column, "_to"), column, "left")
    return joined.select(*(F.coalesce("_to", c).alias(c) if c == column else c for c in rows.columns))


def _by_colours(rest: DataFrame) -> DataFrame:
    """(id, colour) of nodes on circles, and of some that are their own colour alone."""
    found = None
    while not rest.isEmpty():
        colours = _coloured(rest)
        inner = rest.join(colours.toDF("src", "_a"), "src").join(colours.toDF("dst", "_b"), "dst").where("_a = _b").select("src", "dst")
        inner = materialise(inner)
        known = materialise(colours.where("id = colour"))
        frontier = known
        while not frontier.isEmpty():
            back = inner.join(frontier.select(F.col("id").alias("dst"), "colour"), "dst").select(F.col("src").alias("id"), "colour").distinct()
            frontier = materialise(back.join(known, "id", "left_anti"))
            known = materialise(known.unionByName(frontier))
        found = known if found is None else found.unionByName(known)
        gone = known.select("id")
        rest = _trimmed(materialise(rest.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst")))
    return found


def _peeled(nodes: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, layer), arcs left): a round takes the nodes that no arc of the rest enters, and the arcs that leave them."""
    rest, layer = arcs, 0
    ready = materialise(nodes.join(rest.select(F.col("dst").alias("id")), "id", "left_anti"))
    done = ready.withColumn("layer", F.lit(0))
    while not ready.isEmpty() and not rest.isEmpty():
        layer += 1
        leaving = rest.join(ready.select(F.col("id").alias("src"), F.lit(True).alias("_go")), "src", "left")
        marked = materialise(leaving.select("src", "dst", F.col("_go").isNotNull().alias("gone")))
        rest = marked.where("not gone").select("src", "dst")
        ready = materialise(marked.groupBy(F.col("dst").alias("id")).agg(F.bool_and("gone").alias("free")).where("free").select("id"))
        done = done.unionByName(ready.withColumn("layer", F.lit(layer)))
    return done, rest


def layers(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, layer), see layered."""
    return layered(nodes, arcs).select("id", "layer")


def layered(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """LAYERED of all nodes: arcs lead to higher layers, but for those of a circle, whose nodes share one; the component is null off circles.

    The number of the round that takes a node is its layer, so rounds are as many as the longest way. Where circles keep
    the rounds from ending, they are drawn together to a node each, and the rounds begin anew. Few arcs are walked in one task.
    """
    own = nodes.select("id").distinct()
    plain = materialise(arcs.select("src", "dst").where("src <> dst").distinct())
    if plain.count() <= SMALL_INDEX:
        return materialise(own.join(_layered_small(plain), "id", "left").select("id", F.coalesce("layer", F.lit(0)).alias("layer"), "component"))
    done, stuck = _peeled(own, plain)
    if stuck.isEmpty():
        return materialise(done.withColumn("component", F.lit(None).cast("string")))
    circles = materialise(components(stuck))
    names = circles.withColumnRenamed("component", "colour")
    drawn = _renamed(_renamed(plain, names, "src"), names, "dst").where("src <> dst").distinct()
    group = materialise(own.join(circles, "id", "left").select("id", "component", F.coalesce("component", "id").alias("_own")))
    done, _ = _peeled(group.select(F.col("_own").alias("id")).distinct(), materialise(drawn))
    return materialise(group.join(done.toDF("_own", "layer"), "_own").select("id", "layer", "component"))
