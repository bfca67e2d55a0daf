"""Reachability by sets: which of many origins reach each node, as bitmaps.

Origins are numbered without gaps within a partition, so they fill chunks of 32,768
numbers, and a node's set is a bitmap for each chunk that it has any of. A round sends
the bits a node gained along its arcs, unites what arrives, and goes on with the nodes
whose sets grew; circles end with the growth. Neither pairs of origin and node nor
arrays of origins are made, and a step costs one word operation for 64 origins.

Where only numbers are asked for, not sets, ``Counts`` does without either: what goes
through one of a few hubs is counted by classes of nodes, and pairs are made only of
what goes through none of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialise
from .closure import SMALL_INDEX, SMALL_SIDE, _closure_small, _held
from .layers import strong

#: Arcs for each part that seeds are taken from, which are 64 at least and at most so many.
ARCS_A_PART, MOST_PARTS = 3_000, 7_000

#: Words of 64 hubs, and the share of the nodes, one in so many, whose square of pairs a hub has to save.
MOST_WORDS, LEAST_PART = 48, 100_000

#: Nodes, squared, that a hub of a later search has to save at least.
LEAST_LATER = 64

#: Up to so many arcs between numbers a search ends in one task.
FEW_ARCS = 1_000_000

#: Ways between seeds, of each, that are looked at.
TIES_A_SEED = 32


def numbered(origins: DataFrame) -> DataFrame:
    """(id, number): distinct ids by numbers that fill chunks, materialised."""
    return materialise(origins.select("id").distinct().withColumn("number", F.monotonically_increasing_id()))


def origin_sets(origins: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, chunk, bits): for each node that an origin (id, number) reaches over arcs (src, dst), itself included, the bitmaps of those that do."""
    arcs = materialise(arcs.select("src", "dst").distinct())
    own = origins.select("id", F.bitmap_bucket_number("number").alias("chunk"), F.bitmap_bit_position("number").alias("at"))
    known = materialise(own.groupBy("id", "chunk").agg(F.bitmap_construct_agg("at").alias("bits")))
    frontier = known
    while not frontier.isEmpty():
        step = frontier.join(arcs, frontier["id"] == arcs["src"]).groupBy(F.col("dst").alias("id"), "chunk").agg(F.bitmap_or_agg("bits").alias("bits"))
        both = known.select("id", "chunk", "bits", F.bitmap_count("bits").alias("had"), F.lit(False).alias("new")).unionByName(step.select("id", "chunk", "bits", F.lit(0).cast("long").alias("had"), F.lit(True).alias("new")))
        merged = both.groupBy("id", "chunk").agg(F.bitmap_or_agg("bits").alias("bits"), F.max("had").alias("had"))
        merged = materialise(merged.withColumn("grew", F.bitmap_count("bits") > F.col("had")))
        known, frontier = merged.select("id", "chunk", "bits"), merged.where("grew").select("id", "chunk", "bits")
    return known


def set_sizes(sets: DataFrame) -> DataFrame:
    """(id, origins): how many origins reach each node that any reaches."""
    return sets.groupBy("id").agg(F.sum(F.bitmap_count("bits")).alias("origins"))


def reached_by(sets: DataFrame, origins: DataFrame) -> DataFrame:
    """(id) of nodes that any of ``origins`` (number) reaches: their bits, united by chunk, meet the sets."""
    asked = origins.groupBy(F.bitmap_bucket_number("number").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("ask"))
    both = sets.join(asked, "chunk")
    united = both.select("id", "chunk", "bits", F.lit(0).alias("side")).unionByName(both.select("id", "chunk", F.col("ask").alias("bits"), F.lit(1).alias("side")))
    each = united.groupBy("id", "chunk").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("all"), F.sum(F.bitmap_count("bits")).alias("apart"))
    return each.where("all < apart").select("id").distinct()


def _hubs(arcs: DataFrame, parts: int) -> DataFrame:
    """(id, ways): of each part of the nodes, dealt by hash, the one with the most ways through it, and two others that ways lead through."""
    ends = arcs.select(F.col("src").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(arcs.select(F.col("dst").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    ways = ends.groupBy("id").agg((F.sum("out") * F.sum("in")).alias("ways")).where("ways > 0")
    own = F.struct("id", "ways")
    chosen = F.array(F.max_by(own, "ways"), *(F.min_by(own, F.xxhash64("id", F.lit(i))) for i in (1, 2)))
    return ways.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(chosen.alias("x")).select(F.explode("x").alias("x")).select("x.id", "x.ways").distinct()


def _out(nodes: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, to): by places in ``nodes``, sorted, where a node's arcs begin among all, and whereto each leads."""
    order = np.argsort(src, kind="stable")
    return np.searchsorted(src[order], np.append(nodes, np.iinfo(np.int64).max)), np.searchsorted(nodes, dst[order])


def _arcs_of(at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, arc) of all arcs that leave the places ``at``."""
    n = first[at + 1] - first[at]
    return np.repeat(at, n), np.repeat(first[at] - np.append(0, n.cumsum()[:-1]), n) + np.arange(n.sum())


def _claimed_few(frontier: DataFrame, late: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, colour): what the rest of a search over few arcs claims, in one task; ``late`` is known."""
    rows = arcs.select(F.lit(0).alias("what"), "src", "dst").unionByName(frontier.toDF("src", "dst").withColumn("what", F.lit(1))).unionByName(late.toDF("src", "dst").withColumn("what", F.lit(2)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = pd.concat(list(batches))
        (src, dst), (start, own), (had, _) = ((x["src"].to_numpy(), x["dst"].to_numpy()) for x in (all_[all_["what"] == i] for i in range(3)))
        nodes = np.unique(np.concatenate([src, dst, start, had]))
        first, to = _out(nodes, src, dst)
        seen, colour = np.isin(nodes, np.concatenate([start, had])), np.zeros(len(nodes), dtype=np.int64)
        at = np.searchsorted(nodes, start)
        colour[at] = own
        while len(at):
            by, arc = _arcs_of(at, first)
            fresh = ~seen[to[arc]]
            at, one = np.unique(to[arc][fresh], return_index=True)
            colour[at], seen[at] = colour[by[fresh][one]], True
            yield pd.DataFrame({"id": nodes[at], "colour": colour[at]})

    return rows.coalesce(1).mapInPandas(run, "id long, colour long")


def _grown_few(known: DataFrame, arcs: DataFrame, names: list[str]) -> DataFrame:
    """The same bits as by rounds, over few arcs in one task."""
    none = [F.lit(0).cast("long").alias(c) for c in names[1:]]
    rows = arcs.select(F.lit(True).alias("arc"), "src", F.col("dst").alias("_w"), *none).unionByName(known.select(F.lit(False).alias("arc"), F.col("id").alias("src"), F.col(names[0]).alias("_w"), *names[1:]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = pd.concat(list(batches))
        arcs_, own = all_[all_["arc"]], all_[~all_["arc"]].sort_values("src")
        nodes, bits = own["src"].to_numpy(), own[["_w", *names[1:]]].to_numpy(copy=True)
        arcs_ = arcs_[np.isin(arcs_["src"], nodes)]  # what they lead to is known then, too
        first, to = _out(nodes, arcs_["src"].to_numpy(), arcs_["_w"].to_numpy())
        at = np.arange(len(nodes))
        while len(at):
            by, arc = _arcs_of(at, first)
            had = bits.copy()
            np.bitwise_or.at(bits, to[arc], had[by])
            at = np.flatnonzero((bits != had).any(axis=1))
        yield pd.DataFrame({"id": nodes} | {c: bits[:, i] for i, c in enumerate(names)})

    return rows.coalesce(1).mapInPandas(run, ", ".join(["id long", *(f"{c} long" for c in names)]))


def _claimed(seeds: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, colour): what seeds (id, colour) reach over arcs, each node under one that reaches it; arcs to known nodes are taken out when these are many."""
    known = late = frontier = seeds
    rows = recent = seeds.count()
    left = arcs.count()
    while rows:
        if recent > min(SMALL_SIDE, left // 8) and left > FEW_ARCS:
            arcs = materialise(arcs.join(_held(late.select(F.col("id").alias("dst")), recent), "dst", "left_anti").select("src", "dst"))
            left, late, recent = arcs.count(), late.limit(0), 0
        if left <= FEW_ARCS:
            return known.unionByName(materialise(_claimed_few(frontier, late, arcs)))
        step = arcs.join(_held(frontier.toDF("src", "colour"), rows), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("colour"))
        frontier = materialise(step.join(late.select("id"), "id", "left_anti"))
        rows = frontier.count()
        known, late, recent = known.unionByName(frontier), late.unionByName(frontier) if recent else frontier, recent + rows
    return known


def _long(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _first_bits(claimed: DataFrame, seeds: DataFrame, least: int, words: int) -> tuple[DataFrame, list[str]] | None:
    """((id, names), names): by claims, hubs that reach a node (even id) and that it reaches (odd id), as bits of long columns; None without hubs.

    A node that one seed claims onwards and another backwards is a way between them. Seeds on a circle of such ways are one
    hub; the hubs that save the most pairs get a bit. A way that is not known here costs a later round, and no number.
    """
    sides = [F.max(F.when(F.col("id") % 2 == i, F.col("colour"))).alias(c) for i, c in enumerate(("above", "below"))]
    marks = materialise(claimed.groupBy(F.expr("shiftright(id, 1)").alias("node")).agg(*sides).where("above is not null and below is not null"))
    few = Window.partitionBy("above").orderBy(F.xxhash64("above", "below"))
    ties = marks.where("above <> below").select("above", "below").distinct().withColumn("_i", F.row_number().over(few)).where(F.col("_i") <= TIES_A_SEED)
    out: dict[int, list[int]] = {r["colour"]: [] for r in seeds.select("colour").distinct().collect()}
    for r in ties.select("above", "below").collect():
        out[r["above"]].append(r["below"])
    groups = strong(out)
    of = {c: i for i, group in enumerate(groups) for c in group}
    spark = claimed.sparkSession
    named = spark.createDataFrame(list(of.items()), "colour long, hub int")
    both = marks.join(F.broadcast(named.toDF("above", "_a")), "above").join(F.broadcast(named.toDF("below", "_b")), "below").where("_a = _b")
    gain = {r["_a"]: r["n"] ** 2 for r in both.groupBy("_a").agg(F.count("*").alias("n")).collect()}
    for r in seeds.select("colour", "ways").distinct().collect():
        gain[of[r["colour"]]] = max(gain.get(of[r["colour"]], 0), r["ways"])
    kept = sorted((i for i, n in gain.items() if n >= least**2), key=lambda i: (-gain[i], i))[: 64 * words]
    if not kept:
        return None
    bit = {g: 1 << i for i, g in enumerate(kept)}
    down, up = [bit.get(i, 0) for i in range(len(groups))], [bit.get(i, 0) for i in range(len(groups))]
    for i, group in enumerate(groups):  # each stands after all that it reaches
        for c in group:
            for to in out[c]:
                up[i] |= up[of[to]]
    for i in reversed(range(len(groups))):
        for c in groups[i]:
            for to in out[c]:
                down[of[to]] |= down[i]
    names = [f"w{i}" for i in range(-(-len(kept) // 64))]
    rows = [(c, side, *(_long(bits[i] >> 64 * w & (1 << 64) - 1) for w in range(len(names)))) for c, i in of.items() for side, bits in enumerate((down, up))]
    table = spark.createDataFrame(rows, ", ".join(["colour long", "side int", *(f"{c} long" for c in names)]))
    owned = claimed.withColumn("side", (F.col("id") % 2).cast("int"))
    return materialise(owned.join(F.broadcast(table), ["colour", "side"]).select("id", *names)), names


def _grown(known: DataFrame, arcs: DataFrame, names: list[str]) -> DataFrame:
    """(id, names): the bits of every node with those of all that reach it over arcs; a round goes on with what grew."""
    if arcs.count() <= FEW_ARCS:
        return materialise(_grown_few(known, arcs, names))
    sent = [f"_{c}" for c in names]
    frontier, rows, late, recent = known, known.count(), None, 0
    while rows:
        step = arcs.join(_held(frontier.toDF("src", *sent), rows), "src").groupBy(F.col("dst").alias("id")).agg(*(F.bit_or(c).alias(c) for c in sent))
        now = known if late is None else known.unionByName(late)
        met = now.join(F.broadcast(step) if rows * 8 <= SMALL_SIDE else step.hint("merge"), "id").groupBy("id").agg(*(F.bit_or(c).alias(c) for c in (*names, *sent)))
        grew = reduce(or_, (F.col(s).bitwiseAND(F.bitwise_not(c)) != 0 for c, s in zip(names, sent, strict=True)))
        frontier = materialise(met.where(grew).select("id", *(F.col(c).bitwiseOR(F.col(s)).alias(c) for c, s in zip(names, sent, strict=True))))
        rows = frontier.count()
        late, recent = frontier if late is None else late.unionByName(frontier), recent + rows
        if recent > SMALL_SIDE:
            known = materialise(known.unionByName(late).groupBy("id").agg(*(F.bit_or(c).alias(c) for c in names)))
            late, recent = None, 0
    return known if late is None else known.unionByName(late).groupBy("id").agg(*(F.bit_or(c).alias(c) for c in names))


def _meet(up: list[str], down: list[str]) -> Column:
    return reduce(or_, (F.col(u).bitwiseAND(F.col(d)) != 0 for u, d in zip(up, down, strict=True)))


class Counts:
    """How many nodes each origin reaches over arcs (src, dst), and how many origins reach each node, both themselves included.

    Hubs are large circles, or nodes that many ways lead through; which are taken changes the work, not the numbers. Of each node
    the hubs that it reaches (U) and that reach it (D) are bits. An origin whose U meets a node's D reaches it through a hub:
    such pairs are counted as products of classes of nodes with equal bits. What an origin reaches through no hub is followed
    pair by pair, and a pair ends where U and D meet, since they do so in all that lies behind it. In a graph whose large
    circles hold a hub each, few such pairs are left. Seeds, which stand all over the graph, find the circles: they claim
    nodes onwards and backwards, once each, and what one claims onwards and another backwards joins the two. A circle may hide
    another from its seeds; so what arcs are no known ways through hubs are searched again, until no worthwhile hub is left.
    Bits of a later search hold for its arcs alone: a way with any other arc goes through a hub known before.
    """

    def __init__(self, origins: DataFrame, arcs: DataFrame, words: int | None = None):
        arcs = materialise(arcs.select("src", "dst").where("src <> dst").distinct())
        origins = origins.select("id").distinct()
        ids = arcs.select(F.explode(F.array("src", "dst")).alias("id"), F.lit(False).alias("origin")).unionByName(origins.withColumn("origin", F.lit(True)))
        self._ids = materialise(ids.groupBy("id").agg(F.max("origin").alias("origin")).withColumn("node", F.monotonically_increasing_id()))
        nodes = self._ids.count()
        number = self._ids.select("id", "node").hint("merge")
        arcs = materialise(arcs.join(number.toDF("src", "_s"), "src").join(number.toDF("dst", "_d"), "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst")))
        self._u, self._d = ["u"], ["d"]
        self._nodes = self._ids.select("node", "origin", *(F.lit(0).cast("long").alias(c) for c in ("u", "d")))
        left, least = words or MOST_WORDS, max(2, nodes // LEAST_PART)
        while left > 0 and (found := self._bits(arcs, least, left)):
            least = max(least, LEAST_LATER)
            bits, names = found
            up, down = [f"u{len(self._u) + i}" for i in range(len(names))], [f"d{len(self._d) + i}" for i in range(len(names))]
            each = [F.bit_or(F.when(F.col("id") % 2 == i, F.col(c))).alias(n) for i, own in enumerate((down, up)) for c, n in zip(names, own, strict=True)]
            sides = bits.groupBy(F.expr("shiftright(id, 1)").alias("node")).agg(*each)
            self._nodes = materialise(self._nodes.join(sides.hint("merge"), "node", "left").na.fill(0))
            self._u, self._d, left = self._u + up, self._d + down, left - len(names)
            arcs = self._open(arcs)
        self._pairs = self._apart(self._open(arcs, *self._d))

    @staticmethod
    def _bits(arcs: DataFrame, least: int, words: int) -> tuple[DataFrame, list[str]] | None:
        """((id, names), names) of hubs of arcs: node n stands as 2n for what leads to it and as 2n + 1, with its arcs turned round, for what it leads to."""
        seeds = materialise(_hubs(arcs, min(MOST_PARTS, max(64, arcs.count() // ARCS_A_PART))))
        if seeds.isEmpty():
            return None
        turned = arcs.select((F.col("dst") * 2 + 1).alias("src"), (F.col("src") * 2 + 1).alias("dst"))
        ways = materialise(arcs.select((F.col("src") * 2).alias("src"), (F.col("dst") * 2).alias("dst")).unionByName(turned))
        start = materialise(seeds.select(F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("_x"), F.col("id").alias("colour")).toDF("id", "colour"))
        first = _first_bits(_claimed(start, ways), seeds.withColumnRenamed("id", "colour"), least, words)
        return first and (_grown(first[0], ways, first[1]), first[1])

    def _open(self, arcs: DataFrame, *more: str) -> DataFrame:
        """(src, dst, more): arcs that do not lead from what reaches a hub to what that hub reaches; all others are known ways through it."""
        ends = self._nodes.select(F.col("node").alias("src"), *self._u).hint("merge")
        to = arcs.join(self._nodes.select(F.col("node").alias("dst"), *self._d).hint("merge"), "dst").join(ends, "src")
        return materialise(to.where(~_meet(self._u, self._d)).select("src", "dst", *more))

    def _apart(self, to: DataFrame) -> DataFrame:
        """(origin, id): what origins reach through no hub, over open arcs with the bits of what they lead to."""
        if to.count() <= SMALL_INDEX:
            alone = self._nodes.where("origin").where(~_meet(self._u, self._d)).select(*(F.col("node").cast("string").alias(c) for c in ("origin", "id")))
            ends = self._nodes.select(F.col("node").alias("origin"), *self._u), self._nodes.select(F.col("node").alias("id"), *self._d)
            return materialise(_closure_small(alone, to.select(F.col("src").cast("string"), F.col("dst").cast("string"))).select(*(F.col(c).cast("long") for c in ("origin", "id"))).join(ends[0], "origin").join(ends[1], "id").where(~_meet(self._u, self._d)).select("origin", "id"))
        start = self._nodes.where("origin").where(~_meet(self._u, self._d))
        frontier = materialise(start.select(F.col("node").alias("origin"), F.col("node").alias("id"), *self._u))
        known, rows = frontier.select("origin", "id"), frontier.count()
        total = rows
        while rows:
            step = to.join(_held(frontier.withColumnRenamed("id", "src"), rows), "src").where(~_meet(self._u, self._d)).select("origin", F.col("dst").alias("id"), *self._u)
            frontier = materialise(step.dropDuplicates(["origin", "id"]).join(_held(known, total), ["origin", "id"], "left_anti"))
            rows = frontier.count()
            known, total = known.unionByName(frontier.select("origin", "id")), total + rows
        return known

    def _counted(self, of: DataFrame, own: list[str], by: DataFrame, other: list[str], key: str) -> DataFrame:
        """(id, n) of all of ``of``: those of ``by`` whose bits meet its own, and the pairs by ``key``."""
        classes, sizes = of.select(*own).distinct(), by.groupBy(*other).agg(F.count("*").alias("_n"))
        met = materialise(classes.crossJoin(sizes).where(_meet(own, other)).groupBy(*own).agg(F.sum("_n").alias("n")))
        far = of.join(met.hint("merge"), own).select("node", "n")
        near = self._pairs.groupBy(F.col(key).alias("node")).agg(F.count("*").alias("n"))
        both = far.unionByName(near).groupBy("node").agg(F.sum("n").alias("n"))
        return both.join(self._ids.select("node", "id").hint("merge"), "node").select("id", "n")

    def reached(self) -> DataFrame:
        """(origin, reached): how many nodes each origin reaches."""
        return self._counted(self._nodes.where("origin"), self._u, self._nodes, self._d, "origin").toDF("origin", "reached")

    def origins(self) -> DataFrame:
        """(id, origins): how many origins reach each node that any reaches."""
        return self._counted(self._nodes, self._d, self._nodes.where("origin"), self._u, "id").toDF("id", "origins")
