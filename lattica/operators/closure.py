"""Traversals and fixpoints over call edges.

A fixpoint is a driver loop of joins: the frontier meets the index, known nodes are
taken out by an anti join, and each round's frontier is written down so that plans
stay short. The index is written once and counted; where it is small, one task walks
it in memory instead, and both ways give the same rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise
from ..schema import CALL_KINDS, EXTERNAL_SUBKINDS, kind_is

#: Up to so many index rows a closure runs in one task.
SMALL_INDEX = 50_000

#: Up to so many ids may be broadcast in a round.
SMALL_SIDE = 200_000


def call_index(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(src, dst, edge_id, virtual): call edges and their virtual arms, one row per hop."""
    calls = edges.where(kind_is(*CALL_KINDS))
    direct = calls.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.col("id").alias("edge_id"), F.lit(False).alias("virtual"))
    if "possible_targets" not in edges.columns:
        return direct
    arms = calls.select("from_id", "to_id", "id", F.explode("possible_targets").alias("t")).where("t != to_id")
    if nodes is not None:
        arms = arms.join(nodes.select(F.col("id").alias("t")), "t", "left_semi")
    return direct.unionByName(arms.select(F.col("from_id").alias("src"), F.col("t").alias("dst"), F.col("id").alias("edge_id"), F.lit(True).alias("virtual")))


def traverse(index: DataFrame, origin: str, direction: str = "callees", depth: int | None = None) -> DataFrame:
    """(id, depth, via): nodes within ``depth`` hops of ``origin``, which is not among them.

    ``via`` is a shortest route as an array of hops; of several, the least by hop ids.
    """
    index = materialise(index)
    here, there = ("src", "dst") if direction == "callees" else ("dst", "src")
    hops = index.select(F.col(here).alias("at"), F.col(there).alias("id"), F.struct("src", "dst", "edge_id", "virtual").alias("hop"))
    if index.count() <= SMALL_INDEX:
        return _walk_small(hops, origin, depth)
    spark = index.sparkSession
    empty = F.array().cast("array<struct<src:string,dst:string,edge_id:string,virtual:boolean>>")
    seen = materialise(spark.createDataFrame([(origin,)], "id string").select("id", F.lit(0).alias("depth"), empty.alias("via")))
    frontier, level, parts = seen, 0, [seen]
    while depth is None or level < depth:
        level += 1
        step = frontier.select(F.col("id").alias("at"), "via").join(hops, "at").select("id", F.concat("via", F.array("hop")).alias("via"))
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        fresh = step.join(known.select("id"), "id", "left_anti").groupBy("id").agg(F.min("via").alias("via"))
        frontier = materialise(fresh.select("id", F.lit(level).alias("depth"), "via"))
        if frontier.isEmpty():
            break
        parts.append(frontier)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("depth > 0")


def _walk_small(hops: DataFrame, origin: str, depth: int | None) -> DataFrame:
    """The same walk in one task, by adjacency lists."""
    schema = "id string, depth int, via array<struct<src:string,dst:string,edge_id:string,virtual:boolean>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = defaultdict(list)
        for b in batches:
            for row in b[["at", "id", "src", "dst", "edge_id", "virtual"]].itertuples(index=False, name=None):
                out[row[0]].append(row[1:])
        seen, frontier, level = {origin: []}, [origin], 0
        found = []
        while frontier and (depth is None or level < depth):
            level += 1
            best: dict = {}
            for at in frontier:
                for to, *hop in out[at]:
                    if to not in seen:
                        via = [*seen[at], tuple(hop)]
                        if to not in best or via < best[to]:
                            best[to] = via
            seen |= best
            frontier = sorted(best)
            found += [(i, level, [dict(zip(("src", "dst", "edge_id", "virtual"), h, strict=True)) for h in best[i]]) for i in frontier]
        yield pd.DataFrame(found, columns=["id", "depth", "via"])

    flat = hops.select("at", "id", "hop.src", "hop.dst", "hop.edge_id", "hop.virtual")
    return flat.coalesce(1).mapInPandas(run, schema)


def reachable_from(index: DataFrame, origin: str) -> DataFrame:
    return traverse(index, origin, "callees")


def call_path(index: DataFrame, start: str, end: str) -> list | None:
    """One shortest path as hops; [] from a node to itself, None if there is none."""
    if start == end:
        return []
    row = reachable_from(index, start).where(F.col("id") == end).first()
    return None if row is None else [h.asDict() for h in row["via"]]


def closure(pairs: DataFrame, arcs: DataFrame, rounds: int | None = None) -> DataFrame:
    """(origin, id) closed over arcs (src, dst): semi-naive, each round joins only what the last one added."""
    arcs = materialise(arcs.select("src", "dst").distinct())
    if rounds is None and arcs.count() <= SMALL_INDEX:
        return _closure_small(pairs, arcs)
    frontier = materialise(pairs.select("origin", "id").distinct())
    parts, n, fresh = [frontier], 0, frontier.count()
    rows, held = fresh, _held(arcs, arcs.count())
    while fresh and (rounds is None or n < rounds):
        n += 1
        step = frontier.join(held, frontier["id"] == held["src"]).select("origin", F.col("dst").alias("id")).distinct()
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        frontier = materialise(step.join(_held(known, rows), ["origin", "id"], "left_anti"))
        fresh = frontier.count()
        rows += fresh
        parts.append(frontier)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _closure_small(pairs: DataFrame, arcs: DataFrame) -> DataFrame:
    """Origins are dealt out; each task walks the arcs, which fit its memory, for its own origins."""
    shared = pairs.sparkSession.sparkContext.broadcast([tuple(r) for r in arcs.select("src", "dst").collect()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = defaultdict(list)
        for a, b in shared.value:
            out[a].append(b)
        for batch in batches:
            rows = []
            for origin, at in zip(batch["origin"], batch["id"], strict=True):
                seen, todo = {at}, [at]
                while todo:
                    for nxt in out.get(todo.pop(), ()):
                        if nxt not in seen:
                            seen.add(nxt)
                            todo.append(nxt)
                rows += [(origin, i) for i in seen]
            yield pd.DataFrame(rows, columns=["origin", "id"])

    return pairs.select("origin", "id").distinct().mapInPandas(run, "origin string, id string").distinct()


def close_over_callers(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id): seeds and whatever reaches one over the static targets of calls edges."""
    return reached(seeds, edges.where("kind = 'calls'").select(F.col("to_id").alias("src"), F.col("from_id").alias("dst")))


def _held(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join that may be broadcast only where its rows are few."""
    return df if rows <= SMALL_SIDE else df.hint("merge")


def reached(seeds: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id): seeds and whatever they reach over arcs (src, dst), without the ways; broadcasts follow a count."""
    arcs, frontier = materialise(arcs.select("src", "dst").distinct()), materialise(seeds.select("id").distinct())
    if arcs.count() <= SMALL_INDEX:
        return _reach_small(frontier, arcs)
    known, rows, fresh = frontier, 0, frontier.count()
    while fresh:
        rows += fresh
        step = arcs.join(_held(frontier, fresh).withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
        frontier = materialise(step.join(_held(known, rows), "id", "left_anti"))
        fresh = frontier.count()
        known = known.unionByName(frontier)
    return known


def _reach_small(seeds: DataFrame, arcs: DataFrame) -> DataFrame:
    both = seeds.select(F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(arcs.select(F.col("src").alias("a"), F.col("dst").alias("b")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, seen = defaultdict(list), set()
        for batch in batches:
            for a, b in zip(batch["a"], batch["b"], strict=True):
                if b is None:
                    seen.add(a)
                else:
                    out[a].append(b)
        todo = list(seen)
        while todo:
            for nxt in out.get(todo.pop(), ()):
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        yield pd.DataFrame({"id": pd.Series(sorted(seen), dtype=object)})

    return both.coalesce(1).mapInPandas(run, "id string")


def direct_external_callers(edges: DataFrame) -> DataFrame:
    return edges.where((F.col("kind") == "calls") & F.col("subkind").isin(*EXTERNAL_SUBKINDS)).select(F.col("from_id").alias("id")).distinct()
