"""Sharding by a hierarchical weighted hash tree (native).

Regions hold racks and racks hold shards, each with a weight; an inner node weighs
what its shards weigh. A document descends from level to level: each child of where it
stands draws an exponential variate, -ln(u) / weight with u hashed from the document
and the child's own name, and the least draw wins. Only what is below the winner is
looked at next, so a document costs a hash for each child along one path.

A draw depends on nothing but the document, the node's name and its weight. If a
shard's weight changes, so do those of its rack and region, and documents move into or
out of these subtrees only; within the other racks and regions nothing moves. A shard
that is added opens a region of its own: no other node's weight changes, and it takes
documents only into itself, however many were added before it (law ``key``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_checked, materialise, text_or_empty

ROWS_PER_BUCKET = 16_384


@dataclass(frozen=True)
class Node:
    name: str
    weight: float = 1.0
    children: tuple["Node", ...] = ()
    shard: int = -1

    @property
    def load(self) -> float:
        return sum(c.load for c in self.children) if self.children else self.weight


def tree(shards: int, racks_per_region: int = 2, shards_per_rack: int = 4, weights: dict[int, float] | None = None, planned: int | None = None) -> Node:
    """The ``planned`` first shards, if not all, fill racks and racks fill regions, in order; each later one is a region of its own."""
    planned = shards if planned is None else planned
    per = racks_per_region * shards_per_rack
    regions: dict[str, dict[str, list[Node]]] = {}
    for i in range(shards):
        region, rack = (f"region{i // per}", f"rack{i // shards_per_rack % racks_per_region}") if i < planned else (f"added{i}", "rack0")
        regions.setdefault(region, {}).setdefault(rack, []).append(Node(f"{region}/{rack}/shard{i}", (weights or {}).get(i, 1.0), (), i))
    return Node("root", children=tuple(Node(r, children=tuple(Node(f"{r}/{k}", children=tuple(leaves)) for k, leaves in racks.items())) for r, racks in regions.items()))


def _levels(root: Node) -> list[list[list[Node]]]:
    """For each level, the live children of each live node of it; the last level's children are shards."""
    out, nodes = [], [root]
    while nodes[0].children:
        out.append([[c for c in node.children if c.load > 0] for node in nodes])
        nodes = [c for children in out[-1] for c in children]
    return out


def shard_of(key: Column, root: Node) -> Column:
    """The shard that ``key`` descends to; of equal draws the first child's wins. All rows with a null key share one shard.

    All leaves are at one depth.
    """
    at = F.lit(0)
    for level in _levels(root):
        number, rows = 0, []
        for children in level:
            rows.append(F.array(*(F.struct(F.lit(c.name).alias("name"), F.lit(float(c.load)).alias("load"), F.lit(c.shard if c.shard >= 0 else number + i).alias("to")) for i, c in enumerate(children))))
            number += len(children)
        u = lambda c: (F.shiftrightunsigned(F.xxhash64(c["name"], key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        drawn = F.transform(F.get(F.array(*rows), at), lambda c: F.struct((-F.log(u(c)) / c["load"]).alias("d"), c["to"].alias("to")))  # noqa: B023
        at = F.array_min(drawn)["to"]
    return at


def assign_slots(rows: DataFrame, shard: str = "shard", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds slot, gapless from 0 in each shard. ``rows`` is materialised and has a unique ``rid``.

    A shard is numbered in buckets of about ``rows_per_bucket`` rows, each with the
    count of the buckets before it, so no task sorts a whole shard.
    """
    buckets = max(1, -(-rows.count() // rows_per_bucket))
    keyed = rows.withColumn("_b", F.pmod(F.xxhash64("rid"), F.lit(buckets)))
    counts = keyed.groupBy(shard, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(counts.select(shard, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o")))
    inside = F.row_number().over(Window.partitionBy(shard, "_b").orderBy("rid"))
    numbered = keyed.withColumn("_i", inside - 1)
    return join_checked(numbered, offsets, [shard, "_b"], "inner").withColumn("slot", F.col("_o") + F.col("_i")).drop("_b", "_i", "_o")


def shard_documents(docs: DataFrame, shards: int = 16, planned: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: a row per document, law ``key``.

    The tree was laid out for ``planned`` shards, or ``shards`` if it is not given; later
    ones are regions of their own, and so is the one more that grown_shard tells of.

    Size is the text's UTF-8 bytes plus 1, of the whole text; a null text has none.
    Repeated rows, and all rows without a doc_id, go to one shard, in slots of their
    own. Further columns are ignored; no rows give no rows.
    """
    binary = F.encode(text_or_empty(), "UTF-8")
    placed = docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", (F.length(binary) + 1).cast("long").alias("size"), F.crc32(binary).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), tree(shards, planned=planned)).alias("shard"), shard_of(F.col("doc_id"), tree(shards + 1, planned=planned or shards)).alias("grown_shard"),
    )
    return assign_slots(materialise(placed)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
