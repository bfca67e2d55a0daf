"""An interpolated modified Kneser-Ney model of characters, in shards by n-gram.

Symbols are code points as they are. The table holds every n-gram of the trusted
text up to ORDER characters, so it grows with that text; its counts, discounts and
probabilities are shuffled by n-gram. A symbol's cost is a sum of independent
entries: of each context that was seen, the bits of backing off from it, and of each
n-gram that was seen, the bits it differs by from backing off. All entries that an
n-gram of ORDER characters needs are in one part of the table, by the two characters
before its last: documents' n-grams are shuffled to their part, looked up there and
summed per document. No task, and not the driver, sees the whole table.

N-grams that many documents have are looked up once: those of a bounded sample of the
documents are asked for first, and what they cost is broadcast, FREQUENT n-grams at most.
The others are asked for where they occur. The result does not depend on the sample.
Among the frequent ones an n-gram is told by its slot and 31 bits of a hash, in a part
by 64 bits: of 2**31 n-grams that are not frequent about one is taken for another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ngrams
from .common import limit_batches, materialise, text_or_empty

ORDER = 5
#: Code points: what a character never seen is shared among.
ALPHABET = 0x110000
#: N-grams of a part of the table, which is in memory as a whole; n-grams that a task holds before it hands them on.
SHARD, HELD = 1_000_000, 500_000
#: Bytes of text worked on at once: each makes some 150 bytes of arrays for a while.
CHUNK = 1 << 17
#: Bytes of text whose open n-grams a part answers, about; n-grams that a task asks for at once, those in a row (a page of a file is 100 rows at least, and in memory whole), and those that a copy of a part answers.
PART_BYTES, ASK, AT_ONCE, PER_COPY = 64 << 20, 250_000, 10_000, 8_000_000
#: Documents whose n-grams say which are frequent, and how many of these every task has.
SAMPLE_DOCS, FREQUENT = 5_000, 250_000
#: Costs are summed in whole parts of a bit.
SCALE = 1 << 16
#: A discount is never less, or unseen n-grams would be impossible.
LEAST_DISCOUNT = 0.1
_X = [f"x{i}" for i in range(1, ORDER + 1)]
_P = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, ORDER, np.uint64) | np.uint64(1)
_C = np.uint64(0x9E3779B97F4A7C15)
_LOW, _LOW2 = (1 << 21) - 1, (1 << 42) - 1


def _symbols(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, places, lengths): code points of consecutive texts, each led by ORDER symbols 0, the place of each character and the characters of each text."""
    try:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[ends]
    except UnicodeDecodeError:  # bytes stand for themselves
        points, upto = data.astype(np.uint32), ends
    lengths = np.diff(upto, prepend=0)
    places = np.arange(len(points)) + np.repeat(np.arange(1, len(ends) + 1) * ORDER, lengths)
    symbols = np.zeros(len(points) + ORDER * len(ends), np.uint64)
    symbols[places] = points
    return symbols, places, lengths


def count_ngrams(texts: DataFrame) -> DataFrame:
    """(fold, x1 to x5, n): n-grams of the highest order of (text, fold), counted per task and summed in shards by n-gram."""

    def merged(parts: list[tuple]) -> tuple:
        key, fold, hi, lo, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        return key[first], fold[first], hi[first], lo[first], np.bincount(of, n, len(first)).astype(np.int64)

    def batch_of(part: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in part[1:]], ["fold", "hi", "lo", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            folds = batch.column(1).to_numpy().astype(np.int32)
            for data, ends, row, rows in ngrams.chunks(batch.column(0), CHUNK):
                symbols, at, lengths = _symbols(data, ends)
                if not len(at):
                    continue
                fold = np.repeat(folds[row : row + rows], lengths)
                hi, lo = _packed(symbols, at)
                key = (hi.astype(np.uint64) * _P[0] + lo.astype(np.uint64) * _P[1] + fold.astype(np.uint64) * _P[2]) * _C
                key, first, n = np.unique(key, return_index=True, return_counts=True)
                parts.append((key, fold[first], hi[first], lo[first], n))
                if sum(len(p[0]) for p in parts) > HELD:
                    parts = [merged(parts)]
                    if len(parts[0][0]) > HELD // 2:
                        yield batch_of(parts.pop())
        if parts:
            yield batch_of(merged(parts))
        parts = []
        ngrams.trim()

    limit_batches(texts.sparkSession)
    packed = texts.select(text_or_empty().alias("text"), "fold").mapInArrow(run, "fold int, hi long, lo long, n long").groupBy("fold", "hi", "lo").agg(F.sum("n").alias("n"))
    low = lambda c, shift: F.shiftright(c, shift).bitwiseAND(F.lit((1 << 21) - 1)).cast("int")
    return packed.select("fold", *(low(c, s).alias(x) for x, (c, s) in zip(_X, (("hi", 21), ("hi", 0), ("lo", 42), ("lo", 21), ("lo", 0)), strict=True)), "n")


def build(counts: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """(table, base) of (model, x1 to x5, n): the entries (model, k, x1 to x5, delta, bow), and the cost of a symbol of which nothing is known, by model.

    Below the highest order an n-gram counts the symbols seen before it. Each order
    has its discounts for counts of 1, 2 and more from its counts of counts.
    """
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = materialise(orders[k + 1].groupBy("model", *_X[ORDER - k :]).agg(F.count("*").alias("n")))
    made, base, lower = [], {}, None
    for k in range(1, ORDER + 1):
        c, x = orders[k], _X[ORDER - k :]
        of: dict[int, dict[int, int]] = {}
        for r in c.groupBy("model").agg(F.sum("n").alias("all"), *(F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4))).collect():
            of[r["model"]] = {i: r[f"n{i}"] for i in (1, 2, 3, 4)}
        d = F.lit(0.0)
        for m, n in of.items():
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
            less = [min(max(i - (i + 1) * y * n[i + 1] / n[i], LEAST_DISCOUNT), i) if n[i] else 0.5 for i in (1, 2, 3)]
            d = F.when(F.col("model") == m, F.when(F.col("n") == 1, less[0]).when(F.col("n") == 2, less[1]).otherwise(less[2])).otherwise(d)
        c = c.withColumn("d", F.least(d, F.col("n").cast("double")))
        context = materialise(c.groupBy("model", *x[:-1]).agg(F.sum("n").alias("total"), F.sum("d").alias("kept")))
        if k == 1:
            base = {r["model"]: math.log2(r["total"] / r["kept"]) + math.log2(ALPHABET) for r in context.collect()}
            joined = c.join(F.broadcast(context), "model").withColumn("low", F.lit(1 / ALPHABET))
        else:
            made.append(context.select("model", F.lit(k - 1).alias("k"), *_shifted(x[:-1]), F.lit(0.0).alias("delta"), F.log2(F.col("total") / F.col("kept")).alias("bow")))
            joined = c.join(context, ["model", *x[:-1]]).join(lower, ["model", *x[1:]])
        off = F.col("kept") / F.col("total") * F.col("low")
        p = (F.col("n") - F.col("d")) / F.col("total") + off
        lower_now = materialise(joined.select("model", *x, p.alias("low"), (F.log2(off) - F.log2(p)).alias("delta")))
        made.append(lower_now.select("model", F.lit(k).alias("k"), *_shifted(x), "delta", F.lit(0.0).alias("bow")))
        lower = lower_now.drop("delta")
    table = made[0]
    for e in made[1:]:
        table = table.unionByName(e)
    return materialise(table.groupBy("model", "k", *_X).agg(F.sum("delta").alias("delta"), F.sum("bow").alias("bow"))), base


def _shifted(x: list[str]) -> list[Column]:
    """The columns as the last ones of x1 to x5, 0 before."""
    return [*(F.lit(0).alias(a) for a in _X[: ORDER - len(x)]), *(F.col(b).alias(a) for a, b in zip(_X[ORDER - len(x) :], x, strict=True))]


def _packed(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place's symbol and the four before it, 21 bits each, in two integers."""
    own = symbols.view(np.int64)
    hi, lo = own[at - 4] << 21, own[at - 2] << 42
    hi |= own[at - 3]
    lo |= own[at - 1] << 21
    lo |= own[at]
    return hi, lo


def _key(hi: np.ndarray, lo: np.ndarray, tag: np.ndarray | int) -> np.ndarray:
    h = hi.astype(np.uint64) * _P[0] + lo.astype(np.uint64) * _P[1] + np.asarray(tag).astype(np.uint64) * _P[2]
    h = (h ^ h >> np.uint64(29)) * _C
    return h ^ h >> np.uint64(32)


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marks by slot, slot of each key): the high bits of a key are its slot, or the next free one; a free slot has 0."""
    bits = max(4, math.ceil(math.log2(max(1, len(keys)) * 2)))
    marks = np.zeros(1 << bits, np.uint32)
    slot, mark = (keys >> np.uint64(64 - bits)).astype(np.int64), keys.astype(np.uint32) | np.uint32(1)
    left = np.arange(len(keys))
    while len(left):
        free = left[marks[slot[left]] == 0]
        _, first = np.unique(slot[free], return_index=True)
        put = free[first]
        marks[slot[put]] = mark[put]
        done = np.zeros(len(keys), bool)
        done[put] = True
        left = left[~done[left]]
        slot[left] = slot[left] + 1 & (1 << bits) - 1
    return marks, slot


def _found(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The slot of each key, or a free one."""
    slot, mark = (keys >> np.uint64(64 - int(math.log2(len(marks))))).astype(np.int64), keys.astype(np.uint32) | np.uint32(1)
    got = marks[slot]
    todo = np.flatnonzero((got != mark) & (got != 0))
    while len(todo):
        slot[todo] = slot[todo] + 1 & len(marks) - 1
        got = marks[slot[todo]]
        todo = todo[(got != mark[todo]) & (got != 0)]
    return slot


def entries(table: DataFrame, parts: int) -> DataFrame:
    """(part, tag, hi, lo, value): each entry of the table in the part of the n-grams that need it, those of one and two characters in all."""
    x = [F.col(c).cast("long") for c in _X]
    hi, lo = F.shiftleft(x[0], 21).bitwiseOR(x[1]), F.shiftleft(x[2], 42).bitwiseOR(F.shiftleft(x[3], 21)).bitwiseOR(x[4])
    of = lambda kind, value: [((F.col("model") * 2 * (ORDER + 1)) + F.col("k") * 2 + kind).cast("long").alias("tag"), hi.alias("hi"), lo.alias("lo"), F.col(value).alias("value")]
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    delta, bow = table.where("delta != 0"), table.where("bow != 0")
    sets = (
        (delta.where("k > 2"), _part(x[2], x[3], parts), of(0, "delta")), (delta.where("k <= 2"), every, of(0, "delta")),
        (bow.where("k > 1"), _part(x[3], x[4], parts), of(1, "bow")), (bow.where("k = 1"), every, of(1, "bow")),
    )
    out = None
    for rows, part, columns in sets:
        one = rows.select(part.alias("part"), *columns).withColumn("part", F.col("part").cast("int"))
        out = one if out is None else out.unionByName(one)
    return out


def _part(before: Column | np.ndarray, last: Column | np.ndarray, parts: int):
    """The part of what follows two symbols; n-grams of one and two symbols are in each part, as alphabets are small."""
    return (before * 7919 + last * 104729) % parts


REQUEST = "part int, flush long, first long, hi binary, lo binary, rid binary, model binary"


def _requests(flush: int, first: int, hi: np.ndarray, lo: np.ndarray, rid: np.ndarray, model: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows of REQUEST, AT_ONCE n-grams each at most, in order, of equal parts."""
    part = _part(lo >> 42, lo >> 21 & _LOW, parts)
    order = np.lexsort((hi, lo, part))
    hi, lo, rid, model, part = hi[order], lo[order], (rid[order] - first).astype(np.uint32), model[order].astype(np.uint8), part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    cuts = np.unique(np.concatenate([[0], cuts, np.arange(0, len(part), AT_ONCE), [len(part)]])).tolist()
    spans = list(zip(cuts, cuts[1:], strict=False))
    blobs = [pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (hi, lo, rid, model)]
    return pa.RecordBatch.from_arrays(
        [pa.array(part[[i for i, _ in spans]].astype(np.int32)), pa.array([flush] * len(spans), pa.int64()), pa.array([first] * len(spans), pa.int64()), *blobs], [x.split()[0] for x in REQUEST.split(", ")]
    )


class _Shard:
    """The entries of a part, sorted by key; of each only key and value are held."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(_key(np.full(1, -1), np.full(1, -1), 0), np.zeros(1))]

    def add(self, tag: np.ndarray, hi: np.ndarray, lo: np.ndarray, value: np.ndarray) -> None:
        self.held.append((_key(hi, lo, tag), value.copy()))

    def close(self) -> None:
        """Sorts what was added; from then on entries can be looked up."""
        if self.held:
            key, value = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held = []
            order = np.argsort(key)
            self.key, self.value = key[order], value[order]

    def of(self, hi: np.ndarray, lo: np.ndarray, tag: np.ndarray) -> np.ndarray:
        key = _key(hi, lo, tag)
        where = np.searchsorted(self.key, key)
        where[where == len(self.key)] = 0
        return np.where(self.key[where] == key, self.value[where], 0.0)

    def costs(self, hi: np.ndarray, lo: np.ndarray, model: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Whole SCALEths of a bit for the last symbol of each n-gram, all entries of which are here."""
        tag, zero = model.astype(np.int64) * 2 * (ORDER + 1), np.zeros_like(hi)
        bits = base[model].copy()
        for k, a, b in ((1, zero, lo & _LOW), (2, zero, lo & _LOW2), (3, zero, lo), (4, hi & _LOW, lo), (5, hi, lo)):
            bits += self.of(a, b, tag + 2 * k)
        for k, a, b in ((1, zero, lo >> 21 & _LOW), (2, zero, lo >> 21), (3, zero, (hi & _LOW) << 42 | lo >> 21), (4, hi >> 21, (hi & _LOW) << 42 | lo >> 21)):
            bits += self.of(a, b, tag + 2 * k + 1)
        return np.rint(bits * SCALE).astype(np.int64)


def answers(requests: DataFrame, table: DataFrame, base: dict[int, float], parts: int) -> DataFrame:
    """(rid, model, cost): the sums of what the n-grams of ``requests``, materialised, cost, in SCALEths of a bit.

    Entries and requests meet by part; the requests of a part of very many are dealt out to
    copies of its entries. A task holds the entries of one part, and requests stream by.
    """
    bases = np.array([base.get(m, 0.0) for m in range(max(base) + 1)])

    def summed(shard: _Shard, first: int, blobs: list) -> pa.RecordBatch:
        hi, lo, rid, model = (np.frombuffer(b.as_py(), t) for b, t in zip(blobs, (np.int64, np.int64, np.uint32, np.uint8), strict=True))
        fresh = np.ones(len(lo), bool)  # equal n-grams stand side by side
        order = np.lexsort((model, hi, lo))
        hi, lo, rid, model = hi[order], lo[order], rid[order].astype(np.int64), model[order].astype(np.int64)
        fresh[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (model[1:] != model[:-1])
        cost = shard.costs(hi[fresh], lo[fresh], model[fresh], bases)[np.cumsum(fresh) - 1]
        by = rid * len(bases) + model
        order = np.argsort(by, kind="stable")
        by, cost = by[order], cost[order]
        starts = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(by[starts] // len(bases) + first), pa.array((by[starts] % len(bases)).astype(np.int32)), pa.array(np.add.reduceat(cost, starts))], ["rid", "model", "cost"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, _Shard()
        for batch in batches:
            group = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            asked = batch.column(2).to_numpy()
            edges = np.unique(np.concatenate([[0], np.flatnonzero((np.diff(group) != 0) | (np.diff(asked) != 0)) + 1, [len(group)]])).tolist()
            for i, j in zip(edges, edges[1:], strict=False):
                if group[i] != now:
                    now, shard = group[i], _Shard()
                if not asked[i]:
                    shard.add(*(batch.column(c).slice(i, j - i).to_numpy() for c in range(3, 7)))
                    continue
                shard.close()
                for r in range(i, j):
                    yield summed(shard, batch.column(7)[r].as_py(), [batch.column(c)[r] for c in range(8, 12)])
        shard = None
        ngrams.trim()

    amount = F.sum(F.octet_length("lo") / 8)
    salts = F.broadcast(materialise(requests.groupBy("part").agg(F.ceil(amount / PER_COPY).cast("int").alias("_salts")).where("_salts > 1")))  # a row per part at most
    own = entries(table, parts).join(salts, "part", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    asked = requests.join(salts, "part", "left").withColumn("salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("flush"), F.col("_salts")).cast("int")))
    blobs, numbers = ("hi", "lo", "rid", "model"), ("tag", "hi", "lo", "value")
    own = own.select("part", "salt", F.lit(0).alias("asked"), *numbers, F.lit(0).cast("long").alias("first"), *(F.lit(None).cast("binary").alias(f"b_{c}") for c in blobs))
    zero = {"value": F.lit(0.0)}
    asked = asked.select("part", "salt", F.lit(1).alias("asked"), *(zero.get(c, F.lit(0).cast("long")).alias(c) for c in numbers), "first", *(F.col(c).alias(f"b_{c}") for c in blobs))
    rows = own.unionByName(asked).repartition("part", "salt").sortWithinPartitions("part", "salt", "asked")
    limit_batches(requests.sparkSession)
    return rows.mapInArrow(run, "rid long, model int, cost long").groupBy("rid", "model").agg(F.sum("cost").alias("cost"))


def frequent(sample: DataFrame, table: DataFrame, base: dict[int, float], parts: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(marks, costs by model and slot) of the ``most`` most frequent n-grams of (text) or fewer.

    It only saves asking for them: their costs are those that ``answers`` gives.
    """
    counts = materialise(count_ngrams(sample.select("text", F.lit(0).alias("fold"))))
    held, least = 0, 1
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("c")).collect(), key=lambda r: -r["n"]):
        held += r["c"]
        if held > most:
            least = r["n"] + 1
            break
    x = [F.col(c).cast("long") for c in _X]
    hi, lo = F.shiftleft(x[0], 21).bitwiseOR(x[1]), F.shiftleft(x[2], 42).bitwiseOR(F.shiftleft(x[3], 21)).bitwiseOR(x[4])
    chosen = materialise(counts.where(F.col("n") >= least).select(F.monotonically_increasing_id().alias("rid"), hi.alias("hi"), lo.alias("lo")))
    models = sorted(base)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rid, hi, lo = (batch.column(i).to_numpy() for i in range(3))
                for m in models:
                    yield _requests(int(rid[0]), int(rid.min()), hi, lo, rid, np.full(len(rid), m), parts)

    asked = materialise(chosen.mapInArrow(ask, REQUEST))
    got = answers(asked, table, base, parts).select("rid", "model", F.col("cost").cast("int").alias("cost")).toArrow()
    grams = chosen.toArrow()
    rids = grams.column("rid").to_numpy()
    marks, slot = _slots(_key(grams.column("hi").to_numpy(), grams.column("lo").to_numpy(), 0))
    costs = np.zeros((max(base) + 1, len(marks)), np.int32)
    order = np.argsort(rids)
    costs[got.column("model").to_numpy(), slot[order[np.searchsorted(rids[order], got.column("rid").to_numpy())]]] = got.column("cost").to_numpy()
    return marks, costs


def scored(docs: DataFrame, table: DataFrame, base: dict[int, float], models: list[str], text_bytes: int, sample_docs: int = SAMPLE_DOCS, most: int = FREQUENT) -> DataFrame:
    """``docs`` without text, with _symbols, and for each column of ``models`` (a number of a model, or null) the bits _bits0, _bits1, ...

    An n-gram of a document is looked up among the frequent ones, which every task has;
    the others are asked for by part of the table and summed per document. Both give the
    same whole SCALEths of a bit, so a document's sum does not depend on how rows are dealt.
    """
    spark = docs.sparkSession
    parts = max(1, -(-table.count() // SHARD), -(-text_bytes // PART_BYTES))
    total = docs.count()
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, total))) < sample_docs).select("text")
    cache = spark.sparkContext.broadcast(frequent(sample, table, base, parts, most))
    keep = [T.StructField(f.name, f.dataType) for f in docs.schema.fields if f.name != "text"]
    rest = [c.name for c in keep]
    at, by = docs.columns.index("text"), [docs.columns.index(c) for c in models]
    kept_at = [docs.columns.index(c) for c in rest]
    costs_of = [f"_cost{i}" for i in range(len(models))]
    request = T.StructType.fromDDL(REQUEST)
    schema = T.StructType([*keep, T.StructField("_rid", T.LongType()), T.StructField("_symbols", T.LongType()), *(T.StructField(c, T.LongType()) for c in costs_of), *(T.StructField(f"_q_{f.name}", f.dataType) for f in request)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        marks, costs = cache.value
        rid = TaskContext.get().partitionId() << 33
        first, held, open_ = rid, [], 0
        kinds = None

        def asked() -> pa.RecordBatch:
            out = _requests(first, first, *(np.concatenate(x) for x in zip(*held, strict=True)), parts)
            return pa.RecordBatch.from_arrays([*(pa.nulls(out.num_rows, k) for k in kinds), *out.columns], schema.names)

        for batch in batches:
            use = [batch.column(i).fill_null(-1).to_numpy() for i in by]
            n, sums = np.zeros(batch.num_rows, np.int64), [np.zeros(batch.num_rows, np.int64) for _ in by]
            kinds = [*(batch.column(i).type for i in kept_at), *[pa.int64()] * (2 + len(by))]
            for data, ends, row, rows in ngrams.chunks(batch.column(at), CHUNK):
                symbols, places, lengths = _symbols(data, ends)
                n[row : row + rows] = lengths
                if not len(places):
                    continue
                hi, lo = _packed(symbols, places)
                slot = _found(_key(hi, lo, 0), marks)
                unknown = np.flatnonzero(marks[slot] == 0)
                doc = np.repeat(np.arange(rows), lengths)[unknown]
                to = np.cumsum(lengths)
                for c, total in enumerate(sums):
                    own = use[c][row : row + rows]
                    asked_before = np.logical_or.reduce([use[b][row : row + rows] == own for b in range(c)]) if c else np.zeros(rows, bool)
                    for m in np.unique(own[own >= 0]).tolist():
                        upto = np.concatenate([[0], np.cumsum(costs[m][slot].astype(np.int64))])
                        total[row : row + rows] += np.where(own == m, upto[to] - upto[to - lengths], 0)
                        mine = ((own == m) & ~asked_before)[doc]
                        if mine.any():
                            ask = unknown[mine]
                            held.append((hi[ask], lo[ask], rid + row + doc[mine], np.full(len(ask), m)))
                            open_ += len(ask)
                if open_ > ASK:  # a document's n-grams are all asked for in one chunk
                    yield asked()
                    first, held, open_ = rid + row + rows, [], 0
            own = [batch.column(i) for i in kept_at] + [pa.array(np.arange(rid, rid + batch.num_rows)), pa.array(n), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(batch.num_rows, f.type) for f in pa_request)], schema.names)
            rid += batch.num_rows
        if held:
            yield asked()
        held = []
        ngrams.trim()

    kinds_of = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    pa_request = [pa.field(x.split()[0], kinds_of[x.split()[1]]) for x in REQUEST.split(", ")]
    limit_batches(spark)
    both = materialise(docs.mapInArrow(run, schema))
    asked = both.where("_q_part is not null").select(*(F.col(f"_q_{f.name}").alias(f.name) for f in request))
    rows = both.where("_q_part is null").select(*rest, "_rid", "_symbols", *costs_of)
    got = answers(asked, table, base, parts).select(F.col("rid").alias("_rid"), F.col("model").alias("_model"), F.col("cost").alias("_more"))
    got = materialise(got.groupBy("_rid").agg(F.map_from_entries(F.collect_list(F.struct("_model", "_more"))).alias("_more")))
    joined = rows.join(got, "_rid", "left")
    bits = lambda c, m: F.when(F.col(m).isNotNull(), (F.col(c) + F.coalesce(F.col("_more")[F.col(m)], F.lit(0).cast("long"))) / SCALE)
    return joined.select(*rest, "_symbols", *(bits(c, m).alias(f"_bits{i}") for i, (c, m) in enumerate(zip(costs_of, models, strict=True))))
