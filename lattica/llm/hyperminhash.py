"""Near-duplicate detection by HyperMinHash.

A document's shingles fall into BUCKETS buckets by hash. A bucket's register is the
least hash in it, kept as the count of its leading zeros and MANTISSA bits after the
first one, 16 bits together. An empty bucket takes the register of the first full one
in an order of its own, the same for all documents, so registers of two documents
agree as often as their sets do, for short texts too.

Registers are banded, ROWS at a time. Documents that share a band are candidates:
each is compared with its band's pivot first, linked ones are merged, and only what is
then still in different components is paired. The share of equal registers, corrected
for those that agree by chance (two minima with the same leading bits), estimates the
similarity; pairs of FLOOR or more are confirmed on their full sets. A band of more than
SMALL documents that its pivot leaves mixed, as that of a passage that very many are
mostly made of, is not multiplied out: its rows go through the exact n-gram join, by
their rarest shingles.

A pair at the threshold shares no band in (1 - 0.8 ** ROWS) ** BANDS of cases, about
1e-11, and is estimated below FLOOR still more rarely; texts of a few words, whose
words may meet in one bucket, miss about 1e-7 of pairs that are just at the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import heavy_keys, join_checked, join_skewed, limit_batches, materialise, text_or_empty
from .ngram_join import PERCENT, components, key_of_row
from .ngram_join import labelled as exactly

WIDTH = 4
ROWS, BANDS = 4, 48
BUCKETS = ROWS * BANDS
MANTISSA = 10
#: Estimated similarity below which a candidate is not looked at.
FLOOR = 0.4
#: Rows of a band of more, if its pivot leaves it mixed, go through the exact join.
SMALL = 16

SKETCH = "doc_id long, key long, n long, f1 long, f2 long, registers binary"
PAIRS = "a long, b long, n long, n2 long"
_TAGS = np.array([0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35, 0xC2B2AE3D27D4EB4F], np.uint64)
_ORDER = np.argsort(np.random.Generator(np.random.PCG64(11)).random((BUCKETS, BUCKETS)), axis=1).argsort(axis=1)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, hashes, row of each) of parts of a string column: each text's distinct shingles, in order."""
    for data, ends, row, rows in ngrams.chunks(column):
        hashes, number = ngrams.shingles(*ngrams.word_hashes(data, ends), width)
        order = np.lexsort((hashes, number))
        hashes, number = hashes[order], number[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (number[1:] != number[:-1])
        yield row, rows, hashes[fresh], number[fresh]


def compressed(least: np.ndarray) -> np.ndarray:
    """Leading zeros and the bits after the first one, of 64-bit minima."""
    length = np.frexp(least.astype(np.float64))[1].astype(np.int64)
    down, up = np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64), np.maximum(MANTISSA + 1 - length, 0).astype(np.uint64)
    mantissa = ((least >> down) << up) & np.uint64((1 << MANTISSA) - 1)
    return ((64 - np.minimum(length, 64)).astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


def registers(hashes: np.ndarray, number: np.ndarray, rows: int) -> np.ndarray:
    """A row of BUCKETS registers for each of ``rows`` sets; those of an empty set mean nothing."""
    spread = ngrams.mixed(hashes ^ _TAGS[2])
    bucket = ((spread >> np.uint64(32)) * np.uint64(BUCKETS) >> np.uint64(32)).astype(np.int64)
    least = np.full(rows * BUCKETS, _EMPTY)
    np.minimum.at(least, number * BUCKETS + bucket, ngrams.mixed(spread))
    least = least.reshape(rows, BUCKETS)
    out = compressed(least)
    empty = least == _EMPTY
    for i in np.flatnonzero(empty.any(1) & ~empty.all(1)):
        full, bare = np.flatnonzero(~empty[i]), np.flatnonzero(empty[i])
        out[i, bare] = out[i, full[_ORDER[np.ix_(bare, full)].argmin(1)]]
    return out


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """SKETCH: a row per document, with its set's size, fingerprint and registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, rows, hashes, number in _sets(batch.column(1), width):
                n = np.bincount(number, minlength=rows)
                prints = np.zeros((2, rows), np.uint64)
                for i in (0, 1):
                    np.add.at(prints[i], number, ngrams.mixed(hashes ^ _TAGS[i]))
                made = [bytes(r) if k else None for k, r in zip(n.tolist(), registers(hashes, number, rows), strict=True)]
                own = batch.slice(row, rows)
                columns = [own.column(0), own.column(2), pa.array(n), *(pa.array(p.view(np.int64)) for p in prints), pa.array(made, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SKETCH.split(", ")])
        ngrams.trim()

    limit_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), key_of_row()).mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, reps: DataFrame, width: int = WIDTH) -> DataFrame:
    """(rep, value): the sorted shingles of the rows (doc_id, key) of ``reps``. A row that stands there twice has its set twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, rows, hashes, number in _sets(batch.column(1), width):
                ends = np.searchsorted(number, np.arange(rows), "right")
                values = [hashes[i:j].tobytes() for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, rows), pa.array(values, pa.binary())], ["rep", "value"])
        ngrams.trim()

    keyed = docs.select(key_of_row(), text_or_empty().alias("text"))
    own = join_checked(keyed, reps.select("rep", "key"), ["key"], "inner")
    return materialise(own.select("rep", "text").mapInArrow(run, "rep long, value binary"))


def met(pairs: DataFrame, values: DataFrame, judge: Callable[[np.ndarray, np.ndarray, int, int], bool], kind: type) -> DataFrame:
    """The ``pairs`` (a, b, n, n2), materialised, whose values pass ``judge``, each maybe more than once.

    A pair carries the value of its b to where a's value is; an a of many pairs, as
    a pivot, is dealt out, and its value is sent once to each part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            a, b, n, n2 = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            keep = []
            for i, value in enumerate(batch.column(5)):
                if b[i] is None:
                    last, own = a[i], np.frombuffer(value.as_py(), kind)
                elif a[i] == last and judge(own, np.frombuffer(value.as_py(), kind), n[i], n2[i]):
                    keep.append(i)
            yield batch.select(["a", "b", "n", "n2"]).take(pa.array(keep, pa.int64()))
        ngrams.trim()

    salts = F.broadcast(heavy_keys(pairs, "a"))
    dealt = pairs.join(salts, "a", "left").withColumn("salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("_salts")).cast("int")))
    sent = dealt.join(values.select(F.col("rep").alias("b"), "value"), "b").select("a", "salt", "b", "n", "n2", "value")
    wanted = pairs.select("a").distinct().join(salts, "a", "left").select("a", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("salt"))
    none = F.lit(None).cast("long")
    own = wanted.join(values.select(F.col("rep").alias("a"), "value"), "a").select("a", "salt", none.alias("b"), none.alias("n"), none.alias("n2"), "value")
    rows = own.unionByName(sent).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return rows.mapInArrow(run, PAIRS)


@lru_cache(maxsize=256)
def _chance(level: int) -> float:
    """The odds that registers of unlike sets of about 2 ** (level / 2) shingles each agree."""
    each = 2 ** (level / 2)
    lead = np.arange(1, 64)[:, None]
    low = ((1 << MANTISSA) + np.arange(1 << MANTISSA)) / 2.0 ** (MANTISSA + lead)
    high = low + 2.0 ** -(MANTISSA + lead)
    per = max(each / BUCKETS, 1.0)
    least = np.exp(per * np.log1p(-low)) - np.exp(per * np.log1p(-np.minimum(high, 1 - 1e-16)))
    return float((least * least).sum())


def estimate(one: np.ndarray, two: np.ndarray, n: int, n2: int) -> float:
    """The similarity of two sets of n and n2 shingles by their registers."""
    chance = _chance(round(2 * np.log2(max(1, n * n2) ** 0.5)))
    return float(((one == two).mean() - chance) / (1 - chance))


def _likely(one: np.ndarray, two: np.ndarray, n: int, n2: int) -> bool:
    return estimate(one, two, n, n2) >= FLOOR


def _linked(one: np.ndarray, two: np.ndarray, n: int, n2: int) -> bool:
    where = np.searchsorted(one, two)
    where[where == len(one)] = 0
    both = int((one[where] == two).sum())
    return 100 * both >= PERCENT * (len(one) + len(two) - both)


def _apart(pairs: DataFrame) -> DataFrame:
    """The distinct pairs (a, n, b, n2) whose sizes allow a link, materialised; a is the pivot, if there is one."""
    sized = pairs.where((F.least("n", "n2") * 100 >= F.greatest("n", "n2") * PERCENT) & (F.col("a") != F.col("b")))
    return materialise(sized.select("a", "b", "n", "n2").dropDuplicates(["a", "b"]))


class _Links:
    """Links among classes: candidates are estimated by their registers and confirmed on their sets."""

    def __init__(self, docs: DataFrame, reps: DataFrame, width: int):
        self.docs, self.reps, self.width = docs, reps, width

    def among(self, pairs: DataFrame) -> DataFrame:
        likely = materialise(met(_apart(pairs), self.reps.select("rep", F.col("registers").alias("value")), _likely, np.uint16).dropDuplicates(["a", "b"]))
        ids = likely.select(F.col("a").alias("rep")).unionByName(likely.select(F.col("b").alias("rep"))).distinct()
        wanted = materialise(self.reps.select("rep", "key").join(ids, "rep"))
        return materialise(met(likely, full_sets(self.docs, wanted, self.width), _linked, np.uint64).select("a", "b"))


def bands(reps: DataFrame) -> DataFrame:
    """(h, rep, n) of each class and band."""
    own = lambda i: F.xxhash64(i, F.substring("registers", i * ROWS * 2 + 1, ROWS * 2))
    return reps.select("rep", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), own)).alias("h")).select("h", "rep", "n")


def link_components(docs: DataFrame, reps: DataFrame, width: int, small: int = SMALL) -> DataFrame:
    """(node, label) of linked classes (rep, key, n, registers), materialised."""
    links = _Links(docs, reps, width)
    entries = bands(reps)
    pivot = F.min(F.struct(F.xxhash64("rep").alias("x"), F.col("rep").alias("a"), F.col("n").alias("n2"))).alias("p")
    shared = entries.groupBy("h").agg(F.count("*").alias("m"), pivot).where("m > 1").select("h", "p.a", "p.n2")
    entries = materialise(entries.join(shared, "h"))
    star = entries.select("a", F.col("rep").alias("b"), F.col("n2").alias("n"), F.col("n").alias("n2"))
    merged = materialise(components(links.among(star)))
    named = materialise(entries.select("h", "rep", "n").join(merged.withColumnRenamed("node", "rep"), "rep", "left").select("h", "rep", "n", F.coalesce("label", "rep").alias("label")))
    mixed = materialise(named.groupBy("h").agg(F.count("*").alias("m"), F.min("label").alias("one"), F.max("label").alias("other")).where("one != other").select("h", "m"))
    first = named.join(mixed.where(F.col("m") <= small).select("h"), "h")
    second = first.select("h", F.col("rep").alias("b"), F.col("n").alias("n2"), F.col("label").alias("label2"))
    across = first.withColumnRenamed("rep", "a").join(second, "h").where("a < b and label != label2")
    found = links.among(across.select("a", "b", "n", "n2"))
    large = named.join(mixed.where(F.col("m") > small).select("h"), "h").select("rep").distinct()
    wanted = materialise(reps.select("rep", "key").join(large, "rep"))
    if not wanted.isEmpty():
        rows = join_checked(docs.select(key_of_row(), "text"), wanted, ["key"], "inner").select(F.col("rep").alias("doc_id"), "text")
        exact = exactly(rows, width).where("doc_id != component_id")
        found = found.unionByName(exact.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
    return materialise(components(merged.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(found)))


def labelled(docs: DataFrame, width: int = WIDTH, small: int = SMALL) -> DataFrame:
    """doc_id, n, component_id: a row per document."""
    rows = materialise(sketches(docs, width).withColumn("rid", F.monotonically_increasing_id()))
    prints = ["n", "f1", "f2"]
    classes = materialise(rows.where("n > 0").groupBy(*prints).agg(F.min("rid").alias("rep"), F.min("doc_id").alias("first"), F.count("*").alias("cnt")))
    reps = materialise(rows.select(F.col("rid").alias("rep"), "key", "n", "registers").join(classes.select("rep"), "rep"))
    merged = link_components(docs, reps, width, small)
    named = merged.join(classes.select(F.col("rep").alias("node"), "first"), "node")
    least = named.groupBy("label").agg(F.min("first").alias("component"))
    found = named.join(least, "label").select(F.col("node").alias("rep"), "component")
    classes = materialise(classes.join(found, "rep", "left").select(*prints, F.coalesce("component", "first").alias("component"), "cnt"))
    out = join_skewed(rows.select("doc_id", "rid", *prints), classes, prints, "cnt", rows.count(), F.col("rid"))
    return out.select("doc_id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per document; the one whose doc_id is its component's smallest is kept.

    A document of fewer words than a shingle is one shingle of them all. Null, empty
    and blank texts have no shingle, are components of their own and are kept. Repeated
    rows and equal sets are in one component; rows that share the smallest doc_id are all
    kept, and so is a row without doc_id that has no other doc_id in its component. A
    long text is taken whole. Further columns are ignored; no rows give no rows.
    """
    out = labelled(docs)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
