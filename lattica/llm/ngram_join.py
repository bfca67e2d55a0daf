"""N-gram Jaccard join as a blocked sparse matrix product.

Documents are rows and word shingles columns of a sparse incidence matrix. It is cut
into column blocks (ranges of shingle hashes) of a few million entries. A block
counts how many rows each of its columns meets and returns, to the rows, the
entries that another row shares; whatever no other row has drops out. A row of n
shingles links with none unless ceil(0.8 n) of its entries are shared, and its
partners must meet it within its n - ceil(0.8 n) + 1 rarest columns: these
size-derived bounds discard all other rows and columns of the product. What is left
is multiplied in column ranges, one after another: overlap counts of the surviving
pairs are accumulated, and after each range a pair goes whose count, with all that
either row has left, cannot reach what its sizes ask for.

Equal sets are one row (a class). Only components are wanted, so a column that
many similar rows share is not multiplied out: rows are first compared with a pivot,
linked rows are merged, and then every pair of the column that is still in different
components is compared, so no link is lost.

Shingles are compared by 48 bits of a 64-bit hash; in a pair of sets of 500 the odds
of a false match are below 1e-9.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import heavy_keys, join_checked, join_salted, join_skewed, limit_batches, materialise, text_or_empty

PERCENT = 80
#: Entries of a column block, and of a batch of rows within a task.
BLOCK_ENTRIES, BATCH_ENTRIES, BATCH_ROWS = 1_000_000, 500_000, 50_000
#: Entries of a batch for each block at least, up to BATCH_MOST, so that rows of the shuffle stay worth their overhead.
PER_BLOCK, BATCH_MOST = 500, 4_000_000
#: Column ranges that overlaps are accumulated over.
RANGES = 4
#: A column of so many rows or fewer is multiplied out at once.
SMALL = 32
#: Rows are compared with a pivot, ROUNDS times at most, while the pairs still to be looked at are more than CROSS times the entries.
CROSS, ROUNDS = 200, 3

INCIDENCE = "block long, flush long, one_hash binary, one_row binary, many_hash binary, many_count binary, rows binary"
SHARED = "flush long, block long, one_hash binary, one_row binary, one_df binary, many_df binary, rows binary"
ROWS = "doc_id long, key long, rid long, n long, f1 long, f2 long, prefix array<long>, shared binary"


def at_least(n):
    """The least overlap with any partner of a set of n."""
    return (PERCENT * n + 99) // 100


def _pack(sorted_hashes: np.ndarray) -> bytes:
    if not len(sorted_hashes):
        return b""
    gaps = np.diff(sorted_hashes)
    wide = len(gaps) and int(gaps.max()) >> 32
    return bytes([bool(wide)]) + sorted_hashes[:1].tobytes() + gaps.astype(np.uint64 if wide else np.uint32).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    gaps = np.frombuffer(data, np.uint64 if data[0] else np.uint32, offset=9)
    out = np.empty(len(gaps) + 1, np.uint64)
    out[0] = np.frombuffer(data, np.uint64, 1, 1)[0]
    np.cumsum(gaps, dtype=np.uint64, out=out[1:])
    out[1:] += out[0]
    return out


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(types)], list(names))


def _incidence(doc_ids: list, hashes: np.ndarray, rows: np.ndarray, flush: int, blocks: int) -> pa.RecordBatch:
    """The entries of a batch of rows, dealt out to column blocks."""
    order = np.argsort(hashes, kind="stable")
    hashes, rows = hashes[order], rows[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[fresh], rows[fresh]
    n = np.bincount(rows, minlength=len(doc_ids))
    prints = np.zeros((2, len(doc_ids)), np.uint64)
    for i, tag in enumerate((0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35)):
        np.add.at(prints[i], rows, ngrams.mixed(hashes ^ np.uint64(tag)))
    prints = prints.view(np.int64)
    by = np.lexsort((np.arange(len(n)), prints[1], prints[0], n))
    leads = np.ones(len(n), bool)
    leads[by[1:]] = (n[by[1:]] != n[by[:-1]]) | (prints[:, by[1:]] != prints[:, by[:-1]]).any(0)
    kept = leads[rows]
    hashes, rows = hashes[kept] >> np.uint64(16), rows[kept].astype(np.uint32)
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
    count = np.diff(starts, append=len(hashes))
    one, many = starts[count == 1], starts[count > 1]
    many_of = np.repeat(np.arange(len(many), dtype=np.uint32), count[count > 1])
    many_rows = rows[np.repeat(count > 1, count)] if len(count) else rows
    narrow = np.uint16 if len(doc_ids) <= 1 << 16 else np.uint32
    block = lambda h: (h >> np.uint64(16)) * np.uint64(blocks) >> np.uint64(32)
    edges = np.arange(blocks + 1, dtype=np.uint64)
    at_one, at_many = np.searchsorted(block(hashes[one]), edges), np.searchsorted(block(hashes[many]), edges)
    out = []
    for b in np.flatnonzero((np.diff(at_one) > 0) | (np.diff(at_many) > 0)).tolist():
        i, j = one[at_one[b] : at_one[b + 1]], many[at_many[b] : at_many[b + 1]]
        out.append((b, flush, _pack(hashes[i]), rows[i].astype(narrow).tobytes(), _pack(hashes[j]), count[count > 1][at_many[b] : at_many[b + 1]].astype(np.uint32).tobytes(), None))
    own = {"doc_ids": doc_ids, "n": n, "prints": prints, "narrow": narrow, "many": hashes[many], "many_of": many_of, "many_rows": many_rows}
    out.append((flush % blocks, flush, None, None, None, None, pickle.dumps(own)))
    return _batch(INCIDENCE, out)


def key_of_row() -> Column:
    """With doc_id, tells rows of different texts apart."""
    return F.xxhash64("doc_id", text_or_empty()).alias("key")


def incidence(docs: DataFrame, blocks: int, width: int = ngrams.WIDTH) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        flush, ids, held, entries = TaskContext.get().partitionId() << 20, [], [], 0
        most = max(BATCH_ENTRIES, min(blocks * PER_BLOCK, BATCH_MOST))
        for batch in batches:
            doc_ids = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for data, ends, row, rows in ngrams.chunks(batch.column(1)):
                hashes, number = ngrams.shingles(*ngrams.word_hashes(data, ends), width)
                held.append((hashes, number + len(ids)))
                ids += doc_ids[row : row + rows]
                entries += len(hashes)
                if entries >= most or len(ids) >= BATCH_ROWS:
                    yield _incidence(ids, *map(np.concatenate, zip(*held, strict=True)), flush, blocks)
                    flush, ids, held, entries = flush + 1, [], [], 0
                    ngrams.trim()
        if ids:
            yield _incidence(ids, *map(np.concatenate, zip(*held, strict=True)), flush, blocks)
        ids, held = [], []
        ngrams.trim()

    limit_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), key_of_row()).mapInArrow(run, INCIDENCE)


def _shared(table: pa.Table) -> pa.Table:
    """A column block: how many rows each column meets, returned to the rows' batches."""
    got = table.to_pylist()
    out = [(r["flush"], -1, None, None, None, None, r["rows"]) for r in got if r["rows"]]
    got = [r for r in got if not r["rows"]]
    ones, many = [_unpack(r["one_hash"]) for r in got], [_unpack(r["many_hash"]) for r in got]
    hashes = np.concatenate([*ones, *many, np.empty(0, np.uint64)])
    counts = np.concatenate([np.ones(sum(map(len, ones)), np.int64), *(np.frombuffer(r["many_count"], np.uint32) for r in got)]).astype(np.int64)
    if len(hashes):
        order = np.argsort(hashes)
        ordered = hashes[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        df = np.empty(len(hashes), np.int64)
        df[order] = np.repeat(np.add.reduceat(counts[order], starts), np.diff(starts, append=len(hashes)))
        rank = np.minimum(255, 8 * np.log2(df)).astype(np.uint8)
        a, b = 0, sum(map(len, ones))
        for r, one, more in zip(got, ones, many, strict=True):
            keep = df[a : a + len(one)] > 1
            width = len(r["one_row"]) // len(one) if len(one) else 2
            rows = np.frombuffer(r["one_row"], np.uint16 if width == 2 else np.uint32)
            out.append((r["flush"], r["block"], _pack(one[keep]), rows[keep].tobytes(), rank[a : a + len(one)][keep].tobytes(), rank[b : b + len(more)].tobytes(), None))
            a, b = a + len(one), b + len(more)
    done = pa.Table.from_batches([_batch(SHARED, out)])
    del got, out
    ngrams.trim()
    return done


def _bounded(table: pa.Table) -> pa.Table:
    """A batch of rows: their shared entries and, of those, the rarest within the size-derived bound."""
    got = sorted(table.to_pylist(), key=lambda r: r["block"])
    own, got = pickle.loads(got[0]["rows"]), got[1:]  # noqa: S301
    doc_ids, n = own["doc_ids"], own["n"]
    many_df = np.concatenate([np.empty(0, np.uint8), *(np.frombuffer(r["many_df"], np.uint8) for r in got)])
    hashes = np.concatenate([*(_unpack(r["one_hash"]) for r in got), own["many"][own["many_of"]]])
    rows = np.concatenate([*(np.frombuffer(r["one_row"], own["narrow"]) for r in got), own["many_rows"]]).astype(np.int64)
    rank = np.concatenate([*(np.frombuffer(r["one_df"], np.uint8) for r in got), many_df[own["many_of"]]])
    shared = np.bincount(rows, minlength=len(n))
    slots = shared - at_least(n) + 1
    live = (slots > 0) & (shared > 0)
    use = live[rows]
    hashes, rows, rank = hashes[use], rows[use], rank[use]
    order = np.lexsort((hashes, rank, rows))
    hashes, rows = hashes[order], rows[order]
    ends = np.searchsorted(rows, np.arange(len(n)), "right")
    flush, out = table.column("flush")[0].as_py(), []
    for i, (doc, key) in enumerate(doc_ids):
        prefix = shares = None
        if live[i]:
            mine = hashes[ends[i - 1] if i else 0 : ends[i]]
            prefix, shares = mine[: slots[i]].astype(np.int64), np.sort(mine).tobytes()
        out.append((doc, key, (flush << 20) + i, int(n[i]), int(own["prints"][0, i]), int(own["prints"][1, i]), prefix, shares))
    done = pa.Table.from_batches([_batch(ROWS, out)])
    del own, got, out
    ngrams.trim()
    return done


def bounded_rows(docs: DataFrame, width: int = ngrams.WIDTH) -> DataFrame:
    """ROWS, materialised: each document's set size and fingerprint; if it can have partners, its shared entries and prefix."""
    size = docs.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    blocks = max(1, -(-size // (6 * BLOCK_ENTRIES)))
    shared = incidence(docs, blocks, width).groupBy("block").applyInArrow(_shared, SHARED)
    return materialise(shared.groupBy("flush").applyInArrow(_bounded, ROWS))


SLICES = "rep long, part int, rest long, entries binary"
COUNTED = "a long, b long, need long, overlap long"


def sliced(sets: DataFrame) -> DataFrame:
    """SLICES, materialised: each row's shared entries by column range, and how many it has in later ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, RANGES + 1, dtype=np.uint64) * np.uint64((1 << 48) // RANGES)
        edges[-1] = 1 << 48
        for batch in batches:
            out = []
            for rep, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(held.as_py(), np.uint64)
                ends = np.searchsorted(values, edges)
                for part, (i, j) in enumerate(zip([0, *ends.tolist()], ends.tolist(), strict=False)):
                    out.append((rep, part, len(values) - j, values[i:j].tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [x.split()[0] for x in SLICES.split(", ")])
        ngrams.trim()

    return materialise(sets.select("rep", "shared").mapInArrow(run, SLICES), "part")


def _product(pairs: DataFrame, slices: DataFrame) -> DataFrame:
    """The pairs (a, b) of (a, b, need) whose overlap reaches ``need``.

    Overlaps are accumulated from column range to column range. What either row has
    left bounds what is still to come, and a pair that cannot reach its need any more
    is dropped. Rows in many pairs, pivots above all, are dealt out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, need, overlap, rest_a, rest_b = (batch.column(i).to_numpy() for i in (0, 2, 3, 4, 6))
            counts, last, left = np.zeros(batch.num_rows, np.int64), None, None
            for i, (one, two) in enumerate(zip(batch.column(5), batch.column(7), strict=True)):
                if a[i] != last:
                    last, left = a[i], np.frombuffer(one.as_py(), np.uint64)
                right = np.frombuffer(two.as_py(), np.uint64)
                if len(left) and len(right):
                    where = np.searchsorted(left, right)
                    where[where == len(left)] = 0
                    counts[i] = (left[where] == right).sum()
            overlap = overlap + counts
            keep = pa.array(overlap + np.minimum(rest_a, rest_b) >= need)
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (*batch.columns[:3], pa.array(overlap))], [x.split()[0] for x in COUNTED.split(", ")])
        ngrams.trim()

    pairs = materialise(pairs)
    heavy = {k: heavy_keys(pairs, k) for k in ("a", "b")}
    pairs = pairs.withColumn("overlap", F.lit(0).cast("long"))
    for part in range(RANGES):
        own = slices.where(F.col("part") == part)
        both = join_salted(pairs, own.select(F.col("rep").alias("a"), F.col("rest").alias("rest_a"), F.col("entries").alias("set_a")), "a", heavy["a"], F.col("b"))
        both = join_salted(both, own.select(F.col("rep").alias("b"), F.col("rest").alias("rest_b"), F.col("entries").alias("set_b")), "b", heavy["b"], F.col("a"))
        pairs = both.select("a", "b", "need", "overlap", "rest_a", "set_a", "rest_b", "set_b").mapInArrow(run, COUNTED)
        if part < RANGES - 1:
            pairs = materialise(pairs)
    return pairs.select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label): of each linked node the least node it reaches, by alternating large and small stars.

    The centre of a large star has many rows; counts by node tell, and its row is broadcast.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c")))
        near = join_skewed(both, least, ["u"], "c", 2 * edges.count(), F.col("v"))
        large = materialise(near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        first = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")))
        small = join_skewed(large, first, ["u"], "c", large.count(), F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = materialise(small.unionByName(first.select("u", F.col("m").alias("v"))).distinct())
        # Stars: no node has two labels, and no label has one.
        loose = edges.groupBy("u").count().where("count > 1").select("u").unionByName(edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi"))
        if loose.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs of rows that meet in a column and can overlap enough, with the overlap they need.

    In a pair's first common column, at position pos of a row's n entries in column
    order, n - pos entries at most are still to meet; a pair that this bound drops in
    a later column is looked at in an earlier one.
    """
    overlap = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    fits = overlap * (100 + PERCENT) >= (F.col("n") + F.col("n2")) * PERCENT
    need = F.ceil((F.col("n") + F.col("n2")) * PERCENT / (100 + PERCENT)).cast("long")
    return pairs.where(fits).select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"), need.alias("need")).distinct()


def link_components(sets: DataFrame) -> DataFrame:
    """(node, label) of linked classes.

    Columns of few rows are multiplied out. In the others, rows meet the row that has
    the column earliest first; then only rows outside a column's largest component
    meet all others of it.
    """
    entries = sets.select("rep", "n", F.floor(F.octet_length("shared") / 8).alias("s"), F.posexplode("prefix").alias("i", "h")).select("h", "rep", "n", (F.col("n") - F.col("s") + F.col("i")).alias("pos"))
    many = entries.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    entries = materialise(entries.join(many, "h"))
    other = entries.select("h", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"))
    small = entries.where(f"m <= {SMALL}").join(other, "h").where("rep < rep2")
    large = entries.where(f"m > {SMALL}")
    total = large.count()
    pivot = lambda by: F.min(F.struct(by.alias("x"), F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"))).alias("p")
    pivots = large.groupBy("h").agg(pivot(F.col("pos") / F.col("n"))).select("h", "p.rep2", "p.n2", "p.pos2")
    columns = ["rep", "n", "pos", "rep2", "n2", "pos2"]
    starred = large.join(pivots, "h").where("rep != rep2")
    slices = sliced(sets)
    links = materialise(_product(_ordered(small.select(columns).unionByName(starred.select(columns))), slices))
    merged = materialise(components(links))
    for i in range(1, ROUNDS + 1):
        if not total:
            break
        labelled = materialise(large.join(merged.withColumnRenamed("node", "rep"), "rep", "left").select("h", "rep", "n", "pos", F.coalesce("label", "rep").alias("label")))
        parts = labelled.groupBy("h", "label").agg(F.count("*").alias("c")).groupBy("h").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("top"))
        parts = materialise(parts.select("h", "m", F.col("top.c").alias("c"), F.col("top.label").alias("most")).where("c < m"))
        cost = parts.agg(F.sum((F.col("m") - F.col("c")) * F.col("m"))).first()[0]
        if not cost:
            break
        inside = labelled.join(parts.select("h", "most"), "h")
        rest = inside.where("label != most")
        last = cost <= CROSS * total or i == ROUNDS
        if last:
            tried = rest.join(labelled.select("h", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("label").alias("label2")), "h").where("label != label2")
        else:
            chosen = inside.where("label = most").groupBy("h").agg(pivot(F.xxhash64(F.lit(i), "rep"))).select("h", "p.rep2", "p.n2", "p.pos2")
            tried = rest.join(chosen, "h")
        found = materialise(_product(_ordered(tried.select(columns)), slices))
        merged = materialise(components(merged.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(found)))
        if last:
            break
    return merged


def labelled(docs: DataFrame, width: int = ngrams.WIDTH) -> DataFrame:
    """doc_id, key, n, component_id: a row per document; ``key`` goes by doc_id and text."""
    rows = bounded_rows(docs, width)
    keys = ["n", "f1", "f2"]
    classes = materialise(rows.where("n > 0").groupBy(*keys).agg(F.min("rid").alias("rep"), F.min("doc_id").alias("first"), F.count("*").alias("cnt")))
    sets = materialise(rows.where("size(prefix) > 0").select("rid", "prefix", "shared").join(classes.select(F.col("rep").alias("rid"), "rep", "n"), "rid").drop("rid"))
    merged = link_components(sets)
    named = merged.join(classes.select(F.col("rep").alias("node"), "first"), "node")
    least = named.groupBy("label").agg(F.min("first").alias("component"))
    found = named.join(least, "label").select(F.col("node").alias("rep"), "component")
    classes = materialise(classes.join(found, "rep", "left").select(*keys, F.coalesce("component", "first").alias("component"), "cnt"))
    narrow = rows.select("doc_id", "key", "rid", *keys)
    out = join_skewed(narrow, classes, keys, "cnt", rows.count(), F.col("rid"))
    return out.select("doc_id", "key", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: a row per document.

    A document of fewer words than a shingle is one shingle of them all. Null, empty
    and blank texts have no shingle and are components of their own. Repeated rows and
    equal sets are in one component. component_id is the smallest doc_id that is not
    null. A long text is taken whole. Further columns are ignored; no rows give no rows.
    """
    return labelled(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id.

    Documents without shingles and rows without doc_id stay. Of rows that repeat
    doc_id and text, one stays; of rows that share a doc_id with different texts in a
    component, one stays, and their texts in other components are judged there.
    """
    found = materialise(labelled(docs))
    own = found.where("n > 0 and doc_id is not null")
    stays = materialise(own.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("stay"), F.count("*").alias("c")))
    judged = join_skewed(own, stays, ["component_id"], "c", found.count(), F.struct("doc_id", "key"))
    others = materialise(judged.where("struct(doc_id, key) != stay").select("doc_id", "key").distinct())
    repeated = found.groupBy("doc_id").count().where("count > 1 and doc_id is not null")
    if not repeated.isEmpty():
        docs = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))
    keyed = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)), "doc_id", key_of_row())
    kept = join_checked(keyed, others, ["doc_id", "key"], "left_anti")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
