"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity`` tokens. Packing looks at
lengths only, and there are at most ``capacity`` of them, so the corpus reaches the
driver as a histogram of bounded size. Per bin, the greatest length left is taken
and a bitset of reachable sums is built over the other lengths available until it
holds the fullest sum that fits; that combination is removed, as many times at once
as its lengths last. The bins' patterns, with the ranks of the lengths they use,
are joined back to the pieces.
"""

from __future__ import annotations

import contextlib
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ngrams
from .common import join_checked, limit_batches, materialise

CAPACITY = 4096
#: Words, and parts of words, kept per worker in each of two generations with their ids, at about 200 bytes each; what is let go costs time only.
CACHE_WORDS, CACHE_PARTS = 30_000, 30_000

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType()), T.StructField("ids", T.BinaryType()),
])


@lru_cache(maxsize=1)
def loaded(path: str):
    """A process's own tokenizer; each one that is loaded leaves some MB behind for good, so tasks share it."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordTokenizer:
    """Ids of a text from the ids of its words.

    The tokenizer drops white space and joins nothing across it, so a text's ids are
    its words' ids in turn; words are looked up and only unknown ones are encoded. It
    also never joins a letter or digit with the ASCII punctuation after it and
    ignores case, so an unknown word is put together from its stem's and its ending's
    ids. A word that holds one of the tokenizer's added tokens, which are matched
    anywhere and as written, is encoded whole. Words are cut at ASCII white space; other
    white space stays inside a word and is left to the tokenizer.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, cache_parts: int = CACHE_PARTS):
        self.model = loaded(path)
        added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        self.cache_words, self.cache_parts = cache_words, cache_parts
        self.words: dict[str, bytes] = {"": b""}
        self.older_words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def split(word: str) -> tuple[str, str]:
        """Stem and ending; without an ending where they may not be separate."""
        stem = word.rstrip(".,!?;:")
        last = stem[-1:].lower()[-1:]
        if not stem or not (last.isalnum() and last < "\u0250"):
            stem = word
        return stem.lower() if stem.isascii() else stem, word[len(stem) :]

    def part(self, text: str) -> bytes | None:
        """A known part's ids; parts in use move to the younger half, the older half is let go when that is full."""
        ids = self.parts.get(text)
        if ids is None and (ids := self.older.get(text)) is not None:
            self.parts[text] = ids
        return ids

    def learn(self, words: set[str]) -> dict[str, bytes]:
        if len(self.words) > self.cache_words:
            self.words, self.older_words = {"": b""}, self.words
        if len(self.parts) > self.cache_parts:
            self.parts, self.older = {}, self.parts
        before = self.older_words
        got = {w: before[w] for w in words if w in before}
        cut = {w: (w, "") if self.added.search(w) else self.split(w) for w in words if w not in got}
        new = {p: ids for c in cut.values() for p in c if p and (ids := self.part(p)) is None}
        if new:
            for p, e in zip(new, self.model.encode_batch_fast(list(new), add_special_tokens=False), strict=True):
                new[p] = array("I", e.ids).tobytes()
            self.parts |= new
        known = self.parts
        got |= {w: known[stem] + known[end] if end else known[stem] for w, (stem, end) in cut.items()}
        self.words |= got
        return got

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        for c in "\n\t\r\x0b\x0c":
            if c in text:
                text = text.replace(c, " ")
        words = text.split(" ")
        out = list(map(self.words.get, words))
        if None in out:
            at, i = [], -1
            with contextlib.suppress(ValueError):
                while True:
                    i = out.index(None, i + 1)
                    at.append(i)
            got = self.learn({words[i] for i in at})
            for i in at:
                out[i] = got[words[i]]
        return b"".join(out)


@lru_cache(maxsize=1)
def shared_tokenizer(path: str, cache_words: int, cache_parts: int) -> WordTokenizer:
    """A worker's own; it keeps what it learned from task to task."""
    return WordTokenizer(path, cache_words, cache_parts)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False, cache_words: int = CACHE_WORDS, cache_parts: int = CACHE_PARTS, keep_words: bool = False) -> DataFrame:
    """Pieces of each document's ids and one ``end_id``, in order; ``nth`` counts equal lengths within a partition.

    With ``keep_words`` a worker keeps the words it learned for its next task; else it
    gives their memory back when a task ends. The tokenizer stays.
    """
    tokenizer = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = (shared_tokenizer if keep_words else WordTokenizer)(tokenizer, cache_words, cache_parts)
        seen, part = {}, TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in PIECES]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for i in range(0, len(ids), 4 * capacity):
                    own = ids[i : i + 4 * capacity]
                    n = len(own) // 4
                    nth = seen.get(n, 0)
                    seen[n] = nth + 1
                    for column, value in zip(out, (doc, i // (4 * capacity), i // 4, n, zlib.crc32(own), part, nth, own if keep_ids else None), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], [f.name for f in PIECES])
        del encode
        ngrams.trim()

    limit_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The multiset of available lengths with the greatest sum within ``room``; ``lengths`` descend."""
    if room <= 0:
        return []
    mask, full = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for n in lengths:
        if n > room or not counts[n]:
            continue
        before = reach
        for _ in range(min(counts[n], room // n)):
            grown = (reach | reach << n) & mask
            if grown == reach:
                break
            reach = grown
        steps.append((n, before))
        if reach & full:
            break
    target, chosen = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        while not before >> target & 1:
            chosen.append(n)
            target -= n
    return chosen


def patterns(histogram: dict[int, int], capacity: int) -> Iterator[tuple[int, list[int]]]:
    """(number of bins, lengths in the bin), by minimum bin slack."""
    counts = {n: c for n, c in histogram.items() if c}
    order = sorted(counts, reverse=True)
    while order:
        top = order[0]
        counts[top] -= 1
        own = [top, *fullest(order, counts, capacity - top)]
        counts[top] += 1
        used = {n: own.count(n) for n in set(own)}
        times = min(counts[n] // k for n, k in used.items())
        yield times, own
        for n, k in used.items():
            counts[n] -= times * k
            if not counts[n]:
                del counts[n]
                order.remove(n)


def slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, list[int]]]:
    """(length, first rank, end rank, first bin, places per bin, offsets): ranks of a length fill a pattern's bins in turn."""
    out, used, bins = [], dict.fromkeys(histogram, 0), 0
    for times, own in patterns(histogram, capacity):
        places: dict[int, list[int]] = {}
        offset = 0
        for n in own:
            places.setdefault(n, []).append(offset)
            offset += n
        for n, at in places.items():
            out.append((n, used[n], used[n] + times * len(at), bins, len(at), at))
            used[n] += times * len(at)
        bins += times
    return out


SLOTS = "length long, a long, b long, bin long, per int, at array<long>"


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to materialised pieces with length, part and nth.

    The histogram and the slots have a bound that is independent of the input: at most
    ``capacity`` lengths, and a few patterns each. Pieces of equal length are
    ranked by their partition's offset plus nth, without sorting or shuffling texts.
    """
    spark: SparkSession = pieces.sparkSession
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("c"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(counts.select("length", "part", "c", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("o")))
    histogram = {r["length"]: r["c"] for r in starts.groupBy("length").agg(F.sum("c").alias("c")).collect()}
    table = F.broadcast(spark.createDataFrame(slots(histogram, capacity), SLOTS))
    ranked = join_checked(pieces, starts.drop("c"), ["length", "part"], "inner").withColumn("rank", F.col("o") + F.col("nth"))
    placed = ranked.join(table, "length").where("rank >= a and rank < b")
    return placed.withColumn("sequence_id", (F.col("bin") + F.floor((F.col("rank") - F.col("a")) / F.col("per"))).cast("long")).withColumn(
        "offset", F.element_at("at", (F.pmod(F.col("rank") - F.col("a"), F.col("per").cast("long")) + 1).cast("int"))
    ).drop("o", "rank", "a", "b", "bin", "per", "at", "part", "nth")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False, cache_words: int = CACHE_WORDS, cache_parts: int = CACHE_PARTS, keep_words: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset: a row per piece.

    A null or empty text is its end id alone. Repeated rows are packed once each. A
    longer text is cut into full pieces and a last one; pieces of equal length, which
    are alike to the packing, take the places of their length in the order of
    partitions. Further columns are ignored; no rows give no rows.
    """
    return pack(materialise(token_pieces(docs, tokenizer, capacity, keep_ids=keep_ids, cache_words=cache_words, cache_parts=cache_parts, keep_words=keep_words)), capacity)
