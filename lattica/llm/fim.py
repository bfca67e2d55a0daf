"""Fill-in-middle examples by ropes.

A text is a rope: a balanced tree whose leaves hold a stretch of it and cache its
units (runs of letters, or any other single character) and its code points. The rope
is split at two ranks of units, and the three parts are concatenated in another
order, with sentinels between them; no text is copied but the two leaves that a split
falls into. To invert it, a rope of the written output is split at the code points
where the sentinels stand, and the parts are put back in order.

A text that holds a sentinel stays plain, so the first of each in an output is the
one that was put there, and the inverse is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, text_or_empty

SENTINELS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are rearranged, and of 100 of those so many with the suffix first.
FIM_PERCENT, SPM_PERCENT = 90, 20
#: Code points of a leaf; one that ends in a run of letters holds the whole run.
LEAF = 2048

_RUN = re.compile("[A-Za-z]+")
_UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
_REST = re.compile("[A-Za-z]*")


def units_of(text: str) -> int:
    return len(_RUN.sub("a", text))


class Leaf:
    __slots__ = ("points", "text", "units")

    def __init__(self, text: str):
        self.text, self.units, self.points = text, units_of(text), len(text)


class Join:
    __slots__ = ("left", "points", "right", "units")

    def __init__(self, left: Leaf | Join, right: Leaf | Join):
        self.left, self.right = left, right
        self.units, self.points = left.units + right.units, left.points + right.points


Rope = Leaf | Join | None


def join(*parts: Rope) -> Rope:
    out = None
    for part in parts:
        out = part if out is None else out if part is None else Join(out, part)
    return out


def rope_of(text: str, leaf: int = LEAF) -> Rope:
    """A balanced rope; no run of letters lies in two leaves."""
    leaves, at = [], 0
    while at < len(text):
        to = min(at + leaf, len(text))
        if text[to - 1].isascii() and text[to - 1].isalpha():
            to = _REST.match(text, to).end()
        leaves.append(Leaf(text[at:to]))
        at = to
    while len(leaves) > 1:
        leaves = [join(*leaves[i : i + 2]) for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else None


def _place(leaf: Leaf, rank: int, by: str) -> int:
    if by == "points":
        return rank
    return next(islice(_UNIT.finditer(leaf.text), rank - 1, None)).end()


def split(rope: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first ``rank`` units (or code points, ``by`` "points") of a rope, and the rest."""
    if rope is None or rank <= 0:
        return None, rope
    if rank >= getattr(rope, by):
        return rope, None
    if isinstance(rope, Leaf):
        at = _place(rope, rank, by)
        return Leaf(rope.text[:at]), Leaf(rope.text[at:])
    first = getattr(rope.left, by)
    if rank <= first:
        left, right = split(rope.left, rank, by)
        return left, join(right, rope.right)
    left, right = split(rope.right, rank - first, by)
    return join(rope.left, left), right


def text_of(rope: Rope) -> str:
    out, todo = [], [rope]
    while todo:
        node = todo.pop()
        if isinstance(node, Join):
            todo += [node.right, node.left]
        elif node is not None:
            out.append(node.text)
    return "".join(out)


def rearrange(rope: Rope, form: str, cut1: int, cut2: int) -> tuple[str, int, int]:
    """(output, code points of the prefix, of the middle): the rope cut after ``cut1`` and ``cut2`` units."""
    head, suffix = split(rope, cut2)
    prefix, middle = split(head, cut1)
    p, s, m = (Leaf(x) for x in SENTINELS)
    out = join(p, prefix, s, suffix, m, middle) if form == "psm" else join(s, suffix, p, prefix, m, middle)
    return text_of(out), prefix.points if prefix else 0, middle.points if middle else 0


def restore(output: str, form: str) -> str:
    """The text that an output of rearrange was made of."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at2 = output.index(second, len(first))
    at3 = output.index(MIDDLE, at2 + len(second))
    rest, middle = split(rope_of(output), at3, "points")
    one, two = split(rest, at2, "points")
    one, two, middle = (split(part, len(mark), "points")[1] for part, mark in ((one, first), (two, second), (middle, MIDDLE)))
    return text_of(join(one, middle, two) if form == "psm" else join(two, middle, one))


def drawn(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def example_of(doc_id: int | None, text: str, seed: int = 1, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple:
    """(units, form, prefix_chars, middle_chars, output) of one document."""
    rope = rope_of(text)
    n = rope.units if rope else 0
    h1, h2, h3, h4 = drawn(doc_id, seed)
    if not text or h3 % 100 >= fim_percent or any(mark in text for mark in SENTINELS):
        return n, "plain", None, None, text
    form = "spm" if h4 % 100 < spm_percent else "psm"
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    output, prefix, middle = rearrange(rope, form, *cuts)
    return n, form, prefix, middle, output


EXAMPLE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, seed: int = 1, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: an example per row of ``docs``.

    A null text counts as empty, and an empty one stays plain, as does one that holds a
    sentinel. A long text is rearranged whole. Rows that repeat a doc_id draw alike; a
    null doc_id draws as an empty one. Further columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(doc, *example_of(doc, text, seed, fim_percent, spm_percent)) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = list(zip(*made, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in EXAMPLE.split(", ")])

    limit_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, EXAMPLE)


def restored(examples: DataFrame) -> DataFrame:
    """``examples`` with restored: the text rebuilt from output and form alone."""
    names = examples.columns
    at_form, at_output = names.index("form"), names.index("output")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in examples.schema)}, restored string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restore(o, f) for o, f in zip(batch.column(at_output).to_pylist(), batch.column(at_form).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "restored"])

    return examples.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256).alias(f"{c}_sha256")
    return restored(fill_in_middle(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))
