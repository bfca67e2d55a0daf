"""License scans by patience alignment.

Words unique to both the text and a license template are anchors; the longest
increasing subsequence of their positions in the text is kept, and the gaps between
anchors are aligned in the same way. Coverage is the share of the template's words
aligned. Ends that match word by word are aligned before anchors are sought.

A text that has fewer of the template's words than the coverage asks for is not
aligned. Any other is aligned as a whole, and again in spans, as copies take each
other's anchors: a match of coverage c leaves out at most (1 - c) of the template's
words, so of one more of its distinct words than that, it holds at least one. Spans
are laid around all places of the rarest ones.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches

COVERAGE = 0.8
#: The notices and license texts scanned for, by SPDX identifier.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    where: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        back[i] = where[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(v)
            where.append(i)
        else:
            tops[pile], where[pile] = v, i
    out, i = [], where[-1] if where else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of (template, text) positions, increasing in both."""
    pairs, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((c, a))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((d, b))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        at = {w: i for i, w in enumerate(text[a:b], a) if here[w] == 1}
        anchors = [(j, at[w]) for j, w in enumerate(template[c:d], c) if there[w] == 1 and w in at]
        kept = [anchors[i] for i in longest_increasing([t for _, t in anchors])]
        if not kept:
            continue
        pairs += kept
        edges = [(c - 1, a - 1), *kept, (d, b)]
        todo += [(t0 + 1, t1, m0 + 1, m1) for (m0, t0), (m1, t1) in zip(edges, edges[1:], strict=False)]
    return sorted(pairs)


def windows(places: dict[str, list[int]], template: list[str], coverage: float, length: int) -> list[tuple[int, int]]:
    """Spans to align; none if no alignment of any span can reach ``coverage``.

    The whole text is one. Copies side by side leave no word unique in it, so each
    place of a word is also tried alone: as far as the word's next places, however far,
    where it is unique; in windows of once and twice the template's length to either
    side; and just where a copy without insertions would be. Windows merged where they
    overlap come on top.
    """
    n, need = len(template), Counter(template)
    if sum(min(k, len(places.get(w, ()))) for w, k in need.items()) < coverage * n:
        return []
    rare = sorted(need, key=lambda w: (len(places.get(w, ())), w))
    left_out, chosen = n - math.ceil(coverage * n - 1e-9), []
    for w in rare:
        chosen.append(w)
        left_out -= need[w]
        if left_out < 0:
            break
    spans: list[tuple[int, int]] = []
    for p in sorted(p for w in chosen for p in places.get(w, ())):
        a, b = max(0, p - 2 * n), min(length, p + 2 * n + 1)
        if spans and a < spans[-1][1] and b - spans[-1][0] <= 6 * n:
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
    alone = {(0, length), *spans}
    for w in chosen:
        at, k = places.get(w, []), need[w]
        offsets = [m for m, x in enumerate(template) if x == w]
        for i, p in enumerate(at):
            a, b = max(0, p - 2 * n), min(length, p + 2 * n + 1)
            alone.add((a, b))
            alone.add((at[i - k] + 1 if i >= k else 0, at[i + k] if i + k < len(at) else length))
            alone.add((max(0, p - n), min(length, p + n + 1)))
            alone.update((max(0, p - m), min(length, p - m + n)) for m in offsets)
    return sorted(alone)


def scan(text: str, templates: dict[str, list[str]], coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, first and last word of the best match, number of words aligned), best place of each."""
    said = words(text)
    vocabulary = {w for t in templates.values() for w in t}
    places: dict[str, list[int]] = {}
    for i, w in enumerate(said):
        if w in vocabulary:
            places.setdefault(w, []).append(i)
    out = []
    for name, template in templates.items():
        best: tuple = ()
        for a, b in windows(places, template, coverage, len(said)):
            pairs = align(said[a:b], template)
            if pairs and len(pairs) >= coverage * len(template):
                first, last = a + pairs[0][1], a + pairs[-1][1]
                best = max(best, (len(pairs), first - last, -first, last))
        if best:
            out.append((name, best[0] / len(template), -best[2], best[3], best[0]))
    return out


FOUND = "doc_id long, license string, coverage double, first_word long, last_word long, aligned long"


def scan_licenses(docs: DataFrame, notices: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """FOUND: a row per document and license aligned to at least ``coverage``.

    Null and empty texts have none; equal matches resolve to the tightest, then the
    first. A long text is aligned whole. Repeated rows are reported each. Further
    columns are ignored; no rows give no rows.
    """
    templates = {k: words(v) for k, v in (notices or NOTICES).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, *found) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for found in scan(text.as_py() or "", templates, coverage)]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in FOUND.split(", ")])

    limit_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)
