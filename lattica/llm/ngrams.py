"""Word shingles of whole Arrow columns, by array operations over their UTF-8 bytes."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text worked on at once; a longer text is worked on whole.
CHUNK = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_PLACE = _rng.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_BASE, _TAG = np.uint64(0x9E6C63D0876A9A4B | 1), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_power: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _power or len(_power["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _power[name] = np.multiply.accumulate(steps)
    return _power["up"][:n], _power["down"][:n]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts (byte ends ``ends``) and each text's number of words."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = np.unique(ends[:-1])
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up, out=total[1:])
    hashes = mixed((total[e + 1] - total[s]) * down[s] + (e - s).astype(np.uint64) * _TAG)
    upto = np.searchsorted(s, ends)
    return hashes, np.diff(upto, prepend=0)


def shingles(words: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each run of ``width`` words; a shorter text's words are one run, no words none."""
    starts = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), counts)
    runs = max(0, len(words) - width + 1)
    acc = np.zeros(runs, np.uint64)
    for j in range(width):
        acc += words[j : j + runs] * _PLACE[j]
    whole = text[:runs] == text[width - 1 :] if runs else np.empty(0, bool)
    hashes, number = mixed(acc[whole]), text[:runs][whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        acc = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            has = counts[short] > j
            acc[has] += words[starts[short[has]] + j] * _PLACE[j]
        hashes = np.concatenate([hashes, mixed(acc + counts[short].astype(np.uint64) * _TAG)])
        number = np.concatenate([number, short])
    return hashes, number


def chunks(column: pa.Array, size: int = CHUNK):
    """(bytes, ends, first row, rows) of parts of a string column, at row limits, of about ``size`` bytes."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield data[offsets[row] : offsets[to]], offsets[row + 1 : to + 1] - offsets[row], row, to - row
        row = to


def trim() -> None:
    """Gives freed memory back: idle Python workers stay alive beside those that work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
