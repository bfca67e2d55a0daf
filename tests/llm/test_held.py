"""What tasks of the character model hold at once."""

from __future__ import annotations

import numpy as np

from lattica.llm import char_model


def test_rows_of_requests_are_small():
    """A page of a file is 100 rows at least, in memory whole in reader and writer."""
    n = 60_000
    hi, lo = np.zeros(n, np.int64), np.arange(n, dtype=np.int64)
    out = char_model._requests(0, 0, hi, lo, np.zeros(n, np.int64), np.zeros(n, np.int64), 1)
    assert max(len(b) for c in ("hi", "lo") for b in out.column(c).to_pylist()) <= 1 << 17
    assert sorted(np.frombuffer(b"".join(out.column("lo").to_pylist()), np.int64).tolist()) == lo.tolist()


def test_part_keeps_keys_and_values_only():
    shard, rng = char_model._Shard(), np.random.default_rng(3)
    tag, hi, lo = (rng.integers(0, 1 << 20, 500) for _ in range(3))
    value = rng.random(500)
    for i in (0, 250):
        shard.add(tag[i : i + 250], hi[i : i + 250], lo[i : i + 250], value[i : i + 250])
    assert all(len(x) == 2 for x in shard.held)
    shard.close()
    assert shard.of(hi, lo, tag).tolist() == value.tolist() and shard.of(hi + 1, lo, tag).tolist() == [0.0] * 500
    assert char_model._Shard().held and not shard.held
