"""A task of the parser holds few units at once, whatever its batches are."""

from __future__ import annotations

import pandas as pd

from lattica.sources import ingest


def test_units_are_handed_on_within_a_batch(monkeypatch):
    monkeypatch.setattr(ingest, "HELD_CHARS", 5_000)
    texts = [f"contract C{i} {{ function f{i}() public {{ }} }}" for i in range(40)]
    batch = pd.DataFrame({"file": [f"{i}.sol" for i in range(40)], "content": texts, "key": [str(i) for i in range(40)]})
    frames = list(ingest._parse(iter([batch, batch.head(0)])))
    assert len(frames) > 5 and max(sum(map(len, f["unit"])) for f in frames) < 12_000
    assert [k for f in frames for k in f["key"]] == [str(i) for i in range(40)]
