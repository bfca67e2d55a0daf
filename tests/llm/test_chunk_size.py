"""Parts of a text column are as small as they are asked for, and miss nothing."""

from __future__ import annotations

import pyarrow as pa

from lattica.llm import char_model, ngrams


def test_chunks_end_at_the_size_asked_for():
    texts = ["ab" * 20, "", "x" * 500, *["äbc"] * 60]
    parts = list(ngrams.chunks(pa.array(texts), 100))
    assert b"".join(p[0].tobytes() for p in parts).decode() == "".join(texts) and sum(p[3] for p in parts) == len(texts)
    assert all(len(p[0]) <= 100 or p[3] == 1 for p in parts) and char_model.CHUNK < ngrams.CHUNK
