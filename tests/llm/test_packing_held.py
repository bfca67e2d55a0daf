"""What a packing task holds of the words it has learned."""

from __future__ import annotations

import sys

from lattica.llm import packing


def test_learned_words_stay_small_and_ids_right():
    tok = packing.WordTokenizer(packing.default_tokenizer())
    plain = tok.model
    for i in range(0, 130_000, 1000):
        tok(" ".join(f"w{j * 7919:x}q," for j in range(i, i + 1000)))
    kept = (tok.words, tok.older_words, tok.parts, tok.older)
    assert sum(sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items()) for d in kept) < 25 << 20
    text = " ".join(f"w{j * 7919:x}q," for j in (0, 7, 64_000, 129_999))  # let go and still held
    want = plain.encode(text, add_special_tokens=False).ids
    assert tok(text) == b"".join(i.to_bytes(4, "little") for i in want)


def test_a_worker_loads_its_tokenizer_once():
    """A tokenizer that is loaded leaves some MB behind for good, so one a task grows with the input."""
    path = packing.default_tokenizer()
    one, other = packing.WordTokenizer(path), packing.WordTokenizer(path)
    assert one.model is other.model and one.words is not other.words and one.parts is not other.parts
