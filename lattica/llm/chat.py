"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it as context, then its
own header and reply, of which only the reply is trainable. Turns after the last
assistant turn, or all turns if there is none, end in one example without target,
so that the output holds each conversation whole.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a
backslash is put into any ``<``, backslashes, ``|`` in a row, right before the bar,
which a reader takes out again; a role's line feeds and backslashes are written
``\\n`` and ``\\\\`` first. So no text can hold a control string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
EXAMPLES = "conv_id long, example long, last boolean, formatted string, loss_start long, loss_end long"
#: Characters of examples held before they are handed on.
BATCH_CHARS = 4_000_000


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def turn_string(role: str, text: str) -> str:
    return f"{START}{escape(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n{escape(text)}{END}\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted example."""
    turns = []
    for part in formatted.split(START)[1:]:
        head, _, rest = part.partition("\n")
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head))
        turns.append((role, unescape(rest[: rest.rindex(END)])))
    return turns


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").isNull(), "conv_id", F.col("turn").asc_nulls_last(), "role", "text")


def examples(conversations: DataFrame, target: str = "assistant") -> DataFrame:
    """EXAMPLES of (conv_id, turn, role, text): rows of a conversation by turn.

    Ties of turn go by role, then text, by code point; a null turn comes last and a
    null role or text is empty. Rows with a null conv_id form one conversation.
    Rows are streamed in order: a task holds one conversation's prefix and a batch
    of examples, whatever number of conversations it gets.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        current: object = expand
        prefix, n, pending = "", 0, False

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64())
            names = ("conv_id", "example", "last", "formatted", "loss_start", "loss_end")
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
            out.clear()
            return batch

        held: tuple | None = None  # the last example of the conversation, until it is known to be the last
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if conv != current:
                    if held or pending:
                        out.append((current, n, True, prefix, None, None) if pending else (*held[:2], True, *held[3:]))
                        size += len(prefix)
                    current, prefix, n, pending, held = conv, "", 0, False, None
                written = turn_string(role, text)
                prefix += written
                pending = role != target
                if not pending:
                    if held:
                        out.append(held)
                        size += len(held[3])
                    start = len(prefix) - len(written) + written.index("\n") + 1
                    held = (conv, n, False, prefix, start, len(prefix) - len(END) - 1)
                    n += 1
                elif held:
                    out.append(held)
                    size += len(held[3])
                    held = None
                if size > BATCH_CHARS:
                    size = 0
                    yield flush()
        if held or pending:
            out.append((current, n, True, prefix, None, None) if pending else (*held[:2], True, *held[3:]))
        if out:
            yield flush()

    return _ordered(conversations).mapInArrow(expand, EXAMPLES)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def read_back(formatted: DataFrame) -> DataFrame:
    """DIGEST per conversation of examples as ``examples`` orders them within partitions.

    Each example gives its loss span, the last one of a conversation all its turns.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, count, loss, loss_hash = 0, 0, 0, hashlib.sha256()
        for batch in batches:
            rows = []
            columns = [batch.column(i) for i in range(6)]
            for conv, last, text, start, end in zip(columns[0].to_pylist(), columns[2].to_pylist(), columns[3], columns[4].to_pylist(), columns[5].to_pylist(), strict=True):
                whole = text.as_py()
                chars, count = chars + len(whole), count + 1
                if start is not None:
                    reply = unescape(whole[start:end])
                    loss += len(reply)
                    loss_hash.update(reply.encode())
                if last:
                    turns, turns_hash = parse(whole), hashlib.sha256()
                    for role, said in turns:
                        turns_hash.update(f"{role}\n{said}\n".encode())
                    rows.append((conv, len(turns), turns_hash.hexdigest(), loss, loss_hash.hexdigest(), chars, count))
                    chars, count, loss, loss_hash = 0, 0, 0, hashlib.sha256()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            names = [x.split()[0] for x in DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return formatted.mapInArrow(digest, DIGEST)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """DIGEST of each conversation, formatted and read back.

    A null text is empty; repeated rows are turns of their own. Rows without conv_id are
    no valid input and come out as one conversation. Further columns are ignored; no
    rows give no rows.
    """
    return read_back(examples(conversations))
