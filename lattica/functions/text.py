"""Text scalars: ids, similarity, paths, escapes, positions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_type(c: Column) -> Column:
    """Runs of white space become one space, none around brackets and commas."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"\s*([(),\[\]])\s*", "$1"))


def normalise_type_name(text: str) -> str:
    return re.sub(r"\s*([(),\[\]])\s*", r"\1", re.sub(r"\s+", " ", text)).strip()


def signature(types: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(types, normalise_type), ","), F.lit(")"))


# What stands between a scope and a name in an id.
SIGILS = {"Function": ".", "StateVariable": ".", "modifier": "#", "Event": "^", "Error": "!", "Struct": "~", "Enum": "~", "UserDefinedValueType": "~"}


def node_id(file: str, scope: str | None, kind: str, name: str, types: list[str] | None = None) -> str:
    """``file:Scope<sigil>name(types)``; at file level a dot is left out."""
    sigil = SIGILS.get(kind, "")
    if scope is None and sigil == ".":
        sigil = ""
    tail = "" if types is None else "(" + ",".join(map(normalise_type_name, types)) + ")"
    return f"{file}:{scope or ''}{sigil}{name}{tail}"


def base_type(text: str) -> str:
    """A type without array brackets and data locations; a mapping stays as it is."""
    text = normalise_type_name(text)
    if text.startswith("mapping"):
        return text
    text = re.sub(r"(\[[^\]]*\])+$", "", re.sub(r"\b(memory|storage|calldata|payable)\b", "", text).strip())
    return text.strip()


def base_type_of(c: Column) -> Column:
    """The same of a column."""
    plain = normalise_type(c)
    bare = F.trim(F.regexp_replace(plain, r"\b(memory|storage|calldata|payable)\b", ""))
    return F.when(plain.startswith("mapping"), plain).otherwise(F.trim(F.regexp_replace(bare, r"(\[[^\]]*\])+$", "")))


def bigrams(word: Column) -> Column:
    low = F.lower(word)
    return F.when(F.length(low) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substring(low, i, F.lit(2))))


def name_similarity(a: Column, b: Column) -> Column:
    """Dice of the multisets of bigrams, without case; equal names 1, of a single letter and different 0."""
    x, y = bigrams(a), bigrams(b)
    times = lambda words, w: F.size(F.filter(words, lambda v: v == w))
    both = F.aggregate(F.array_distinct(x), F.lit(0), lambda acc, w: acc + F.least(times(x, w), times(y, w)))
    total = F.size(x) + F.size(y)
    return F.when(F.lower(a) == F.lower(b), 1.0).when(total == 0, 0.0).otherwise(2.0 * both / total)


def normalise_path(c: Column) -> Column:
    """Collapses ``.`` and ``..``; leading ``..`` stay."""
    def step(out: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(out) > 0) & (F.element_at(F.concat(out, F.array(F.lit(""))), F.greatest(F.size(out), F.lit(1))) != "..")
        return F.when((part == "") | (part == "."), out).when(back, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(F.concat(out, F.array(part)))

    path = F.array_join(F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(c.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)


def normalise_path_text(path: str) -> str:
    out: list[str] = []
    for part in path.split("/"):
        if part == ".." and out and out[-1] != "..":
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return ("/" if path.startswith("/") else "") + "/".join(out)


def body_hash(tokens: Column) -> Column:
    return F.concat(F.lit("b1 "), F.hex(F.xxhash64(F.array_join(tokens, " "))))


def share_text(c: Column) -> Column:
    return F.format_string("%d%%", F.floor(c * 100 + 0.5))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, one).otherwise(many))


def dot_quote(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def xml_escape(text: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = text.replace(a, b)
    return text


def embed_json(text: str) -> str:
    return text.replace("<", "\\u003c")


def utf16_index(text: str, byte_offset: int) -> int:
    """Index in UTF-16 units of a byte offset in the text's UTF-8."""
    return len(text.encode()[:byte_offset].decode(errors="ignore").encode("utf-16-le")) // 2


def line_and_column(text: str, byte_offset: int) -> tuple[int, int]:
    """1-based line and 0-based UTF-16 column of a byte offset."""
    head = text.encode()[:byte_offset].decode(errors="ignore")
    line = head.rpartition("\n")[2]
    return head.count("\n") + 1, len(line.encode("utf-16-le")) // 2


def same_members(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)
