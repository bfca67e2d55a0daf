"""Tokens of Solidity source, with byte positions."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<doc>///[^\n]*|/\*\*(?!/).*?\*/)|(?P<comment>//[^\n]*|/\*.*?\*/|/\*.*\Z)
    |(?P<string>(?:hex|unicode)?(?:"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'))|(?P<number>0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][-+]?\d+)?|\.\d+)
    |(?P<name>[A-Za-z_$][\w$]*)|(?P<op>>>>=|>>>|<<=|>>=|\*\*|=>|->|:=|\+\+|--|&&|\|\||[-+*/%&|^<>=!]=|<<|>>|.)""",
    re.X | re.S,
)


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


class Positions:
    """Byte offsets, lines and UTF-16 columns of character positions."""

    def __init__(self, text: str):
        self.text = text
        self.ascii = text.isascii()
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        if not self.ascii:
            self.bytes = [0, *accumulate(len(c.encode("utf-8", "replace")) for c in text)]

    def byte(self, at: int) -> int:
        return at if self.ascii else self.bytes[at]

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def ref(self, start: int, end: int) -> dict:
        line = self.line(start)
        head = self.text[self.lines[line - 1] : start]
        column = len(head) if self.ascii else len(head.encode("utf-16-le", "replace")) // 2
        return {"offset": self.byte(start), "length": self.byte(end) - self.byte(start), "line": line, "column": column}


def tokenize(text: str) -> tuple[list[Token], list[Token]]:
    """Tokens, and doc comments apart; nothing is ever refused."""
    tokens, docs = [], []
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "doc":
            docs.append(Token(kind, m[0], m.start(), m.end()))
        elif kind not in ("space", "comment"):
            tokens.append(Token(kind, m[0], m.start(), m.end()))
    return tokens, docs
