"""A subset of globs: ``*``, ``**``, ``?`` and ``{a,b}``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str) -> str:
    """An anchored regular expression; ``dir/**`` matches ``dir`` too, and ``**/`` also nothing."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        if glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "(?:/.*)?", i + 3
        elif glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            if c == "{" and "}" in glob[i:]:
                depth, c = depth + 1, "(?:"
            elif c == "}" and depth:
                depth, c = depth - 1, ")"
            elif c == "," and depth:
                c = "|"
            else:
                c = {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
            out, i = out + c, i + 1
    return f"^{out}$"


def matches_any(file: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | file.rlike(glob_to_regex(g))
    return out


def path_filter(file: Column, include: list[str] | None, exclude: list[str] | None) -> Column:
    """Exclusion wins; without inclusions all is included."""
    wanted = matches_any(file, include) if include else F.lit(True)
    return wanted & ~matches_any(file, exclude or [])


def path_matches(path: str, include: list[str] | None, exclude: list[str] | None) -> bool:
    hit = lambda globs: any(re.match(glob_to_regex(g), path) for g in globs)
    return (not include or hit(include)) and not hit(exclude or [])
