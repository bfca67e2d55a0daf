"""Version pragmas: the newest compiler that a file admits, and how well it is supported."""

from __future__ import annotations

#: From these versions of 0.x on, files are supported, or read with best effort.
SUPPORTED, BEST_EFFORT = (0, 8, 0), (0, 5, 0)
_SIGNS = "<>=^~"


def comparators(pragma: str) -> list[tuple[str, tuple[int, int, int]]]:
    """(sign, version) of each comparator; a version of two numbers has patch 0, and what is no version is passed over."""
    spaced = ""
    for c in pragma.replace("||", " "):
        spaced += f" {c}" if c in _SIGNS and spaced[-1:] not in ("<", ">") else c
    out, sign = [], ""
    for word in spaced.split():
        number = word.lstrip(_SIGNS)
        sign = word[: len(word) - len(number)] or sign
        if not number:
            continue
        parts = number.split(".")
        if 2 <= len(parts) <= 3 and all(p.isdigit() for p in parts):
            major, minor, patch = (*map(int, parts), 0)[:3]
            out.append((sign, (major, minor, patch)))
        sign = ""
    return out


def ceiling(pragma: str) -> tuple[int, int, int] | None:
    """The first version beyond all comparators, the least of their bounds; None if nothing bounds them."""
    bounds = []
    for sign, (major, minor, patch) in comparators(pragma):
        if sign == "<":
            bounds.append((major, minor, patch))
        elif sign == "~" or sign == "^" and not major:
            bounds.append((major, minor + 1, 0))
        elif sign in ("", "=", "<="):
            bounds.append((major, minor, patch + 1))
    return min(bounds, default=None)


def support_of(pragma: str | None) -> str:
    if pragma is None or not comparators(pragma):
        return "unknown"
    top = ceiling(pragma)
    if top is None or top > SUPPORTED:
        return "supported"
    return "best-effort" if top > BEST_EFFORT else "unsupported"
