"""Node references and the ranked search over nodes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT, HARD_LIMIT, SUGGESTIONS = 20, 50, 8
SPREAD, SPREAD_FLOOR = 2.5, 4
TIERS = ("exact", "name", "prefix", "contains", "path", "fuzzy")


class NodeRefError(LookupError):
    def __init__(self, message: str, candidates: list[str]):
        super().__init__(message)
        self.candidates = candidates


def reference_forms(node_id: Column) -> list[Column]:
    """What may stand for an id, strictest first: itself, without file, without parameters, the bare name."""
    qualified = F.substring_index(node_id, ":", -1)
    member = F.regexp_replace(qualified, r"\(.*$", "")
    return [node_id, qualified, member, F.regexp_replace(member, "^.*[.#]", "")]


def _of_kinds(nodes: DataFrame, kinds: tuple[str, ...] | None) -> DataFrame:
    return nodes if kinds is None else nodes.where(F.col("kind").isin(*kinds))


def resolve_ref(nodes: DataFrame, ref: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(form, id): the hits of the first form with any."""
    forms = reference_forms(F.col("id"))
    form = F.coalesce(*(F.when(f == ref, i) for i, f in enumerate(forms)))
    hits = _of_kinds(nodes, kinds).select(form.alias("form"), "id").where("form is not null")
    best = hits.agg(F.min("form").alias("form"))
    return hits.join(F.broadcast(best), "form")


def require_node(nodes: DataFrame, ref: str, kinds: tuple[str, ...] | None = None) -> str:
    found = sorted(r["id"] for r in resolve_ref(nodes, ref, kinds).limit(HARD_LIMIT).collect())
    if len(found) == 1:
        return found[0]
    if found:
        raise NodeRefError(f'"{ref}" could be {len(found)} nodes: ' + ", ".join(found), found)
    near = suggest(nodes, ref, kinds)
    raise NodeRefError(f'there is no node "{ref}"' + (f"; near it are {', '.join(near)}" if near else ""), near)


def suggest(nodes: DataFrame, ref: str, kinds: tuple[str, ...] | None = None, limit: int = SUGGESTIONS) -> list[str]:
    needle = ref.lower()
    near = F.lower("id").contains(needle) | F.lit(needle).contains(F.lower("name"))
    return [r["id"] for r in _of_kinds(nodes, kinds).where(near).select("id").orderBy("id").limit(limit).collect()]


def span(haystack: Column, needle: str) -> Column:
    """Length of the leftmost greedy match of ``needle`` as a subsequence; 0 if there is none."""
    literal = [re.escape(c) for c in needle]
    pattern = literal[0] + "".join(f"[^{c}]*{c}" for c in literal[1:])
    return F.length(F.regexp_extract(haystack, pattern, 0))


def tier(needle: str) -> Column:
    name, node_id = F.lower("name"), F.lower("id")
    qualified = F.lower(F.regexp_replace(F.substring_index("id", ":", -1), r"\(.*$", ""))
    found = span(qualified, needle)
    tight = (found > 0) & (found <= max(len(needle) + SPREAD_FLOOR, len(needle) * SPREAD))
    return F.when(name == needle, 1).when(name.startswith(needle), 2).when(name.contains(needle), 3).when(node_id.contains(needle), 4).when(tight, 5)


def search(nodes: DataFrame, query: str, limit: int = DEFAULT_LIMIT, kinds: tuple[str, ...] | None = None) -> tuple[DataFrame, int]:
    """(hits, total): hits by tier, then length of id, then id. An empty query has none; placeholders need a ``?``."""
    limit = min(max(1, limit), HARD_LIMIT)
    query = query.strip()
    pool = _of_kinds(nodes, kinds)
    if not query.startswith("?"):
        pool = pool.where("kind <> 'Unresolved'")
    if not query:
        return pool.where(F.lit(False)).select("id", "name", "kind", F.lit("").alias("match")), 0
    exact = resolve_ref(nodes, query, kinds).select("id").limit(2).collect()
    rank = F.when(F.col("id") == exact[0]["id"], 0).otherwise(tier(query.lower())) if len(exact) == 1 else tier(query.lower())
    hits = pool.withColumn("tier", rank).where("tier is not null")
    top = hits.orderBy("tier", F.length("id"), "id").limit(limit)
    return top.select("id", "name", "kind", F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1).alias("match")), hits.count()
