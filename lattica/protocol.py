"""The requests a viewer makes, decoded strictly and answered from a graph: meta, view, node, audit state, search, source."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import audit, inspect, search, views
from .schema import NODE_KINDS, Graph
from .sources import store

VIEWS = ("protocol", "contract", "call", "state-access", "inheritance")


class RequestError(ValueError):
    """A request that cannot be understood; ``status`` is the HTTP code for it."""

    status = 400


def _int(params: dict, key: str, least: int = 0) -> int | None:
    raw = params.get(key)
    if raw is None:
        return None
    if not str(raw).isdigit() or int(raw) < least:
        raise RequestError(f'"{key}" has to be a whole number from {least}')
    return int(raw)


def _flag(params: dict, key: str) -> bool:
    raw = str(params.get(key, "false")).lower()
    if raw not in ("true", "false", "1", "0"):
        raise RequestError(f'"{key}" has to be true or false')
    return raw in ("true", "1")


def _list(params: dict, key: str, allowed: tuple[str, ...] | None = None) -> list[str] | None:
    raw = params.get(key)
    if raw is None:
        return None
    items = [x for x in (raw.split(",") if isinstance(raw, str) else list(raw)) if x != ""]
    if allowed is not None and (bad := [x for x in items if x not in allowed]):
        raise RequestError(f'"{bad[0]}" is no value of "{key}"')
    return items


@dataclass(frozen=True)
class ViewRequest:
    view: str
    focus: str | None = None
    include_tests: bool = False
    up: int = views.CALLS_UP
    down: int = views.CALLS_DOWN
    expand: frozenset[str] | None = field(default=None)

    @classmethod
    def decode(cls, params: dict) -> "ViewRequest":
        view = params.get("view", "protocol")
        if view not in VIEWS:
            raise RequestError(f'there is no view "{view}"')
        up, down, expand = _int(params, "up"), _int(params, "down"), _list(params, "expand")
        return cls(view, params.get("focus") or None, _flag(params, "includeTests"), views.CALLS_UP if up is None else up, views.CALLS_DOWN if down is None else down, None if expand is None else frozenset(expand))


def meta(header: dict) -> dict:
    """What a header says about its graph, named field by field; never nodes or edges."""
    return {k: header[k] for k in ("schemaVersion", "mode", "modeReason", "kind", "files") if k in header}


def answer_view(graph: Graph, request: ViewRequest) -> Graph:
    focus = search.require_node(graph.nodes, request.focus) if request.focus else None
    chosen = views.select_view(graph, request.view, focus, request.include_tests, request.up, request.down)
    return views.aggregate(chosen, None if request.expand is None else sorted(request.expand))


def answer_node(graph: Graph, node: str) -> DataFrame:
    return inspect.inspect_node(graph, search.require_node(graph.nodes, node))


def answer_search(graph: Graph, params: dict) -> dict:
    kinds = _list(params, "kinds", NODE_KINDS)
    limit = _int(params, "limit", 1) or search.DEFAULT_LIMIT
    hits, total = search.search(graph.nodes, params.get("q", ""), limit, tuple(kinds) if kinds else None)
    rows = [r.asDict() for r in hits.collect()]
    return {"hits": rows, "total": total, "capped": total > len(rows), "limit": min(limit, search.HARD_LIMIT)}


def answer_audit(graph: Graph, reviews: DataFrame, findings: DataFrame) -> DataFrame:
    return audit.audit_projection(reviews, findings, graph.nodes)


def answer_source(graph: Graph, sources: DataFrame, params: dict) -> dict:
    """A node's text; only files of the graph are read, so a path cannot lead elsewhere."""
    node = search.require_node(graph.nodes, params.get("node", ""))
    context = _int(params, "context") or 0
    row = store.slice_nodes(graph.nodes.where(F.col("id") == node), sources, context, context).first()
    if row is None:
        raise RequestError(f'"{node}" has no source')
    return row.asDict()


def dehydrate(views_: dict[str, Graph]) -> tuple[list[dict], dict[str, list[str]]]:
    """(node table, node ids by view): nodes that several views share are written once."""
    table: dict[str, dict] = {}
    ids: dict[str, list[str]] = {}
    for name, view in views_.items():
        rows = [json.loads(r["j"]) for r in view.nodes.orderBy("id").select(F.to_json(F.struct(*view.nodes.columns)).alias("j")).collect()]
        table |= {r["id"]: r for r in rows}
        ids[name] = [r["id"] for r in rows]
    return [table[k] for k in sorted(table)], ids
