"""Text exports of a selection."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dot_quote, embed_json, xml_escape
from ..schema import Graph
from .layers import layers

# How kinds and confidences are drawn.
SHAPES = {"Contract": "box", "Function": "ellipse", "StateVariable": "cylinder", "Event": "cds", "Error": "octagon", "Unresolved": "diamond", "SourceUnit": "folder"}
STYLES = {"semantic": "bold", "heuristic": "solid", "ambiguous": "dashed", "unresolved": "dotted"}
ARROWS = {"semantic": "==>", "heuristic": "-->", "ambiguous": "-.->", "unresolved": "-.->"}
COLOURS = {"Contract": "#4e79a7", "Function": "#59a14f", "StateVariable": "#f28e2b", "Event": "#76b7b2", "Error": "#e15759", "Unresolved": "#bab0ac"}


def _look(column: str, table: dict[str, str], other: str):
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def dot_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.concat(F.lit("  "), dot_quote(F.col("id")), F.lit(" [label="), dot_quote(F.col("name")), F.lit(", shape="), _look("kind", SHAPES, "plaintext"), F.lit("];")).alias("line"))


def dot_edges(edges: DataFrame) -> DataFrame:
    label = F.concat("kind", F.when(F.col("count") > 1, F.concat(F.lit(" ×"), F.col("count").cast("string"))).otherwise(""))
    return edges.select(F.concat(F.lit("  "), dot_quote(F.col("from_id")), F.lit(" -> "), dot_quote(F.col("to_id")), F.lit(" [label="), dot_quote(label), F.lit(", style="), _look("resolution", STYLES, "solid"), F.lit("];")).alias("line"))


def mermaid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A line per edge between the nodes, which are numbered by id. A selection to be drawn is small: it is numbered in one task."""
    alias = nodes.select("id", F.concat(F.lit("n"), F.row_number().over(Window.orderBy("id")) - 1).alias("alias"))
    a, b = (alias.select(F.col("id").alias(k), F.col("alias").alias(v)) for k, v in (("from_id", "_a"), ("to_id", "_b")))
    kind = F.concat("kind", F.coalesce(F.concat(F.lit(":"), "subkind"), F.lit("")))
    times = F.when(F.col("count") > 1, F.concat(F.lit(" x"), F.col("count").cast("string"))).otherwise("")
    return edges.join(a, "from_id").join(b, "to_id").select(F.concat(F.lit("  "), "_a", F.lit(" "), _look("resolution", ARROWS, "-->"), F.lit('|"'), kind, times, F.lit(" ("), "resolution", F.lit(')"| '), "_b").alias("line"))


def to_dot(view: Graph) -> str:
    """A graph drawn by DOT; for selections of a size to be looked at."""
    lines = [r["line"] for part in (dot_nodes(view.nodes), dot_edges(view.edges)) for r in part.orderBy("line").collect()]
    return "\n".join(["digraph selection {", "  rankdir=LR;", *lines, "}", ""])


def to_mermaid(view: Graph) -> str:
    named = view.nodes.select(F.row_number().over(Window.orderBy("id")).alias("n"), "name").orderBy("n").collect()
    heads = [f'  n{r["n"] - 1}["{r["name"]}"]'.replace("\\", "/") for r in named]
    return "\n".join(["flowchart LR", *heads, *(r["line"] for r in mermaid_edges(view.nodes, view.edges).orderBy("line").collect()), ""])


def to_json(view: Graph) -> str:
    """The selection, ids in order, without null and default fields."""
    rows = lambda df: [json.loads(x) for x in df.orderBy("id").select(F.to_json(F.struct(*df.columns))).toPandas().iloc[:, 0]]
    return json.dumps({"nodes": rows(view.nodes), "edges": rows(view.edges)}, indent=2, ensure_ascii=False) + "\n"


#: Widths of a drawing: of a letter, around a name, between layers and between rows.
LETTER, PADDING, GAP, ROW = 7, 12, 60, 60


def _ordered(level: dict[str, int], arcs: list[tuple[str, str]]) -> dict[str, int]:
    """Rows of a drawing's nodes within their layers: by the mean row of what leads to them, then by id."""
    into: dict[str, list[str]] = {}
    for a, b in arcs:
        if level[a] < level[b]:
            into.setdefault(b, []).append(a)
    row: dict[str, int] = {}
    by: dict[int, list[str]] = {}
    for node in sorted(level):
        by.setdefault(level[node], []).append(node)
    for layer in sorted(by):
        mean = {n: sum(row[a] for a in into.get(n, ())) / max(1, len(into.get(n, ()))) for n in by[layer]}
        row |= {n: i for i, n in enumerate(sorted(by[layer], key=lambda n: (mean[n], n)))}
    return row


def to_svg(view: Graph) -> str:
    """A layered drawing of a selection that may be drawn (``views`` refuses larger ones); layers are found in Spark, names are whole."""
    arcs = view.edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    known = view.nodes.select("id")
    arcs = arcs.join(known.toDF("src"), "src", "left_semi").join(known.toDF("dst"), "dst", "left_semi").select("src", "dst")
    level = {r["id"]: r["layer"] for r in layers(view.nodes, arcs).collect()}
    names = {r["id"]: (r["name"] or r["id"], r["kind"]) for r in view.nodes.select("id", "name", "kind").collect()}
    lines = [(r["from_id"], r["to_id"], r["resolution"]) for r in view.edges.select("from_id", "to_id", "resolution").orderBy("from_id", "to_id").collect() if r["from_id"] in level and r["to_id"] in level]
    row = _ordered(level, [(a, b) for a, b, _ in lines])
    wide = {n: len(names[n][0]) * LETTER + PADDING for n in level}
    left, at = {}, 0
    for layer in range(max(level.values(), default=-1) + 1):
        left[layer] = at
        at += max((wide[n] for n in level if level[n] == layer), default=0) + GAP
    place = {n: (left[level[n]], row[n] * ROW) for n in sorted(level)}
    body = []
    for a, b, resolution in lines:
        dash = "" if resolution in ("semantic", "heuristic") else ' stroke-dasharray="4 3"'
        body.append(f'<line x1="{place[a][0] + wide[a]}" y1="{place[a][1] + 15}" x2="{place[b][0]}" y2="{place[b][1] + 15}" stroke="#888"{dash}/>')
    for node, (x, y) in place.items():
        name, kind = names[node]
        body.append(f'<rect x="{x}" y="{y}" width="{wide[node]}" height="30" fill="{COLOURS.get(kind, "#ccc")}"/><text x="{x + PADDING // 2}" y="{y + 19}" font-size="11">{xml_escape(name)}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {at} {(max(row.values(), default=0) + 1) * ROW}">' + "".join(body) + "</svg>\n"


#: Bytes of a self-contained page, and the shares of it up to which maps, contract and call views, inspections and sources may fill it.
HTML_BUDGET, VIEW_SHARE, QUOTAS, INSPECT_SHARE = 12_000_000, 0.4, (("protocol", 0.15), ("contract", 0.35), ("call", 0.5)), 0.7


def budgeted(parts: dict[str, list[tuple[str, str]]], budget: int = HTML_BUDGET) -> dict[str, str]:
    """What fits of (key, JSON) parts by group, in order: views by quota, then inspections, then sources."""
    out: dict[str, str] = {}
    used = 0

    def take(group: str, limit: float) -> None:
        nonlocal used
        for key, text in parts.get(group, []):
            size = len(text.encode())
            if used + size <= limit:
                out[key] = text
                used += size

    limit = 0.0
    for group, share in QUOTAS:
        limit += share * VIEW_SHARE * budget
        take(group, limit)
    take("inspection", INSPECT_SHARE * budget)
    take("source", budget)
    return out


def to_html(parts: dict[str, list[tuple[str, str]]], title: str = "graph", budget: int = HTML_BUDGET) -> str:
    """A page that holds its data; what does not fit the budget is left out and counted."""
    kept = budgeted(parts, budget)
    left = sum(len(v) for v in parts.values()) - len(kept)
    data = embed_json("{" + ",".join(f"{json.dumps(k)}:{v}" for k, v in kept.items()) + "}")
    return f'<!doctype html><meta charset="utf-8"><title>{xml_escape(title)}</title><script type="application/json" id="data">{data}</script><p>{len(kept)} parts, {left} left out.</p>\n'
