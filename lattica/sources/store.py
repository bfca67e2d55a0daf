"""Stored graphs, review state and findings: reading, checking and writing."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.audit import FINDING, REVIEW, STATUSES
from ..plans.storage import materialise
from ..schema import EDGE, NODE, SCHEMA_VERSION, Graph, GraphError, check_graph, conform

FINDINGS_VERSION = 1


def write_graph(graph: Graph, path: str, header: dict | None = None) -> None:
    """Parquet tables of nodes and edges, and a header of one JSON row."""
    spark = graph.nodes.sparkSession
    conform(graph.nodes, NODE).write.mode("overwrite").parquet(f"{path}/nodes")
    conform(graph.edges, EDGE).write.mode("overwrite").parquet(f"{path}/edges")
    head = json.dumps({"schemaVersion": SCHEMA_VERSION} | (header or {}), sort_keys=True)
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def read_header(spark: SparkSession, path: str) -> dict:
    head = json.loads(spark.read.text(f"{path}/header").first()["value"])
    if head.get("schemaVersion") != SCHEMA_VERSION:
        raise GraphError(f"the graph in {path} has schema version {head.get('schemaVersion')}, not {SCHEMA_VERSION}; build it anew")
    return head


def read_graph(spark: SparkSession, path: str, check: bool = True) -> Graph:
    """A stored graph: its version is checked first, then every edge's ends and sites."""
    read_header(spark, path)
    graph = Graph(spark.read.schema(NODE).parquet(f"{path}/nodes"), spark.read.schema(EDGE).parquet(f"{path}/edges"))
    return check_graph(graph) if check else graph


# Fields left out of JSON where they hold these.
_DEFAULTS = {"cross_trust_boundary": False, "externally_reachable": False, "is_virtual": False, "is_override": False, "is_test": False, "is_mock": False, "synthetic": False, "count": 1}


def compact(row: dict) -> dict:
    """Without nulls, empty arrays and defaults."""
    return {k: v for k, v in row.items() if v is not None and v != [] and not (k in _DEFAULTS and v == _DEFAULTS[k])}


def graph_json(graph: Graph, header: dict | None = None, pretty: bool = False) -> str:
    """The whole graph as one JSON text, for exchange; ids in order, defaults left out."""
    load = lambda df, schema: [compact(json.loads(r["j"])) for r in conform(df, schema).orderBy("id").select(F.to_json(F.struct(*schema.names)).alias("j")).collect()]
    data = {"schemaVersion": SCHEMA_VERSION} | (header or {}) | {"nodes": load(graph.nodes, NODE), "edges": load(graph.edges, EDGE)}
    return json.dumps(data, indent=2 if pretty else None, separators=None if pretty else (",", ":"), ensure_ascii=False) + "\n"


def parse_graph(spark: SparkSession, text: str) -> Graph:
    data = json.loads(text)
    if data.get("schemaVersion") != SCHEMA_VERSION:
        raise GraphError(f"schema version {data.get('schemaVersion')} is not {SCHEMA_VERSION}")
    def table(rows: list[dict], schema: T.StructType, fill: dict) -> DataFrame:
        raw = spark.createDataFrame([(json.dumps(fill | r),) for r in rows], "j string")
        return raw.select(F.from_json("j", schema).alias("x")).select("x.*")

    edges = table(data["edges"], EDGE, {"count": 1, "cross_trust_boundary": False, "possible_targets": []})
    return check_graph(Graph(table(data["nodes"], NODE, {}), edges))


def _compacted(df: DataFrame, schema: T.StructType) -> Column:
    """A row as JSON without nulls, empty arrays and defaults."""
    def kept(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            c = F.when(F.size(c) > 0, c)
        elif f.name in _DEFAULTS:
            c = F.when(c != F.lit(_DEFAULTS[f.name]), c)
        return c.alias(f.name)

    return F.to_json(F.struct(*(kept(f) for f in schema)))


def write_exchange(graph: Graph, path: str, header: dict | None = None) -> None:
    """The graph as text parts below ``path``, a line for each node and edge by id, that are one JSON document when put one after another.

    Lines are sorted over all machines; none of them, and not the driver, holds the whole.
    """
    spark = graph.nodes.sparkSession
    head = json.dumps({"schemaVersion": SCHEMA_VERSION} | (header or {}), ensure_ascii=False)
    frame = spark.createDataFrame([(0, f'{head[:-1]}, "nodes":['), (2, '],"edges":['), (4, "]}")], "section int, value string").withColumn("id", F.lit(""))
    lines = frame
    for section, df, schema in ((1, graph.nodes, NODE), (3, graph.edges, EDGE)):
        own = conform(df, schema)
        first = own.agg(F.min("id").alias("_least"), F.count_if(F.col("id").isNull()).alias("_nulls")).first()
        if first["_nulls"]:
            raise GraphError("a node or edge without an id cannot be exchanged")
        lines = lines.unionByName(own.select(F.lit(section).alias("section"), "id", _compacted(own, schema).alias("value")).withColumn("value", F.when(F.col("id") == F.lit(first["_least"]), F.col("value")).otherwise(F.concat(F.lit(","), "value"))))
    lines.orderBy("section", "id").select("value").write.mode("overwrite").text(path)


def read_exchange(spark: SparkSession, path: str, check: bool = True) -> Graph:
    """A graph of write_exchange's parts, or of one JSON document of any layout, which VARIANT then splits."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    heads = [r["value"] for r in lines.where("value like '%\"schemaVersion\"%\"nodes\":['").limit(2).collect()]
    if len(heads) == 1:
        head = json.loads(heads[0] + "]}")
        each = lines.where("value <> ']}' and value <> '],\"edges\":['").where(F.col("value") != F.lit(heads[0])).select(F.try_parse_json(F.regexp_replace("value", "^,", "")).alias("v"))
        edge = F.try_variant_get("v", "$.from_id", "string").isNotNull()
        read = lambda c, schema: F.when(c, F.from_json(F.to_json("v"), schema))
        each = materialise(each.select(F.col("v").isNull().alias("bad"), edge.alias("is_edge"), read(~edge, NODE).alias("node"), read(edge, EDGE).alias("edge")))  # every line is parsed once
        if not each.where("bad").isEmpty():
            raise GraphError(f"a line in {path} is not JSON")
        nodes, edges = each.where("not is_edge").select("node.*"), each.where("is_edge").select("edge.*")
    else:
        whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
        head = {"schemaVersion": whole.select(F.try_variant_get("v", "$.schemaVersion", "int")).first()[0]}
        part = lambda name: whole.select(F.try_variant_get("v", f"$.{name}", "variant").alias("all")).lateralJoin(spark.tvf.variant_explode(F.col("all").outer())).select(F.col("value").alias("v"))
        table = lambda rows, schema: rows.select(F.from_json(F.to_json("v"), schema).alias("x")).select("x.*")
        nodes, edges = table(part("nodes"), NODE), table(part("edges"), EDGE)
    if head.get("schemaVersion") != SCHEMA_VERSION:
        raise GraphError(f"schema version {head.get('schemaVersion')} is not {SCHEMA_VERSION}")
    fill = {"count": F.lit(1).cast("long"), "cross_trust_boundary": F.lit(False), "possible_targets": F.array().cast("array<string>")}
    graph = Graph(nodes, edges.withColumns({c: F.coalesce(F.col(c), v.cast(edges.schema[c].dataType)) for c, v in fill.items()}))
    return check_graph(graph) if check else graph


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Review state of a flat JSON map by node id; none if the file is absent."""
    file = Path(path)
    data = json.loads(file.read_text()) if file.exists() else {}
    bad = [k for k, v in data.items() if not isinstance(v, dict) or v.get("status") not in ("reviewed", "flagged", "follow-up", "ignored")]
    if bad:
        raise GraphError(f"{path}: {bad[0]} has no valid status")
    rows = [(k, v["status"], v.get("bodyHash", ""), v.get("reviewer"), v.get("note"), v.get("at")) for k, v in sorted(data.items())]
    raw = spark.createDataFrame(rows, "node string, status string, body_hash string, reviewer string, note string, at string")
    return raw.withColumn("at", F.to_timestamp("at"))


def write_reviews(reviews: DataFrame, path: str) -> None:
    """The map, by id, keys in a fixed order."""
    iso = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    out = {}
    for r in reviews.withColumn("at", iso).orderBy("node").collect():
        out[r["node"]] = {k: v for k, v in (("status", r["status"]), ("bodyHash", r["body_hash"]), ("reviewer", r["reviewer"]), ("note", r["note"]), ("at", r["at"])) if v is not None}
    Path(path).write_text(json.dumps(out, indent=2, ensure_ascii=False) + "\n")


_REVIEW = "map<string,struct<status:string,bodyHash:string,reviewer:string,note:string,at:string>>"


def write_review_parts(reviews: DataFrame, path: str) -> None:
    """The same map as text parts below ``path``, a line for each node by id, that are one JSON document when put one after another."""
    iso = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    one = F.to_json(F.create_map("node", F.struct("status", F.col("body_hash").alias("bodyHash"), "reviewer", "note", iso.alias("at"))))
    least = reviews.agg(F.min("node")).first()[0]
    own = reviews.select("node", one.alias("x")).select(F.lit(1).alias("section"), "node", F.concat(F.when(F.col("node") == F.lit(least), "").otherwise(","), F.expr("substring(x, 2, length(x) - 2)")).alias("value"))
    frame = reviews.sparkSession.createDataFrame([(0, "", "{"), (2, "", "}")], "section int, node string, value string")
    frame.unionByName(own).orderBy("section", "node").select("value").write.mode("overwrite").text(path)


def read_review_parts(spark: SparkSession, path: str) -> DataFrame:
    """Review state of write_review_parts, read where the parts lie; a line that is none, or has no valid status, is an error."""
    lines = spark.read.text(path).where("value not in ('{', '}')")
    each = lines.select("value", F.from_json(F.concat(F.lit("{"), F.regexp_replace("value", "^,", ""), F.lit("}")), _REVIEW).alias("m"))
    bad = each.where(F.coalesce(F.size("m"), F.lit(0)) < 1).first()
    if bad:
        raise GraphError(f"{path}: {bad['value'][:80]} is not an entry")
    rows = each.select(F.explode("m").alias("node", "v"))
    bad = rows.where(~F.coalesce(F.col("v.status").isin(*STATUSES), F.lit(False))).first()
    if bad:
        raise GraphError(f"{path}: {bad['node']} has no valid status")
    return rows.select("node", "v.status", F.coalesce("v.bodyHash", F.lit("")).alias("body_hash"), "v.reviewer", "v.note", F.to_timestamp("v.at").alias("at"))


def read_findings(spark: SparkSession, path: str) -> DataFrame | None:
    """Imported findings; None if the file is absent."""
    file = Path(path)
    if not file.exists():
        return None
    data = json.loads(file.read_text())
    if data.get("schemaVersion") != FINDINGS_VERSION:
        raise GraphError(f"{path}: version {data.get('schemaVersion')} is not {FINDINGS_VERSION}")
    rows = [(f["id"], f["check"], f["impact"], f["confidence"], f["description"], [(n["id"], n.get("bodyHash", "")) for n in f["nodes"]], [(x["file"], x["offset"], x["length"]) for x in f["locations"]]) for f in data["findings"]]
    return spark.createDataFrame(rows, FINDING)


def write_findings(findings: DataFrame, path: str, source: dict) -> None:
    rows = [r.asDict(True) for r in findings.orderBy("id").collect()]
    for r in rows:
        r["nodes"] = [{"id": n["id"], "bodyHash": n["body_hash"]} for n in r["nodes"]]
    Path(path).write_text(json.dumps({"schemaVersion": FINDINGS_VERSION, "source": source, "findings": rows}, indent=2, ensure_ascii=False) + "\n")


def audit_files(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """(reviews, findings, warnings) of a project's managed folder; what cannot be read is a warning."""
    notes: list[str] = []
    reviews, findings = spark.createDataFrame([], REVIEW), None
    for name, read in (("review.json", read_reviews), ("findings.json", read_findings)):
        try:
            got = read(spark, f"{root}/.lattica/{name}")
            reviews, findings = (got, findings) if name == "review.json" else (reviews, got)
        except (ValueError, KeyError, TypeError) as e:
            notes.append(f"{name}: {e}")
    return reviews, findings, notes


_ELEMENTS = "array<struct<paths:array<string>,offset:bigint,length:bigint>>"


def read_detectors(spark: SparkSession, text: str) -> DataFrame:
    """Scanner results as (seq, check, impact, confidence, description, elements); a failed run is an error."""
    data = json.loads(text)
    if isinstance(data, dict) and data.get("success") is False:
        raise GraphError(f"the scanner failed: {data.get('error')}")
    found = data if isinstance(data, list) else ((data.get("results") or {}).get("detectors") or [])
    rows = []
    for seq, d in enumerate(found):
        places = []
        for e in d.get("elements") or []:
            m = e.get("source_mapping") or {}
            places.append(([m.get(f"filename_{x}") for x in ("relative", "short", "absolute")], m.get("start"), m.get("length")))
        rows.append((seq, d.get("check"), d.get("impact"), d.get("confidence"), d.get("description"), places))
    return spark.createDataFrame(rows, f"seq long, check string, impact string, confidence string, description string, elements {_ELEMENTS}")


# Source slices

SLICE_BYTES = 24_000


def slice_nodes(nodes: DataFrame, sources: DataFrame, before: int = 0, after: int = 0, limit: int = SLICE_BYTES) -> DataFrame:
    """(id, file, text, first_line, truncated, drifted) of nodes' places in (file, content).

    ``before`` and ``after`` add lines of context. A slice over ``limit`` bytes ends at
    a line; one whose place is beyond the text, or whose text does not hold the
    node's name any more, has drifted.
    """
    s = nodes.where("src is not null").select("id", "name", F.col("src.file").alias("file"), F.col("src.offset").alias("o"), F.col("src.length").alias("l"), F.col("src.line").alias("line"))
    joined = s.join(sources.select("file", "content"), "file")
    raw = F.encode("content", "UTF-8")
    body = F.decode(F.substring(raw, F.col("o").cast("int") + 1, F.col("l").cast("int")), "UTF-8")
    lines = F.split("content", "\n")
    last = F.col("line") + F.size(F.split(body, "\n")) - 1
    first = F.greatest(F.lit(1), F.col("line") - before)
    window = F.array_join(F.slice(lines, first, F.greatest(F.lit(0), F.least(F.size(lines), last + after) - first + 1)), "\n")
    text = window if before or after else body
    over = F.octet_length(text) > limit
    cut = F.regexp_replace(F.decode(F.substring(F.encode(text, "UTF-8"), 1, limit), "UTF-8"), "\n[^\n]*$", "\n")
    drifted = (F.col("o") + F.col("l") > F.length(raw)) | ~F.contains(body, F.col("name"))
    return joined.select("id", "file", F.when(over, cut).otherwise(text).alias("text"), first.alias("first_line"), over.alias("truncated"), drifted.alias("drifted"))
