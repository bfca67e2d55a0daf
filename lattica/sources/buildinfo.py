"""Build-info files of compilers as rows: texts, syntax trees, layouts, and what they say of names."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import materialise

FACTS = "artifact string, file string, what string, offset bigint, target_file string, target_offset bigint, value string"
_NODE = "artifact string, file string, id bigint, kind string, offset bigint, what string, ref bigint, selector string"
_BATCH = 20_000

# Names of the compiler's format.
_CALLS = {"FunctionCall": "call", "EmitStatement": "emit", "RevertStatement": "revert"}
_INNER = {"EmitStatement": "eventCall", "RevertStatement": "errorCall"}
_SIGNALS = ("EventDefinition", "ErrorDefinition")


def read_build_info(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, text) of build-info files."""
    return spark.read.option("recursiveFileLookup", "true").text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _part(name: str, kind: str = "variant") -> Column:
    return F.try_variant_get("v", f"$.{name}", kind)


def _members(df: DataFrame, column: Column, key: str, value: str) -> DataFrame:
    """A row per member of an object or array; none where it is neither."""
    each = df.withColumn("_of", column).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_of").outer()))
    return each.withColumnsRenamed({"key": key, "value": value}).drop("_of", "pos")


def parsed(texts: DataFrame) -> DataFrame:
    """(artifact, v, error) of (path, text); an error says why a file is of no use.

    A text over VARIANT's 128 MB is refused like one that is not JSON.
    """
    read = texts.select(F.col("path").alias("artifact"), F.try_parse_json("text").alias("v"))
    lacks = lambda c: ~F.coalesce(F.schema_of_variant(c), F.lit("")).startswith("OBJECT")
    error = F.when(lacks(F.col("v")), "not a JSON object").when(lacks(_part("output")), "no output section").when(lacks(_part("output.sources")), "no sources in its output")
    return read.withColumn("error", error)


def _reference(node: object) -> int | None:
    """The declaration that an expression names: its own, its path's, or that of what it wraps."""
    while isinstance(node, dict):
        found = node.get("referencedDeclaration")
        if isinstance(found, int):
            return found
        node = node.get("pathNode") or (node.get("expression") if node.get("nodeType") == "FunctionCallOptions" else node.get("typeName") if node.get("nodeType") == "NewExpression" else None)
    return None


def _listed(node: dict, name: str) -> list:
    found = node.get(name)
    return found if isinstance(found, list) else []


def _said(node: dict) -> Iterator[tuple[str, int | None]]:
    """(what, declaration) that a node of the tree says."""
    kind = node["nodeType"]
    if kind in _CALLS:
        call = node.get(_INNER.get(kind, "")) or node
        yield _CALLS[kind], _reference(call.get("expression")) if isinstance(call, dict) else None
    elif kind == "Identifier":
        yield "variable", _reference(node)
    elif str(kind).endswith(("Definition", "Declaration")):
        yield "declaration", None
        for base in _listed(node, "baseContracts"):
            yield "inherits", _reference(base.get("baseName")) if isinstance(base, dict) else None
        for base in _listed(node, "baseFunctions") + _listed(node, "baseModifiers"):
            yield "base", base if isinstance(base, int) else None
        for use in _listed(node, "modifiers"):
            yield "modifiedBy", _reference(use.get("modifierName")) if isinstance(use, dict) else None


def _walk(artifact: str, file: str, text: str) -> Iterator[tuple]:
    """Rows of one syntax tree, by a stack of its own; what is not as expected is passed over."""
    stack: list[object] = [json.loads(text)]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += node
        elif isinstance(node, dict):
            stack += [x for x in node.values() if isinstance(x, (dict, list))]
            start = str(node.get("src", "")).split(":")[0]
            if isinstance(node.get("nodeType"), str) and start.isdigit():
                own = node.get("id") if isinstance(node.get("id"), int) else None
                selector = node.get("functionSelector")
                for what, ref in _said(node):
                    if what == "declaration" or ref is not None:
                        yield artifact, file, own, node["nodeType"], int(start), what, ref, "0x" + selector if isinstance(selector, str) else None


def tree_rows(units: DataFrame) -> DataFrame:
    """Declarations and references of (artifact, file, ast), a tree at a time and in batches."""
    names = [x.split()[0] for x in _NODE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for b in batches:
            for a, f, t in zip(b["artifact"], b["file"], b["ast"], strict=True):
                for row in _walk(a, f, t):
                    held.append(row)
                    if len(held) == _BATCH:
                        yield pd.DataFrame(held, columns=names).astype({"id": "Int64", "ref": "Int64"})
                        held = []
        yield pd.DataFrame(held, columns=names).astype({"id": "Int64", "ref": "Int64", "offset": "Int64"})

    return units.mapInPandas(run, _NODE)


def facts_of(texts: DataFrame) -> DataFrame:
    """FACTS of (path, text): sources, declarations, selectors, slots, references by class, relations between declarations.

    Trees are split by source, so a large artifact is many rows; names meet their declarations by (artifact, id).
    Texts that are of no use give no facts (``unusable`` names them). A variable's fact needs a variable's declaration,
    and a call's must not be an event's or error's.
    """
    good = materialise(parsed(texts).where("error is null").drop("error"))
    trees = _members(good, _part("output.sources"), "file", "u").select("artifact", "file", F.to_json(F.try_variant_get("u", "$.ast", "variant")).alias("ast")).where("ast is not null")
    said = materialise(tree_rows(trees.repartition("artifact", "file")))
    declared = said.where("what = 'declaration' and id is not null").groupBy("artifact", F.col("id").alias("ref")).agg(F.min(F.struct("file", "offset", "kind")).alias("t"))
    found = said.where("ref is not null").join(declared, ["artifact", "ref"])
    fits = F.when(F.col("what") == "variable", F.col("t.kind") == "VariableDeclaration").when(F.col("what") == "call", ~F.col("t.kind").isin(*_SIGNALS)).otherwise(True)
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda df, what, offset, target=none("string"), at=none("bigint"), value=none("string"): df.select("artifact", "file", what.alias("what"), offset.cast("bigint").alias("offset"), target.alias("target_file"), at.cast("bigint").alias("target_offset"), value.alias("value"))

    inputs = _members(good, _part("input.sources"), "file", "u").withColumn("content", F.try_variant_get("u", "$.content", "string")).where("content is not null")
    contracts = _members(_members(good, _part("output.contracts"), "_file", "u"), F.col("u"), "_name", "c")
    entries = _members(contracts, F.try_variant_get("c", "$.storageLayout.storage", "variant"), "_i", "e")
    entries = entries.select("artifact", *(F.try_variant_get("e", f"$.{n}", t).alias(a) for n, t, a in (("astId", "bigint", "ref"), ("slot", "string", "slot"), ("offset", "bigint", "within")))).distinct()
    slots = entries.join(declared, ["artifact", "ref"]).withColumns({"file": F.col("t.file")})
    return (
        row(inputs, F.lit("source"), none("bigint"), value=F.col("content"))
        .unionByName(row(said.where("what = 'declaration'"), F.col("what"), F.col("offset")))
        .unionByName(row(said.where("what = 'declaration' and selector is not null"), F.lit("selector"), F.col("offset"), value=F.col("selector")))
        .unionByName(row(found.where(fits), F.col("what"), F.col("offset"), F.col("t.file"), F.col("t.offset")))
        .unionByName(row(slots, F.lit("slot"), F.col("t.offset"), at=F.col("within"), value=F.col("slot")))
    )


def unusable(texts: DataFrame) -> DataFrame:
    """(artifact, error) of texts without facts: not JSON, no output, no sources, or no syntax tree in them."""
    read = parsed(texts)
    trees = _members(read.where("error is null"), _part("output.sources"), "file", "u")
    bare = trees.groupBy("artifact").agg(F.count(F.try_variant_get("u", "$.ast", "variant")).alias("n")).where("n = 0")
    return read.where("error is not null").select("artifact", "error").unionByName(bare.select("artifact", F.lit("no syntax trees in its output").alias("error")))
