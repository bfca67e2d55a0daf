"""Record types, closed sets of names and their ranks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 5

# The closed sets of the data model.
NODE_KINDS = ("SourceUnit", "Contract", "Function", "StateVariable", "Event", "Error", "Struct", "Enum", "UserDefinedValueType", "Unresolved")
EDGE_KINDS = ("calls", "inherits", "overrides", "implements", "reads", "writes", "emits", "reverts", "modifiedBy", "creates", "declares")
CALL_KINDS = ("calls", "creates")
STRUCTURAL_KINDS = ("declares",)
CALL_SUBKINDS = ("internal", "external", "library", "super", "delegatecall", "lowlevel")
EXTERNAL_SUBKINDS = ("external", "delegatecall", "lowlevel")
RESOLUTIONS = ("semantic", "heuristic", "ambiguous", "unresolved")
VISIBILITIES = ("public", "external", "internal", "private", "default")
MUTABILITIES = ("pure", "view", "nonpayable", "payable")
CATEGORIES = ("low-level", "function-pointer", "dynamic-receiver", "unattached-member", "not-found")
FLAGS = (
    "hasAssembly", "hasDelegatecall", "hasLowLevelCall", "hasSelfdestruct", "hasCreate", "sendsValue",
    "hasUnchecked", "hasTryCatch", "readsState", "writesState", "checksSender",
)
DANGEROUS = ("hasAssembly", "hasDelegatecall", "hasLowLevelCall", "hasSelfdestruct", "hasCreate", "hasUnchecked")
ACCESS_RANK = {"none": 0, "low": 1, "high": 2}

SITE = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()),
])
PARAM = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("indexed", T.BooleanType()), T.StructField("storageLocation", T.StringType())])
_S, _B, _AS = T.StringType(), T.BooleanType(), T.ArrayType(T.StringType())
METRICS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("sloc", "cyclomatic", "maxDepth")])
FLAG_STRUCT = T.StructType([T.StructField(n, _B) for n in FLAGS])
ACCESS = T.StructType([T.StructField("modifiers", _AS), T.StructField("confidence", _S)])
REENTRANCY = T.StructType([T.StructField("externalCallThenWrite", _B), T.StructField("guarded", _B)])

NODE = T.StructType([
    T.StructField(name, kind)
    for name, kind in {
        "id": _S, "kind": _S, "name": _S, "file": _S, "scope": _S, "src": SITE,
        "pragma": _S, "version_support": _S, "recovered": _B, "unresolved_imports": _AS,
        "contract_kind": _S, "base_names": _AS, "linearized_bases": _AS, "linearization_certainty": _S, "is_fully_implemented": _B, "is_test": _B, "is_mock": _B, "natspec": _S,
        "subkind": _S, "visibility": _S, "state_mutability": _S, "is_virtual": _B, "is_override": _B, "modifiers": _AS,
        "params": T.ArrayType(PARAM), "returns": T.ArrayType(PARAM), "has_body": _B, "selector": _S, "body_hash": _S, "interface_hash": _S,
        "metrics": METRICS, "flags": FLAG_STRUCT, "externally_reachable": _B, "entrypoints": _AS, "access_control": ACCESS, "reentrancy": REENTRANCY,
        "type": _S, "is_constant": _B, "is_immutable": _B, "is_transient": _B, "is_mapping": _B, "slot": _S, "slot_offset": T.IntegerType(),
        "is_anonymous": _B, "synthetic": _B, "category": _S, "reason": _S,
    }.items()
])

EDGE = T.StructType([
    T.StructField(name, kind)
    for name, kind in {
        "id": _S, "kind": _S, "subkind": _S, "from_id": _S, "to_id": _S, "resolution": _S, "sites": T.ArrayType(SITE), "count": T.LongType(),
        "possible_targets": _AS, "cross_trust_boundary": _B, "linearization_index": T.IntegerType(), "reason": _S,
    }.items()
])

DRAFT = T.StructType([
    T.StructField(name, kind)
    for name, kind in {
        "seq": T.LongType(), "kind": _S, "subkind": _S, "from_id": _S, "to_id": _S, "resolution": _S, "site": SITE,
        "targets": _AS, "cross_trust_boundary": _B, "linearization_index": T.IntegerType(), "reason": _S,
    }.items()
])


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


class GraphError(ValueError):
    """A graph that breaks its own rules."""


class ViewError(ValueError):
    """A view that cannot be drawn, with what to do instead."""


def kind_is(*kinds: str) -> Column:
    """Whether an edge is of one of ``kinds``, as equalities: parts of a graph with other kinds alone are left out before they are made."""
    return reduce(lambda a, b: a | b, (F.col("kind") == k for k in kinds))


def rank_of(column: str | Column, names: tuple[str, ...]) -> Column:
    """The position of a name in a closed set; unknown names come last."""
    c = F.col(column) if isinstance(column, str) else column
    out = None
    for i, name in enumerate(names):
        out = F.when(c == name, i) if out is None else out.when(c == name, i)
    return out.otherwise(len(names))


def named(rank: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), rank + 1)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``; missing ones are null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def check_graph(graph: Graph) -> Graph:
    """Raises if an edge lacks a site or an endpoint."""
    ends = graph.edges.select("id", F.explode(F.array("from_id", "to_id")).alias("end"))
    lost = ends.join(graph.nodes.select(F.col("id").alias("end")), "end", "left_anti").first()
    if lost:
        raise GraphError(f'edge "{lost["id"]}" refers to "{lost["end"]}", which is not a node')
    bare = graph.edges.where(F.coalesce(F.size("sites"), F.lit(0)) < 1).first()
    if bare:
        raise GraphError(f'edge "{bare["id"]}" has no site')
    return graph
