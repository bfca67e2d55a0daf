"""Source files to parsed units: listing, a parse cache, and the parser on the executors."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import path_filter
from .parser import PARSER_VERSION, parse_source

#: Characters of units that a task holds before it hands them on; a batch of texts on its way to it.
HELD_CHARS, BATCH_BYTES = 4 << 20, "4m"

_SRC = "struct<offset:bigint,length:bigint,line:int,column:int>"
_PARAM = "struct<name:string,type:string,indexed:boolean,storageLocation:string>"
_CALL = f"struct<shape:string,name:string,receiver:string,arg_count:int,has_value:boolean,has_salt:boolean,src:{_SRC}>"
_FLAGS = "struct<hasAssembly:boolean,hasDelegatecall:boolean,hasLowLevelCall:boolean,hasSelfdestruct:boolean,hasCreate:boolean,sendsValue:boolean,hasUnchecked:boolean,hasTryCatch:boolean,readsState:boolean,writesState:boolean,checksSender:boolean>"
_SYMBOL = (
    f"struct<id:string,kind:string,name:string,file:string,scope:string,src:{_SRC},natspec:string,contract_kind:string,base_names:array<string>,subkind:string,visibility:string,state_mutability:string,"
    f"is_virtual:boolean,is_override:boolean,modifier_names:array<string>,params:array<{_PARAM}>,returns:array<{_PARAM}>,has_body:boolean,body_hash:string,interface_hash:string,"
    f"metrics:struct<sloc:int,cyclomatic:int,maxDepth:int>,flags:{_FLAGS},calls:array<{_CALL}>,uses:array<struct<name:string,write:boolean,src:{_SRC}>>,refs:array<struct<kind:string,name:string,src:{_SRC}>>,"
    "locals:array<struct<name:string,type:string>>,type:string,is_constant:boolean,is_immutable:boolean,is_transient:boolean,is_mapping:boolean,is_anonymous:boolean>"
)
UNIT = (
    f"struct<file:string,pragma:string,version_support:string,recovered:boolean,diagnostics:array<string>,imports:array<struct<path:string,symbols:array<struct<name:string,alias:string>>,unit_alias:string,src:{_SRC}>>,"
    f"using:array<struct<library:string,functions:array<string>,type:string,scope:string>>,symbols:array<{_SYMBOL}>>"
)


def read_sources(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, glob: str = "*.sol") -> DataFrame:
    """(file, content, modified): files below a folder that Spark can read, by path relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), F.concat(F.lit("^\\Q"), base, F.lit("\\E/+")), "")
    files = raw.select(path.alias("file"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))
    return files.where(path_filter(F.col("file"), include, exclude))


def sources_of(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(file, content) of a few texts by path."""
    return spark.createDataFrame(sorted(texts.items()), "file string, content string")


def cache_key(version: int = PARSER_VERSION):
    return F.md5(F.concat_ws("\x1f", F.lit(f"parser {version}"), "file", "content"))


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys: list[str] = []
        units: list[str] = []
        held = 0
        for key, file, content in zip(batch["key"], batch["file"], batch["content"], strict=True):
            keys.append(key)
            units.append(json.dumps(parse_source(file, content or "")))
            held += len(units[-1])
            if held > HELD_CHARS:  # units are many times their text
                yield pd.DataFrame({"key": keys, "unit": units})
                keys, units, held = [], [], 0
        if keys:
            yield pd.DataFrame({"key": keys, "unit": units})


def parse_keyed(sources: DataFrame) -> DataFrame:
    """(key, unit JSON) of (file, content, key); batches end at a number of bytes too, and not only at one of files."""
    conf = sources.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return sources.select("file", "content", "key").mapInPandas(_parse, "key string, unit string")


def parse_units(sources: DataFrame, cache: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """(key, unit JSON) of each source; those in ``cache`` are not parsed again.

    The key covers the parser's version, the path and the text.
    """
    keyed = sources.select("file", "content", cache_key().alias("key"))
    fresh = keyed if cache is None else keyed.join(cache.select("key"), "key", "left_anti")
    if partitions:
        fresh = fresh.repartition(partitions, "file")
    parsed = parse_keyed(fresh)
    if cache is None:
        return parsed
    return parsed.unionByName(cache.join(keyed.select("key"), "key", "left_semi").select("key", "unit"))


def units(parsed: DataFrame) -> DataFrame:
    """The units as columns."""
    return parsed.select(F.from_json("unit", UNIT).alias("u")).select("u.*")


def symbols(parsed: DataFrame) -> DataFrame:
    """A row per declaration, in order of file and place; of equal ids the first stays."""
    rows = units(parsed).select(F.posexplode("symbols").alias("pos", "s")).select("pos", "s.*")
    keep = rows.groupBy("id").agg(F.min(F.struct("file", "pos")).alias("k")).select("id", F.col("k.file").alias("file"), F.col("k.pos").alias("pos"))
    return rows.join(keep, ["id", "file", "pos"], "left_semi")


def duplicates(parsed: DataFrame) -> DataFrame:
    """(id, count) of declarations that share an id."""
    return units(parsed).select(F.explode("symbols").alias("s")).groupBy("s.id").agg(F.count("*").alias("count")).where("count > 1")


def diagnostics(parsed: DataFrame) -> DataFrame:
    """(file, message, severity): parse gaps, then files read with best effort or not supported."""
    u = units(parsed)
    gaps = u.select("file", F.explode("diagnostics").alias("message"), F.lit("warning").alias("severity"))
    old = u.where("version_support in ('best-effort', 'unsupported')").select("file", F.concat(F.lit("pragma is "), "version_support", F.lit(": "), "pragma").alias("message"), F.lit("info").alias("severity"))
    return gaps.unionByName(old)


def symbol_stats(parsed: DataFrame) -> DataFrame:
    """One row of counters over declarations and files."""
    s = symbols(parsed)
    kinds = ("Function", "StateVariable", "Event", "Error", "Struct", "Enum", "UserDefinedValueType")
    own = s.agg(
        *(F.count_if((F.col("kind") == "Contract") & (F.col("contract_kind") == k)).alias(f"{k}s") for k in ("contract", "interface", "library", "abstract")),
        *(F.count_if((F.col("kind") == k) & (F.coalesce("subkind", F.lit("")) != "modifier")).alias(k) for k in kinds),
        F.count_if(F.col("subkind") == "modifier").alias("modifiers"), F.count_if("has_body").alias("with_body"),
    )
    files = units(parsed).agg(F.count("*").alias("files"), F.count_if("recovered").alias("files_with_errors"), F.count_if(F.col("version_support") == "best-effort").alias("best_effort"), F.count_if(F.col("version_support") == "unsupported").alias("unsupported"))
    return own.withColumn("_", F.lit(1)).join(files.withColumn("_", F.lit(1)), "_").drop("_")
