"""What a compiler's artifacts say: certain targets for drafts, selectors and slots."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import materialise
from ..sources.buildinfo import FACTS, facts_of, read_build_info, unusable


def discover(root: str, out: str = "out") -> list[str]:
    """Build-info files of a project, in order of path."""
    folders = dict.fromkeys([out, "out", "artifacts"])
    return sorted(str(p) for f in folders for p in (Path(root) / f / "build-info").glob("*.json"))


def read_artifacts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """FACTS of build-info files, read where Spark reads them; files that are of no use give none."""
    return facts_of(read_build_info(spark, paths)) if paths else spark.createDataFrame([], FACTS)


@dataclass
class Overlay:
    """Facts of the artifacts that own a file: the first by path whose copy is the file's text, byte for byte."""

    facts: DataFrame
    sources: DataFrame
    symbols: DataFrame
    notes: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        copies = self.facts.where("what = 'source'").select("artifact", "file", F.md5("value").alias("m"))
        own = copies.join(self.sources.select("file", F.md5("content").alias("m")), ["file", "m"])
        self.owners = materialise(own.groupBy("file").agg(F.min("artifact").alias("artifact")))
        self.claimed = copies.select("file").distinct()
        self.used = materialise(self.facts.where("what <> 'source'").join(self.owners, ["file", "artifact"], "left_semi"))
        changed = copies.join(self.sources.select("file"), "file", "left_semi").join(self.sources.select("file", F.md5("content").alias("m")), ["file", "m"], "left_anti")
        self.unclean = changed.select("artifact").distinct()

    def coverage(self) -> tuple[int, int]:
        """(covered, stale) files: those an artifact owns, and those that one claims with another text."""
        known = self.claimed.join(self.sources.select("file"), "file", "left_semi")
        return self.owners.count(), known.join(self.owners, "file", "left_anti").count()

    def _declared(self) -> DataFrame:
        """(target_file, target_offset, target_id) of declarations that the parser and the compiler both have."""
        at = self.symbols.select(F.col("file").alias("target_file"), F.col("src.offset").alias("target_offset"), F.col("id").alias("target_id"))
        return at.groupBy("target_file", "target_offset").agg(F.min("target_id").alias("target_id"))

    def apply(self, drafts: DataFrame) -> DataFrame:
        """Drafts at a place the compiler resolved: upgraded if to the same target, turned to it if unresolved, pruned if a sibling of it.

        A wrong heuristic target is corrected. No draft is added where the parser saw none. Bases, overrides and modifiers
        that the compiler lists are certain.
        """
        drafts = self._confirmed(drafts)
        what = F.when(F.col("kind").isin("calls", "creates"), "call").when(F.col("kind") == "emits", "emit").when(F.col("kind") == "reverts", "revert").when(F.col("kind").isin("reads", "writes"), "variable")
        refs = self.used.where("target_file is not null").join(self._declared(), ["target_file", "target_offset"]).groupBy("file", "what", "offset").agg(F.min("target_id").alias("target_id"))
        keyed = drafts.withColumns({"what": what, "file": F.col("site.file"), "offset": F.col("site.offset")})
        joined = keyed.join(refs, ["file", "what", "offset"], "left")
        hit = F.col("target_id").isNotNull()
        place = Window.partitionBy("from_id", "kind", "file", "offset")
        exact = F.max((hit & (F.col("to_id") == F.col("target_id"))).cast("int")).over(place)
        rank = F.row_number().over(place.orderBy((F.col("to_id") != F.coalesce("target_id", F.lit(""))).cast("int"), "to_id"))
        kept = joined.withColumns({"_exact": exact, "_rank": rank}).where(~hit | (F.col("_rank") == 1))
        done = kept.withColumns({
            "to_id": F.when(hit, F.col("target_id")).otherwise(F.col("to_id")),
            "resolution": F.when(hit, "semantic").otherwise(F.col("resolution")),
            "reason": F.when(hit, None).otherwise(F.col("reason")),
        })
        return done.select(*drafts.columns)

    def _confirmed(self, drafts: DataFrame) -> DataFrame:
        """Drafts of relations between declarations, certain where the compiler has the same."""
        name = F.when(F.col("kind").isin("overrides", "implements"), "base").when(F.col("kind").isin("inherits", "modifiedBy"), F.col("kind"))
        ends = self.used.where("what in ('inherits', 'base', 'modifiedBy')").join(self._declared(), ["target_file", "target_offset"])
        own = self._declared().toDF("file", "offset", "from_id")
        said = ends.join(own, ["file", "offset"]).select("from_id", F.col("target_id").alias("to_id"), F.col("what").alias("_what")).distinct().withColumn("_sure", F.lit(True))
        joined = drafts.withColumn("_what", name).join(said, ["from_id", "to_id", "_what"], "left")
        sure = F.col("_sure").isNotNull()
        return joined.withColumns({"resolution": F.when(sure, "semantic").otherwise(F.col("resolution")), "reason": F.when(sure, None).otherwise(F.col("reason"))}).select(*drafts.columns)

    def annotate(self, nodes: DataFrame) -> DataFrame:
        """Nodes with selectors and, from artifacts none of whose sources has changed, slots; absence stays null."""
        at = self.symbols.select("id", "file", F.col("src.offset").alias("offset"))
        clean = self.used.join(self.unclean, "artifact", "left_anti")
        pick = lambda what: (clean if what == "slot" else self.used).where(F.col("what") == what).join(at, ["file", "offset"]).groupBy("id")
        selectors = pick("selector").agg(F.min("value").alias("_sel"))
        slots = pick("slot").agg(F.min(F.struct("value", "target_offset")).alias("_slot"))
        out = nodes.join(selectors, "id", "left").join(slots, "id", "left")
        return out.withColumns({"selector": F.coalesce("_sel", "selector"), "slot": F.coalesce("_slot.value", "slot"), "slot_offset": F.coalesce(F.col("_slot.target_offset").cast("int"), "slot_offset")}).select(*nodes.columns)


def load_overlay(spark: SparkSession, paths: list[str], sources: DataFrame, symbols: DataFrame) -> tuple[Overlay | None, list[str]]:
    """(overlay or None, warnings): artifacts that fail leave the syntactic graph as it is."""
    if not paths:
        return None, []
    try:
        texts = read_build_info(spark, paths)
        found = materialise(facts_of(texts))
        notes = [f"build-info {r['artifact']} is not used: {r['error']}" for r in unusable(texts).orderBy("artifact").toLocalIterator()]
        if found.isEmpty():
            return None, notes
        over = Overlay(found, sources, symbols)
        covered, stale = over.coverage()
        if stale:
            notes.append(f"{stale} source files have changed since they were compiled and keep their heuristic edges")
        return (over if covered else None), notes
    except Exception as e:  # noqa: BLE001
        return None, [f"compiler artifacts could not be used: {e}"]
