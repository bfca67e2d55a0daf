"""Byte offsets in texts as UTF-16 indexes, lines and columns, by an as-of join.

A text is cut into pieces of a line, PIECE characters at most, each with what stands
before it: bytes, UTF-16 units, lines, and the unit its line starts at. An offset
belongs to the last piece that does not start after it, and only the rest of that piece
is measured; where all characters of a piece are a byte and a unit each, its text stays
behind and the rest is a difference. Offsets are of bytes, lines count from 1 and columns, in UTF-16 units, from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 256


def units(text: Column) -> Column:
    """UTF-16 units of a text: characters beyond the basic plane are two."""
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def pieces(texts: DataFrame, piece: int = PIECE) -> DataFrame:
    """(file, text, byte, unit, line, line_unit) of (file, content): where each piece starts, and the unit its line does."""
    cut = F.regexp_extract_all("content", F.lit(f"[^\\n]{{0,{piece - 1}}}\\n|[^\\n]{{1,{piece}}}"), F.lit(0))
    each = texts.select("file", F.posexplode(cut).alias("i", "text"))
    each = each.withColumns({"bytes": F.octet_length("text"), "units": units(F.col("text")).cast("long"), "ends": F.col("text").endswith("\n")})
    before = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    placed = each.withColumns({"byte": total(F.col("bytes")), "unit": total(F.col("units")), "line": total(F.col("ends").cast("long")) + 1})
    line_unit = F.coalesce(F.max(F.when(F.col("ends"), F.col("unit") + F.col("units"))).over(before), F.lit(0))
    return placed.select("file", "text", "byte", "unit", "line", line_unit.alias("line_unit"))


def _starts(texts: DataFrame, piece: int) -> DataFrame:
    """(file, at, kind, piece): pieces where they start, with their text where it is needed, and one for each text's start."""
    cut = pieces(texts, piece)
    size = F.octet_length("text")
    start = F.struct(F.when(size != F.length("text"), F.col("text")).alias("text"), "byte", "unit", "line", "line_unit", size.cast("long").alias("size"), F.col("text").endswith("\n").alias("ends"))
    none = texts.select("file", F.struct(F.lit(None).cast("string").alias("text"), *(F.lit(v).cast("long").alias(c) for c, v in (("byte", 0), ("unit", 0), ("line", 1), ("line_unit", 0), ("size", 0))), F.lit(False).alias("ends")).alias("piece"))
    return none.select("file", F.lit(0).cast("long").alias("at"), F.lit(0).alias("kind"), "piece").unionByName(cut.select("file", F.col("byte").alias("at"), F.lit(1).alias("kind"), start.alias("piece")))


def locate(texts: DataFrame, offsets: DataFrame, piece: int = PIECE) -> DataFrame:
    """(file, offset, utf16, line, column) of offsets (file, offset) in texts (file, content), a row for each.

    An offset within a character is that of the character; one beyond the end, or in an
    empty text, is at the end. Offsets of files that are not there are left out.
    """
    starts = _starts(texts, piece)
    asked = offsets.select("file", F.col("offset").cast("long").alias("at"), F.lit(2).alias("kind"), F.lit(None).cast(starts.schema["piece"].dataType).alias("piece"))
    upto = Window.partitionBy("file").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = starts.unionByName(asked).withColumn("piece", F.last("piece", ignorenulls=True).over(upto)).where("kind = 2 and piece is not null")
    p = F.col("piece")
    ahead = F.substring(F.encode(p["text"], "UTF-8"), F.lit(1), (F.col("at") - p["byte"]).cast("int"))
    whole = F.expr("regexp_replace(hex(_ahead), '(?:(?:C[0-9A-F]|D[0-9A-F])|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-7](?:[89AB][0-9A-F]){0,2})$', '')")  # without a character cut short
    text = F.decode(F.unhex(whole), "UTF-8")
    plain = F.least(F.greatest(F.col("at") - p["byte"], F.lit(0)), p["size"])
    out = found.withColumn("_ahead", ahead).withColumn("_n", F.when(p["text"].isNull(), plain).otherwise(units(text)).cast("long"))
    ends = p["ends"] & (F.col("at") - p["byte"] >= p["size"])  # beyond a last line break
    index = p["unit"] + F.col("_n")
    return out.select("file", F.col("at").alias("offset"), index.alias("utf16"), (p["line"] + ends.cast("long")).alias("line"), F.when(ends, 0).otherwise(index - p["line_unit"]).cast("long").alias("column"))
