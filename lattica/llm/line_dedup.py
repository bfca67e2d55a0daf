"""Line dedup by site-relative frequency.

Pages are grouped by host. For each line, the host's pages that contain it are
divided by the host's pages, and lines beyond a ratio are boilerplate of that host
and dropped from its pages. Lines meet as 128-bit hashes next to their host's, each
page counts a line once, and counts are summed before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, join_skewed, materialise, text_or_empty

RATIO = 0.1
MIN_PAGES = 3
#: A source of documents is larger and less uniform than a site: what repeats counts from this share on, and lines of more words than LONG_WORDS at any share.
DOC_RATIO, LONG_WORDS = 0.001, 50
#: Fixed patterns: what HTML hides, what ends a line, all other tags.
HIDDEN, BREAK, TAG = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", r"(?i)<(?:/?(?:p|div|h[1-6]|li|ul|ol|nav|article|section|header|footer|table|tr|title|body|head|html)|br)(?:\s[^>]*)?/?>", r"<[^>]*>"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"


def html_lines(html: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BREAK, "\n"), TAG, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def text_lines(text: Column) -> Column:
    return F.split(text, "\n")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(pages: DataFrame, host: Column, lines: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, keys): the keys of each host's lines that are on ``min_pages`` pages and more than ``ratio`` of its pages.

    Blank lines are none. Per host there are at most its mean number of lines a page
    divided by ``ratio``.
    """
    keyed = pages.select(host.alias("_host"), F.array_distinct(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), _key)).alias("_keys"))
    totals = keyed.groupBy("_host").agg(F.count("*").alias("_pages"))
    counts = keyed.select("_host", F.explode("_keys").alias("_key")).groupBy("_host", "_key").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_pages)
    often = join_checked(counts, materialise(totals), ["_host"], "inner").where(F.col("_n") > F.col("_pages") * ratio)
    return materialise(often.groupBy("_host").agg(F.collect_list("_key").alias("_drop")))


def drop_lines(pages: DataFrame, host: Column, lines: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Adds _lines and _left (arrays of lines) and _host to ``pages``. A null page has null lines."""
    drop = boilerplate(pages, host, lines, ratio, min_pages)
    joined = join_checked(pages.withColumn("_host", host).withColumn("_lines", lines), drop, ["_host"], "left")
    left = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x: ~F.array_contains("_drop", _key(x))))
    return joined.withColumn("_left", left).drop("_drop")


def dedup_pages(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text: a row per page, its lines of text without its host's boilerplate.

    Lines are what block tags separate, trimmed, without tags, scripts, styles and
    comments. A null html has no lines and an empty text; pages whose url has no host
    share the empty host. Rows that repeat a page count as pages of their own.
    """
    own = pages.select("page_id", host_of(F.col("url")).alias("h"), F.coalesce("html", F.lit("")).alias("html"))
    cut = own.select("page_id", "h", html_lines(F.col("html")).alias("l"))
    out = drop_lines(cut, F.col("h"), F.col("l"), ratio, min_pages)
    return out.select("page_id", F.col("_host").alias("host"), F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_left")).cast("long").alias("n_dropped"), F.array_join("_left", "\n").alias("text"))


def _repeated(pages: DataFrame, ratio: float, min_pages: int, small_ratio: float, long_words: int) -> DataFrame:
    """(_a, _b, _drop, _rows): the keys of the lines to drop from each text, by the text's key, and how many rows have the text.

    ``pages`` has _host, _a and _b (the key of host and text) and _lines. Equal texts
    count as one document of a line: they are for a later stage to judge.
    """
    said = F.filter("_lines", lambda x: F.trim(x) != "")
    long = lambda x: F.size(F.split(F.trim(x), r"\s+")) > long_words
    totals = materialise(pages.groupBy("_host").agg(F.count("*").alias("_pages")))
    texts = pages.groupBy("_host", "_a", "_b").agg(F.count("*").alias("_rows"), F.first(F.array_distinct(F.transform(said, lambda x: F.struct(_key(x).alias("k"), long(x).alias("long"))))).alias("_keys"))
    keyed = materialise(texts.select("_host", "_a", "_b", "_rows", F.explode("_keys").alias("_l")).select("_host", "_a", "_b", "_rows", F.col("_l.k").alias("_key"), F.col("_l.long").alias("_long")))
    counts = keyed.groupBy("_host", "_key", "_long").agg(F.count("*").alias("_n"), F.sum("_rows").alias("_in"), F.min(F.struct("_a", "_b")).alias("_keeper")).where((F.col("_in") >= min_pages) & (F.col("_n") > 1))
    share = F.col("_in") / F.col("_pages")
    often = join_checked(counts, totals, ["_host"], "inner").where(F.col("_long") | (share > min(small_ratio, ratio)))
    often = materialise(often.select("_host", "_key", F.when(share <= ratio, F.col("_keeper")).alias("_keeper")))
    found = join_checked(keyed.drop("_long"), often, ["_host", "_key"], "inner").where(F.col("_keeper").isNull() | (F.col("_keeper") != F.struct("_a", "_b")))
    return materialise(found.groupBy("_a", "_b").agg(F.collect_list("_key").alias("_drop"), F.max("_rows").alias("_rows")))


def dedup_documents(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, small_ratio: float = DOC_RATIO, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` with texts without their source's repeated lines and n_chars to match; the source stands for the host.

    Of lines in ``min_pages`` documents of a source, of two texts at least, those in more
    than ``ratio`` of its documents are boilerplate and go from all. Those in more than
    ``small_ratio``, and lines of more than ``long_words`` words at any share, go from
    all but one text (of the least hash), so that no passage is lost. No row is
    dropped, and a document that would lose all its lines stays whole. A null text
    stays null.
    """
    inside = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    host, said = F.coalesce(F.concat(F.lit("S"), at["source"]), F.lit("n")), text_or_empty(at["text"])
    pages = inside.withColumns({"_host": host, "_a": F.xxhash64(host, said), "_b": F.xxhash64(F.lit(1), host, said)})
    drop = _repeated(pages.select("_host", "_a", "_b", text_lines(said).alias("_lines")), ratio, min_pages, small_ratio, long_words)
    joined = join_skewed(pages, drop, ["_a", "_b"], "_rows", docs.count(), F.monotonically_increasing_id())
    out = joined.withColumn("_lines", text_lines(F.col(at["text"]))).withColumn("_left", F.filter("_lines", lambda x: ~F.array_contains("_drop", _key(x))))
    text = F.array_join("_left", "\n")
    changed = F.col("_drop").isNotNull() & F.exists("_left", lambda x: F.trim(x) != "") & (F.size("_left") < F.size("_lines"))
    new = {"text": F.when(changed, text).otherwise(F.col(at["text"])), "n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col(at["n_chars"])) if "n_chars" in at else None}
    return out.select(*(new.get(c, F.col(at[c])).alias(c) for c in docs.columns))
