"""Spelling variants grouped by anagram hashing.

A word's key is the sum of a power of each of its letters, so anagrams share a key and
one letter more, less or other changes it by that letter's value. Words one letter
apart are joined on keys less one letter's value: an exchange leaves both with the same
rest, an addition leaves the longer word with the shorter one's whole key. What meets is
then verified letter by letter, in order.

So that no key gathers many words, a word is cut into windows of WINDOW letters, and
what it joins on also holds what stands outside the window that the letter is taken
from: letters on either side of a difference are the same in both words. Words that
then meet differ within one window by the order of its letters and one of them, so a
group has a constant number of words at most, whatever the corpus holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, materialise, text_or_empty

LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
#: Of so many occurrences about one loses a letter.
DROPS = 199
#: The power of a letter's code point, as high as sums of many letters allow in 64 bits.
POWER, WINDOW = 5, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, drops: int = DROPS) -> DataFrame:
    """(word, n): letters in a row, A-Z lower-cased, some of which lost a letter; counted in each task before they are shuffled."""
    run = F.explode(F.regexp_extract_all(text_or_empty(), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_letters},}}"), F.lit(0))).alias("run")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), run).select("doc", F.translate("run", _UPPER, _LOWER).alias("run"))
    hashed = runs.select("run", F.crc32(F.encode(F.concat_ws(":", "doc", "run"), "UTF-8")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % drops == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _value(letter: Column) -> Column:
    point = F.ascii(letter).cast("long")
    return point * point * point * point * point


def key_of(word: Column) -> Column:
    """The sum of the letters' values; very long words wrap around, alike in all that are to meet."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda total, letter: total + _value(letter))


def _windows(length: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((length - 1) / WINDOW).cast("int"))


def near_keys(words: DataFrame) -> DataFrame:
    """(length, outside, key, less, word, n): what words meet on.

    ``less`` rows have a letter of a window taken off the key; the others are the whole
    key, beside words that are one letter longer. ``length`` is the longer word's.
    """
    size, word = F.length("word"), F.col("word")
    keyed = words.select("word", "n", size.alias("size"), key_of(word).alias("whole"))
    outside = lambda w, width: F.xxhash64(F.substring(word, F.lit(1), w * WINDOW), F.substring(word, w * WINDOW + width + 1, F.col("size")))
    width = lambda w, length: F.least(F.lit(WINDOW), length - w * WINDOW)
    per = keyed.select("word", "n", "size", "whole", F.explode(_windows(F.col("size"))).alias("w"))
    letters = F.array_distinct(F.split(F.substring(word, F.col("w") * WINDOW + 1, F.lit(WINDOW)), ""))
    less = per.select(F.col("size").alias("length"), outside(F.col("w"), F.lit(WINDOW)).alias("outside"), "whole", "word", "n", F.explode(letters).alias("letter"))
    less = less.select("length", "outside", (F.col("whole") - _value(F.col("letter"))).alias("key"), F.lit(True).alias("less"), "word", "n")
    longer = F.col("size") + 1
    beside = keyed.select("word", "n", "size", "whole", F.explode(_windows(longer)).alias("w"))
    beside = beside.select(longer.alias("length"), outside(F.col("w"), width(F.col("w"), longer) - 1).alias("outside"), F.col("whole").alias("key"), F.lit(False).alias("less"), "word", "n")
    return less.unionByName(beside)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each pair of words one letter apart, both ways round, once."""
    keys = materialise(near_keys(words))
    on = ["length", "outside", "key"]
    other = keys.select(*on, F.col("less").alias("less2"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    meet = keys.where("less").join(other, on).where("not less2 or word < near")
    pairs = meet.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n").dropDuplicates(["word", "near"])
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of the forms that follow one another, by pointer doubling.

    A form is many times as frequent as its word, so there are no circles and few steps.
    """
    now = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        total = now.count()
        followed = now.groupBy(F.col("root").alias("word")).agg(F.count("*").alias("c"))
        step = materialise(now.join(followed, "word").select(F.col("word").alias("root"), F.col("root").alias("next"), "c"))
        if step.isEmpty():
            return now
        now = materialise(join_skewed(now, step, ["root"], "c", total, F.col("word")).select("word", F.coalesce("next", "root").alias("root")))


def spelling_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES, drops: int = DROPS) -> DataFrame:
    """word, n, n_near, form, form_n, root: a row per word.

    Null and empty texts have no words; long texts are read whole, and a long run of
    letters is one word. A null doc_id counts as an empty one. Repeated rows count as
    often as they stand there. Of near words that are equally frequent the smallest in
    code-point order is the form. Further columns are ignored; no rows give no rows.
    """
    words = materialise(word_counts(docs, least_letters, least_count, drops))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    held = F.col("n_near").isNotNull() & (-F.col("best.less") >= F.col("n") * times)
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(held, F.col("best.near")).alias("form"), F.when(held, -F.col("best.less")).alias("form_n"))
    out = materialise(out)
    last = roots(out.where("form is not null"))
    return out.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
