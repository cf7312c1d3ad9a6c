"""Words by letters inside them: postings of character n-grams, the rarest of a needle first, then a look at the word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (2, 3)


def _folded(word: Column) -> Column:
    return F.lower(word)


def postings(lexicon: DataFrame) -> DataFrame:
    """Rows (gram, letter, word, total), one for each different run of two and of three letters of a word, in lower case."""
    word = _folded(F.col("word"))

    def runs(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, F.lit(n)))
        return F.when(F.length(word) >= n, every).otherwise(F.array().cast("array<string>"))

    return lexicon.select(F.explode(F.array_distinct(F.concat(*map(runs, SIZES)))).alias("gram"), F.lower(F.substring("word", 1, 1)).alias("letter"), "word", "total")


def counts(grams: DataFrame) -> DataFrame:
    """(gram, n): how long each list is."""
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def of(needle: str) -> list[str]:
    """The grams that a word with ``needle`` (in lower case) has for certain: runs of three letters, or the needle if it has two."""
    size = min(len(needle), max(SIZES))
    return sorted({needle[i : i + size] for i in range(len(needle) - size + 1)}) if size >= min(SIZES) else []


def holding(needle: str, lexicon: DataFrame, grams: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """Rows (word, total) of the words that hold ``needle`` anywhere, in any case.

    With the stored ``grams`` and their ``lengths`` only the shortest list is read; a needle of
    fewer than two letters, or a lexicon without lists, is a look at all words.
    """
    needle = needle.lower()
    asked = of(needle)
    found = F.contains(_folded(F.col("word")), F.lit(needle))
    if grams is None or lengths is None or not asked:
        return lexicon.select("word", "total").where(found)
    n = {r.gram: r.n for r in lengths.where(F.col("gram").isin(asked)).collect()}
    rarest = min(asked, key=lambda g: (n.get(g, 0), g))
    return grams.where(F.col("gram") == rarest).where(found).select("word", "total")


def holding_each(needles: tuple[str, ...], lexicon: DataFrame) -> DataFrame:
    """Rows (needle, word, total) of ``holding`` for each needle, by one look at all words."""
    held = F.filter(F.array(*map(F.lit, needles)), lambda n: F.contains(_folded(F.col("word")), F.lower(n)))
    return lexicon.select(F.explode(held).alias("needle"), "word", "total")
