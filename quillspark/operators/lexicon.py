"""The lexicon: word statistics, scopes, letters and morphological groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import connected_components

ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def word_stats(words: DataFrame) -> DataFrame:
    """(word, total, old, new, books); total = old + new, as both translations count."""
    return words.groupBy("word").agg(
        F.sum("cnt").alias("total"),
        F.sum(F.when(F.col("translation") == "old", F.col("cnt")).otherwise(0)).alias("old"),
        F.sum(F.when(F.col("translation") == "new", F.col("cnt")).otherwise(0)).alias("new"),
        F.countDistinct("book_slug").alias("books"),
    )


def scopes(words: DataFrame, with_books: bool = True) -> DataFrame:
    """(scope, word, total) for the testaments, the canon and its rest, and each book.

    Words are summed by book and scope flags first, so that the fan-out to scopes
    works on few rows.
    """
    each = words.groupBy("word", "book_slug", "testament", "noncanonical").agg(F.sum("cnt").alias("cnt"))
    flags = [F.col("testament"), F.when(F.col("noncanonical"), "noncanonical").otherwise("canonical")]
    if with_books:
        flags.append(F.concat(F.lit("book:"), F.col("book_slug")))
    return each.select("word", "cnt", F.explode(F.array(*flags)).alias("scope")).groupBy("scope", "word").agg(F.sum("cnt").alias("total"))


def letters(stats: DataFrame) -> DataFrame:
    letter = F.lower(F.substring("word", 1, 1))
    order = F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), F.col("letter")), F.lit(0)), F.lit(999))
    return stats.groupBy(letter.alias("letter")).agg(F.count(F.lit(1)).alias("total_words"), F.sum("total").alias("total_occurrences")).withColumn("ord", order.cast("int"))


def frequent_words(occurrences: DataFrame, least_length: int, least_count: int) -> DataFrame:
    return occurrences.where(F.length("token") >= least_length).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def common_prefix(a: str, b: str, least: int = 0):
    upto = F.sequence(F.lit(least), F.least(F.length(a), F.length(b)))
    return F.array_max(F.filter(upto, lambda k: F.substring(F.col(a), F.lit(1), k) == F.substring(F.col(b), F.lit(1), k)))


def prefix_pairs(words: DataFrame, stem: int = 5, look_ahead: int = 49, most_apart: int = 4, least_share: float = 0.82) -> DataFrame:
    """Words with a common stem, near each other in the alphabet, that share most of their letters.

    A window numbers the words of each stem; words meet those of their own and of the
    next block of ``look_ahead`` words, so a frequent stem is no square of its words.
    """
    ranked = words.select("token", F.substring("token", 1, stem).alias("stem")).withColumn("r", F.row_number().over(Window.partitionBy("stem").orderBy("token")))
    block = F.floor((F.col("r") - 1) / look_ahead)
    x = ranked.select(F.col("token").alias("a"), "stem", F.col("r").alias("ra"), block.alias("block"))
    y = ranked.select(F.col("token").alias("b"), "stem", F.col("r").alias("rb"), F.explode(F.array(block, block - 1)).alias("block"))
    near = x.join(y, ["stem", "block"]).where((F.col("rb") - F.col("ra")).between(1, look_ahead) & (F.abs(F.length("a") - F.length("b")) <= most_apart))
    shared = near.withColumn("prefix", common_prefix("a", "b", stem).cast("bigint"))
    return shared.where(F.col("prefix") / ((F.length("a") + F.length("b")) / 2.0) >= least_share).select("a", "b", "prefix")


def prefix_groups(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(form, lemma): components of the pairs; the lemma is the shortest, then first, form."""
    named = words.select("token", F.xxhash64("token").alias("id"))
    parts = connected_components(pairs.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    grouped = named.join(parts, named["id"] == parts["node"], "left").select(F.col("token").alias("form"), F.coalesce("component", "id").alias("group"))
    lemmas = grouped.groupBy("group").agg(F.min(F.struct(F.length("form").alias("n"), F.col("form").alias("form")))["form"].alias("lemma"))
    return grouped.join(lemmas, "group").select("form", "lemma")
