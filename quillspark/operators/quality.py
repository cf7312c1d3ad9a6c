"""Data quality: triage, audits, typos, rewriting, differences and merges.

Regular expressions and rule lists are arguments; the constants below are the
sets the text corpus is judged by.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the names of agents that count as crawlers.
CRAWLERS = (
    "googlebot", "bingbot", "duckduckbot", "yandexbot", "baiduspider", "applebot", "slurp", "facebookexternalhit", "twitterbot",
    "linkedinbot", "whatsapp", "telegrambot", "discordbot", "slackbot", "embedly", "pinterest", "vkshare", "w3c_validator",
)


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return F.lower(text).rlike("|".join(p.replace(".", r"\.") for p in parts))


def first_reason(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The reason of the first pattern that matches, else null."""
    return reduce(lambda out, r: out.when(text.rlike(r[0]), r[1]), rules[1:], F.when(text.rlike(rules[0][0]), rules[0][1]))


def latin_share(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / F.length(text)).otherwise(0.0)


def mixed_class(text: Column) -> Column:
    share = latin_share(text)
    return F.when(share > 0.8, "full").when(share > 0.3, "heavy").when(share > 0.05, "light").otherwise("none")


def deletions(word: Column) -> Column:
    """The word itself and the word without each of its letters."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))


def typo_suspects(counts: DataFrame, rare: int, frequent: int, least_length: int) -> DataFrame:
    """Rare words (word, n) at edit distance 1 from frequent ones; the most frequent candidate wins.

    Two words at distance 1 share a word of their deletion neighbourhoods, so the
    candidates come from an equi-join.
    """
    long = counts.where(F.length("word") >= least_length)
    a = long.where(F.col("n") <= rare).select("word", F.col("n").alias("count"), F.explode(deletions(F.col("word"))).alias("key"))
    b = long.where(F.col("n") >= frequent).select(F.col("word").alias("fix"), F.col("n").alias("fix_count"), F.explode(deletions(F.col("word"))).alias("key"))
    pairs = a.join(b, "key").where(F.levenshtein("word", "fix") == 1)
    best = pairs.groupBy("word", "count").agg(F.min(F.struct((-F.col("fix_count")).alias("m"), F.col("fix").alias("fix"))).alias("best"))
    return best.select("word", "count", "best.fix", (-F.col("best.m")).alias("fix_count"))


def replace_all(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Plain replacements, one after the other."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), rules, text)


def rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular-expression replacements, one after the other."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def drop_adjacent_repeats(text: Column, least: int = 4) -> Column:
    """Words equal to the last kept word go, marks at their ends aside, if they have ``least`` letters."""
    bare = lambda w: F.rtrim(w, F.lit(",.;:"))

    def kept(before: Column, word: Column) -> Column:
        # What was dropped before equals the last kept word, marks aside: the word before decides.
        return F.when((bare(before) != bare(word)) | (F.length(bare(word)) < least), word)

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    marked = F.zip_with(F.concat(F.array(F.lit("")), words), words, kept)
    return F.array_join(F.filter(marked, lambda w: w.isNotNull()), " ")


def table_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, kind, changed): rows that were added, removed or changed, with the columns that differ."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    differs = F.array_compact(F.array(*(F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), c) for c in columns)))
    kind = F.when(F.col(f"o.{key}").isNull(), "added").when(F.col(f"n.{key}").isNull(), "removed").when(F.size(differs) > 0, "changed")
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), kind.alias("kind"), F.when(kind == "changed", differs).otherwise(F.array().cast("array<string>")).alias("changed")).where("kind is not null")


def upsert(base: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column, action): updates win; ``action`` is kept, same, updated or added."""
    b, u = base.select(key, F.col(column).alias("old")), updates.select(F.col(key).alias("_key"), F.col(column).alias("new"))
    joined = b.join(u, F.col(key) == F.col("_key"), "full")
    action = F.when(F.col("_key").isNull(), "kept").when(F.col(key).isNull(), "added").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("updated")
    return joined.select(F.coalesce(key, "_key").alias(key), F.when(F.col("_key").isNull(), F.col("old")).otherwise(F.col("new")).alias(column), action.alias("action"))


def first_source(*sources: DataFrame, key: str) -> DataFrame:
    """For each key the row of the first source that has it."""
    ranked = reduce(DataFrame.unionByName, (s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)))
    w = Window.partitionBy(key).orderBy("_source")
    return ranked.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_source")


def genitive(word: Column, vowel: str = "i", ending: str = "s", soft: str = "aeiy", hard: str = "ou", plural: str = "") -> Column:
    """Words that have the ending keep it; a soft last vowel gives way, a hard one stays, others take a vowel first."""
    last, whole = F.right(word, F.lit(1)), vowel + ending
    swapped = F.concat(F.substring(word, F.lit(1), F.length(word) - 1), F.lit(whole))
    kept = F.when((word == "") | F.endswith(word, F.lit(whole)) | (F.lit(bool(plural)) & F.endswith(word, F.lit(plural))), word)
    return kept.when(last.isin(*soft), swapped).when(last.isin(*hard), F.concat(word, F.lit(ending))).otherwise(F.concat(word, F.lit(whole)))


#: The Georgian genitive, and postpositions before which a nominative loses its vowel.
GEORGIAN = {"vowel": "ი", "ending": "ს", "soft": "იეა", "hard": "ოუ", "plural": "თა"}
POSTPOSITIONS = ("ში", "თან", "ზე", "დან", "კენ", "მდე", "გარეშე", "ვით")


def with_suffix(word: Column, suffix: Column) -> Column:
    """A Georgian word with a suffix: its last vowel falls before postpositions and the dative, and the genitive follows its own rule."""
    bare = F.when(F.endswith(word, F.lit("ი")), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)
    out = F.when((word == "") | (suffix == ""), word).when(suffix.isin(*POSTPOSITIONS) | (suffix == "ს"), F.concat(bare, suffix))
    return out.when(suffix == "ის", genitive(word, **GEORGIAN)).otherwise(F.concat(word, suffix))


# -- dictionaries over the words of a text: runs of letters and what lies between them, looked up one by one


def _lookup(dictionary: dict[str, str], word: Column) -> Column:
    """What a lower-case word stands for, else null; a map by first letter, as maps are searched from their start."""
    by_letter: dict[str, dict[str, str]] = {}
    for k, v in dictionary.items():
        by_letter.setdefault(k[:1], {})[k] = v
    entries = [x for letter, words in by_letter.items() for x in (F.lit(letter), F.create_map(*(F.lit(y) for kv in words.items() for y in kv)))]
    return F.create_map(*entries)[F.substring(word, 1, 1)][word] if entries else F.lit(None).cast("string")


def _pieces(text: Column, pattern: str, fix: Callable[[Column], Column]) -> Column:
    """``text`` with ``fix`` applied to each match of ``pattern``, whose alternatives cover every character."""
    return F.when(text.isNotNull(), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), fix), ""))


def replace_roots(text: Column, dictionary: dict[str, str]) -> Column:
    """Latin runs of three letters and more that the dictionary knows, in any case, with the Georgian suffix glued to them."""

    def fix(piece: Column) -> Column:
        root, suffix = F.regexp_extract(piece, "^[A-Za-z]{3,}", 0), F.regexp_extract(piece, "[ა-ჰ]*$", 0)
        return F.coalesce(F.when(root != "", with_suffix(_lookup(dictionary, F.lower(root)), suffix)), piece)

    return _pieces(text, "[A-Za-z]+[ა-ჰ]*|[^A-Za-z]+", fix)


def replace_words(text: Column, dictionary: dict[str, str]) -> Column:
    """Whole Latin words of three letters and more, looked up in lower case."""
    return _pieces(text, "[A-Za-z]+|[^A-Za-z]+", lambda piece: F.coalesce(F.when(F.length(piece) >= 3, _lookup(dictionary, F.lower(piece))), piece))


def apostrophe_rules(no_ending: tuple[str, ...] = ("in", "on", "at")) -> list[tuple[str, str]]:
    """(pattern of a word's end before the apostrophe, what stands for it), the first that fits; ``$1`` is what the pattern groups."""
    kept = "|".join(("is", "ის", *no_ending))
    return [(f"({kept})", "$1"), ("[იეა]", "ის"), ("([ოუ])", "$1ს"), ("([ა-ჰ])", "$1ის"), ("[aeiy]", "is"), ("([ou])", "$1s"), ("([a-z])", "$1is")]


def fix_apostrophes(text: Column, no_ending: tuple[str, ...] = ("in", "on", "at")) -> Column:
    """A word with an apostrophe at its end takes the genitive, unless it ends like a preposition."""
    return rewrite(text, [(rf"{end}'(?=\s|$|[,.;:\-—()])", put) for end, put in apostrophe_rules(no_ending)])
