"""Keyword, ranked and hybrid retrieval over postings, token counts and vectors.

Query arguments are bound on the driver; what a query brings along (its words, their
forms) is tiny or is left to the planner's size checks.  Top-k is always
``orderBy().limit()`` with a total order, never a window over the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx

RRF_K = 60
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25


def query_words(spark: SparkSession, words: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, w) for i, w in enumerate(words)], "pos int, word string")


def expand_forms(spark: SparkSession, words: list[str], word_forms: DataFrame) -> DataFrame:
    """Rows (pos, word, form): every form of each word's lemma, and the word itself."""
    typed = query_words(spark, words)
    lemmas = typed.join(word_forms, F.col("word") == F.col("form"), "left").select("pos", "word", "lemma")
    others = lemmas.join(word_forms, "lemma").select("pos", "word", "form")
    return others.unionByName(typed.select("pos", "word", F.col("word").alias("form"))).distinct()


def keyword_matches(postings: DataFrame, verses: DataFrame, forms: DataFrame, testament: str = "", book_slug: str = "", translation: str = "both") -> DataFrame:
    """Verses that hold a form of every word: (idx, book_slug, chapter, verse, exact_count, total_count).

    One shuffle on idx serves any number of words.  ``total_count`` adds up all
    forms of all words (a word typed twice counts twice), ``exact_count`` the typed
    words only.
    """
    n_words = forms.agg(F.countDistinct("pos").alias("n_words"))
    used = postings if translation == "both" else postings.where(F.col("translation") == translation)
    hits = used.join(forms, F.col("token") == F.col("form"))
    per_verse = hits.groupBy("idx").agg(
        F.countDistinct("pos").alias("found"), F.sum(F.when(F.col("token") == F.col("word"), F.col("cnt")).otherwise(0)).alias("exact_count"), F.sum("cnt").alias("total_count")
    )
    whole = per_verse.join(F.broadcast(n_words), F.col("found") == F.col("n_words")).select("idx", "exact_count", "total_count")
    kept = verses
    if testament:
        kept = kept.where(F.col("testament") == testament)
    if book_slug:
        kept = kept.where(F.col("book_slug") == book_slug)
    return whole.join(kept, "idx").select("idx", "book_slug", "chapter", "verse", "exact_count", "total_count")


def phrase_matches(verses: DataFrame, phrase: str, translation: str = "both") -> DataFrame:
    """Full scan, as suffixes of the last word count too."""
    new = F.coalesce(tx.count_phrase(F.col("new"), phrase), F.lit(0)) if translation in ("both", "new") else F.lit(0)
    old = F.coalesce(tx.count_phrase(F.col("old"), phrase), F.lit(0)) if translation in ("both", "old") else F.lit(0)
    counted = verses.withColumn("total_count", (new + old).cast("bigint")).where("total_count > 0")
    return counted.select("idx", "book_slug", "chapter", "verse", F.col("total_count").alias("exact_count"), "total_count")


def phrases_found(verses: DataFrame, phrases: list[str]) -> DataFrame:
    """Rows (phrase, idx, book_slug, chapter, verse, total_count) of all verses with each phrase, from one scan.

    A verse is looked through for those phrases only whose letters it has.  The letter before a phrase is part of a hit,
    so of two phrases without anything between them the second one is none.
    """

    def hits(side: str, phrase: str) -> Column:
        pattern = rf"(?iu)(?:^|[^\p{{L}}\p{{N}}_]){tx.literal_pattern(phrase)}"
        return F.when(F.contains(f"low_{side}", F.lit(phrase.lower())), F.regexp_count(side, F.lit(pattern))).otherwise(0)

    low = {f"low_{side}": F.translate(F.lower(side), "ſ", "s") for side in ("new", "old")}  # the other letter that folds to an s
    found = F.array(*(F.struct(F.lit(p).alias("phrase"), (hits("new", p) + hits("old", p)).cast("bigint").alias("n")) for p in phrases))
    each = verses.withColumns(low).select("idx", "book_slug", "chapter", "verse", F.inline(F.filter(found, lambda x: x["n"] > 0)))
    return each.groupBy("phrase", "idx", "book_slug", "chapter", "verse").agg(F.sum("n").alias("total_count"))


def ranked(matches: DataFrame, limit: int = 200) -> DataFrame:
    return matches.orderBy(F.desc("exact_count"), F.desc("total_count"), "idx").limit(tx.clamp_limit(limit, "keywords"))


def facets(matches: DataFrame) -> DataFrame:
    return matches.groupBy("book_slug", "chapter").agg(F.count(F.lit(1)).alias("verse_count"), F.sum("total_count").alias("occurrences"))


def totals(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count(F.lit(1)).alias("matches"), F.coalesce(F.sum("total_count"), F.lit(0)).alias("occurrences"), F.countDistinct("book_slug", "chapter").alias("chapters"))


def mark_forms(text: Column, pattern: Column) -> Column:
    """Escape HTML, then mark what matches; ``pattern`` lists longer forms first."""
    return F.regexp_replace(tx.escape_html(text), pattern, F.lit("<mark>$1</mark>"))


def forms_pattern(forms: DataFrame) -> DataFrame:
    """One row (pattern) with all forms, longest first."""
    sized = F.sort_array(F.collect_set(F.struct((-F.length("form")).alias("n"), F.col("form").alias("form"))))
    return forms.agg(F.concat(F.lit("(?i)("), F.array_join(F.transform(sized, lambda x: x["form"]), "|"), F.lit(")")).alias("pattern"))


# -- ranked retrieval -------------------------------------------------------------------


def bm25(token_counts: DataFrame, verses: DataFrame, words: DataFrame) -> DataFrame:
    """Rows (idx, score) of verses with any of the words (column ``form``, distinct).

    ``token_counts``: (token, idx, tf).  N and the mean length count verses without
    tokens too.  Words in more than half of the verses get ``BM25_EPSILON`` times the
    mean idf instead of a negative one.
    """
    return bm25_scores(token_counts, *bm25_statistics(token_counts, verses), words)


def bm25_statistics(token_counts: DataFrame, verses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lengths (idx, dl), tokens (token, raw idf) and one row (n, avgdl, mean_idf)."""
    lengths = token_counts.groupBy("idx").agg(F.sum("tf").alias("dl"))
    df = token_counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    corpus = verses.select("idx").join(lengths, "idx", "left").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("dl", F.lit(0))).alias("avgdl"))
    return lengths, *_weighed(df, corpus)


def bm25_sums(token_sums: DataFrame, verses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last two of ``bm25_statistics`` from rows (token, df, dl) whose dl add up to the lengths of all verses."""
    n = verses.agg(F.count(F.lit(1)).alias("n"))
    length = token_sums.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("length"))
    return _weighed(token_sums.select("token", "df"), n.crossJoin(F.broadcast(length)).select("n", (F.col("length") / F.col("n")).alias("avgdl")))


def _weighed(df: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    raw = df.crossJoin(F.broadcast(corpus)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.select("token", "raw"), corpus.crossJoin(F.broadcast(mean))


def bm25_terms(tokens: DataFrame, corpus: DataFrame, words: DataFrame) -> DataFrame:
    """Rows (token, idf, avgdl) of the words that there are."""
    terms = tokens.join(words.select("form").distinct(), F.col("token") == F.col("form"), "left_semi").crossJoin(F.broadcast(corpus))
    return terms.withColumn("idf", F.when(F.col("raw") < 0, BM25_EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))).select("token", "idf", "avgdl")


def bm25_scores(token_counts: DataFrame, lengths: DataFrame | None, tokens: DataFrame, corpus: DataFrame, words: DataFrame) -> DataFrame:
    """``bm25`` from lengths (idx, dl; none: ``token_counts`` has dl), tokens (token, raw idf) and one row (avgdl, mean_idf)."""
    terms = bm25_terms(tokens, corpus, words)
    hits = token_counts.join(terms, "token")
    hits = hits if lengths is None else hits.join(lengths, "idx")
    weight = F.col("idf") * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("idx").agg(F.sum(weight).alias("score"))


def dense_scores(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """Rows (idx, score): dot product with the one row (query) in double precision."""
    dot = F.aggregate(F.zip_with("vec", "query", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return vectors.crossJoin(F.broadcast(query.limit(1))).select("idx", dot.alias("score"))


def cosine_scores(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """Rows (idx, score): cosine with the one row (query), scaled after the sums: those of whole numbers are exact, and so is a score on a threshold."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    lengths = F.greatest(F.sqrt(dot("vec", "vec")), F.lit(1e-12)) * F.sqrt(dot("query", "query"))
    return vectors.crossJoin(F.broadcast(query.limit(1))).select("idx", (dot("vec", "query") / lengths).alias("score"))


def top_k(scored: DataFrame, k: int = 100) -> DataFrame:
    return scored.orderBy(F.desc(F.round("score", 9)), "idx").limit(k)


def ranks(top: DataFrame) -> DataFrame:
    """Rank from 0; ``top`` holds a limited number of rows."""
    return top.select("idx", (F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "idx")) - 1).alias("rank"))


def reciprocal_rank_fusion(*tops: DataFrame) -> DataFrame:
    every = reduce(DataFrame.unionByName, (ranks(t) for t in tops))
    return every.groupBy("idx").agg(F.sum(1.0 / (RRF_K + F.col("rank") + 1)).alias("rrf"))


def exact_tier(postings: DataFrame, verses: DataFrame, forms: DataFrame, testament: str = "") -> DataFrame:
    """(idx, occ): hits of any form, filtered before they are counted."""
    kept = verses.where(F.col("testament") == testament) if testament else verses
    hits = postings.join(forms.select("form").distinct(), F.col("token") == F.col("form"), "left_semi")
    return hits.join(kept.select("idx"), "idx", "left_semi").groupBy("idx").agg(F.sum("cnt").alias("occ"))


def word_overlap(words: list[str], text: Column) -> Column:
    """Stand-in for a cross-encoder: Jaccard similarity of the word sets, on a scale from -1 to 1."""
    mine = F.array(*(F.lit(w) for w in sorted(set(words))))
    theirs = F.array_distinct(tx.tokens(text))
    return 2.0 * F.size(F.array_intersect(mine, theirs)) / F.size(F.array_union(mine, theirs)) - 1.0
