"""Topics over verse ranges and cross-references between verses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import written


def top_topics(refs: DataFrame, n: int) -> DataFrame:
    """(book, topic_slug, n, r): each book's topics with the most references."""
    counts = refs.groupBy("book", "topic_slug").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("book").orderBy(F.desc("n"), "topic_slug")
    return counts.withColumn("r", F.row_number().over(w).cast("bigint")).where(F.col("r") <= n)


def lift(baskets: DataFrame, word: DataFrame, least: int = 2, limit: int = 20, common_above: float = 0.3) -> DataFrame:
    """Topics that a word's verses hold more often than chance would have it.

    ``baskets``: distinct (verse, topic); ``word``: the word's distinct verses.
    Sorted by the rounded lift, as ties are to be broken by count.
    """
    n = baskets.agg(F.countDistinct("verse").alias("n"))
    w = word.join(baskets.select("verse").distinct(), "verse", "left_semi").agg(F.count(F.lit(1)).alias("w"))
    totals = baskets.groupBy("topic").agg(F.count(F.lit(1)).alias("t"))
    hits = baskets.join(word, "verse", "left_semi").groupBy("topic").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least)
    expected = F.col("w") * F.col("t") / F.col("n").cast("double")
    scored = hits.join(totals, "topic").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(w))
    ratio = F.when(expected > 0, F.round(F.col("c") / expected, 2)).otherwise(0.0)
    share = F.col("w") / F.col("n").cast("double")
    return scored.select("topic", "c", "t", ratio.alias("lift"), F.round(share, 6).alias("coverage"), (share > common_above).alias("common")).orderBy(F.desc("lift"), F.desc("c"), "topic").limit(limit)


def clip(refs: DataFrame, tops: DataFrame) -> DataFrame:
    """References cut to the last verse of their chapter (``top``); those that begin behind it go."""
    return refs.join(tops, ["book", "chapter"]).where("vs <= top").withColumn("ve", F.least("ve", "top")).drop("top").select(*refs.columns)


#: Hebrew psalm numbers to Greek ones, as (first, last, chapter shift, verse shift).
PSALM_SHIFTS = ((1, 9, 0, 0), (10, 10, -1, 21), (11, 113, -1, 0), (114, 114, -1, 0), (115, 115, -2, 8), (117, 146, -1, 0), (148, 150, 0, 0))
#: Psalms that the Greek numbering splits, as (chapter, last verse of the first part, chapter of the first part).
PSALM_SPLITS = ((116, 9, 114), (147, 11, 146))


#: The Hebrew chapter of Malachi that the Greek numbering adds to another, and by how many verses.
MALACHI = (4, 3, 18)
#: The chapter and verse of Nehemiah from which on the Greek numbering is ahead, and by how many verses.
NEHEMIAH = (4, 18, 15)


def _piece(chapter: Column | int, vs: Column, ve: Column) -> Column:
    return F.struct((chapter if isinstance(chapter, Column) else F.lit(chapter)).cast("int").alias("chapter"), vs.cast("int").alias("vs"), ve.cast("int").alias("ve"))


def _psalms(c: Column, vs: Column, ve: Column) -> Column:
    pieces = F.when(F.lit(False), F.array(_piece(c, vs, ve)))
    for first, last, dc, dv in PSALM_SHIFTS:
        pieces = pieces.when(c.between(first, last), F.array(_piece(c + dc, vs + dv, ve + dv)))
    for chapter, last, first in PSALM_SPLITS:
        low, high = _piece(first, vs, F.least(ve, F.lit(last))), _piece(first + 1, F.greatest(vs - last, F.lit(1)), ve - last)
        here = c == chapter
        pieces = pieces.when(here & (vs <= last) & (ve > last), F.array(low, high)).when(here & (vs <= last), F.array(low)).when(here, F.array(high))
    return pieces.otherwise(F.array(_piece(c, vs, ve)))


def renumber(refs: DataFrame, book: Column | None = None) -> DataFrame:
    """Ranges (chapter, vs, ve) in the other numbering; a range over a split becomes two.

    ``book`` says whether a row is of the ``psalms`` (as all are without it), of ``malachi`` or ``nehemiah``;
    other books, and chapters without a number of their own, stay as they are.
    Adds (from_chapter, from_vs, from_ve) and keeps other columns.
    """
    book = F.lit("psalms") if book is None else book
    c, vs, ve = F.col("chapter"), F.col("vs"), F.col("ve")
    chapter, into, on = MALACHI
    malachi = (book == "malachi") & (c == chapter)
    chapter, first, ahead = NEHEMIAH
    nehemiah = (book == "nehemiah") & (c == chapter) & (ve >= first)
    below, above = _piece(c, vs, F.lit(first - 1)), _piece(c, F.greatest(vs, F.lit(first)) + ahead, ve + ahead)
    pieces = F.when(book == "psalms", _psalms(c, vs, ve)).when(malachi, F.array(_piece(into, vs + on, ve + on)))
    pieces = pieces.when(nehemiah & (vs < first), F.array(below, above)).when(nehemiah, F.array(above)).otherwise(F.array(_piece(c, vs, ve)))
    others = [x for x in refs.columns if x not in ("chapter", "vs", "ve")]
    return refs.select(*others, c.alias("from_chapter"), vs.alias("from_vs"), ve.alias("from_ve"), F.inline(pieces))


def confident(edges: DataFrame, least_confidence: int = 50, least_votes: int = 0) -> DataFrame:
    return edges.where((F.coalesce("confidence", F.lit(0)) >= least_confidence) & (F.coalesce("votes", F.lit(0)) >= least_votes))


def summary(rows: DataFrame, column: str) -> DataFrame:
    """(least, most, mean, upper_median); the median from running counts of the distinct values.

    The values are cut by range; only one number for each range meets the others in one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    cut = written(counts.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id()))
    sums = cut.groupBy("part").agg(F.sum("n").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"), F.sum("rows").over(Window.partitionBy(F.lit(1))).alias("all"))
    running = cut.withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy("value"))).join(bases, "part")
    median = F.min(F.when(F.col("base") + F.col("upto") > F.floor(F.col("all") / 2), F.col("value")))
    return running.agg(F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 6).alias("mean"), median.alias("upper_median"))


def parse_osis(refs: DataFrame, column: str) -> DataFrame:
    """(ref, book, chapter, vs, ve); a range over chapters shrinks to its start."""
    start, stop = r"^([A-Z][a-z]+)\.(\d+)\.(\d+)", r"-([A-Z][a-z]+)\.(\d+)\.(\d+)$"
    part = lambda p, i: F.regexp_extract(column, p, i)
    number = lambda p, i: F.expr(f"try_cast(regexp_extract({column}, r'{p}', {i}) as int)")
    same = (part(stop, 1) == part(start, 1)) & (number(stop, 2) == number(start, 2))
    return refs.select(F.col(column).alias("ref"), F.nullif(part(start, 1), F.lit("")).alias("book"), number(start, 2).alias("chapter"), number(start, 3).alias("vs"), F.when(same, number(stop, 3)).otherwise(number(start, 3)).alias("ve"))


def parse_refs(rows: DataFrame, column: str) -> DataFrame:
    """(ref, prefix, abbr, chapter, verse, verse_end) of the first reference in a label."""
    pattern = r"([IVX]+\s+)?([a-z]+)\s+(\d+):(\d+)(?:[-,](\d+))?"
    part = lambda i: F.regexp_extract(column, pattern, i)
    number = lambda i: F.expr(f"try_cast(nullif(regexp_extract({column}, r'{pattern}', {i}), '') as int)")
    return rows.select(F.col(column).alias("ref"), F.trim(part(1)).alias("prefix"), part(2).alias("abbr"), number(3).alias("chapter"), number(4).alias("verse"), number(5).alias("verse_end"))
