"""Per-user state from an event log: histories, dashboards, bookmark lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 5
COLOURS = ("yellow", "green", "blue", "pink")
#: Longest comment and tag that are kept.
COMMENT_CHARS, TAG_CHARS = 99, 30


def reading_history(events: DataFrame, keep: int = HISTORY) -> DataFrame:
    """(user_id, book, chapter, ts, r): the latest distinct chapters of each user.

    One aggregate leaves a row per user and chapter, so the window sees no repeats.
    """
    last = events.groupBy("user_id", "book", "chapter").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    w = Window.partitionBy("user_id").orderBy(F.desc("last.ts"), F.desc("last.event_id"))
    return last.withColumn("r", F.row_number().over(w).cast("bigint")).where(F.col("r") <= keep).select("user_id", "book", "chapter", F.col("last.ts").alias("ts"), "r")


def dashboard(marks: DataFrame) -> DataFrame:
    """Counts per user; unknown colours are ignored."""
    colours = [F.count_if(F.col("colour") == c).alias(c) for c in COLOURS]
    return marks.groupBy("user_id").agg(*colours, F.count_if(F.col("comment") != "").alias("comments"), F.count_if("pinned").alias("pinned"))


def age_label(seconds: Column) -> Column:
    minutes, hours, days = F.floor(seconds / 60), F.floor(seconds / 3600), F.floor(seconds / 86400)
    named = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(minutes < 1, "now").when(hours < 1, named(minutes, "m")).when(days < 1, named(hours, "h")).when(days < 7, named(days, "d")).otherwise(named(F.floor(days / 7), "w"))
