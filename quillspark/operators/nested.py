"""Documents of any depth: every value with its path, and what differs between two of them.

Text that is null or no JSON gives no rows, nor does an empty object or array.  Of a document with a key twice nothing is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nesting(doc: Column) -> Column:
    """How many brackets are open at once, outside of strings; regular expressions without groups, so that any length will do."""
    outside = F.regexp_replace(F.regexp_replace(doc, r"\\.", ""), r'"[^"]*"', "")
    brackets = F.filter(F.split(F.regexp_replace(outside, r"[^\[\]{}]", ""), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, c: Column) -> Column:
        now = at["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(brackets, start, step)["most"]


def walk(rows: DataFrame, key: str, doc: str) -> DataFrame:
    """Rows (key, path, value) of all values that are no objects or arrays, as text.

    A pass over the documents finds how deep they go; the next opens that many levels, one behind the other, without a shuffle.
    """
    spark = rows.sparkSession
    each = rows.select(F.col(key).alias("key"), F.col(doc).cast("string").alias("doc"))
    deep = each.agg(F.max(nesting(F.col("doc")))).first()[0] or 0
    at = each.select("key", F.lit("$").alias("path"), F.try_parse_json("doc").alias("value")).where("value is not null")
    box = F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)")
    for _ in range(deep):
        held = at.select("key", F.col("path").alias("above"), F.col("value").alias("whole"), box.alias("opened"))
        parts = spark.tvf.variant_explode_outer(F.when(F.col("opened").outer(), F.col("whole").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).when(F.col("pos").isNotNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise("")
        named = parts.select(F.col("pos").isNotNull().alias("inside"), step.alias("step"), "value")
        at = held.lateralJoin(named).where("inside or not opened").select("key", F.concat("above", "step").alias("path"), F.when(F.col("opened"), F.col("value")).otherwise(F.col("whole")).alias("value"))
    return at.where(~box).select("key", "path", F.col("value").cast("string").alias("value"))


def diff(before: DataFrame, after: DataFrame, key: str, doc: str, samples: int = 10) -> DataFrame:
    """Rows (key, path, before, after, r, changes): the first ``samples`` paths of each document whose values differ, one being null where it is missing, and how many there are."""
    sides = [walk(rows, key, doc).select("key", "path", F.col("value").alias(name), F.lit(True).alias(f"in_{name}")) for rows, name in ((before, "before"), (after, "after"))]
    both = sides[0].join(sides[1], ["key", "path"], "full")
    differ = both.where(F.col("in_before").isNull() | F.col("in_after").isNull() | ~F.col("before").eqNullSafe(F.col("after"))).select("key", "path", "before", "after")
    order = Window.partitionBy("key").orderBy("path")
    total = differ.groupBy("key").agg(F.count(F.lit(1)).alias("changes"))
    first = differ.withColumn("r", F.row_number().over(order)).where(F.col("r") <= samples)  # ranked within each task before the shuffle
    return first.join(total, "key")
