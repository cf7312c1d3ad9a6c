"""Operator 10: mix sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, the source's
target over its size.  The documents of a source are put in one total order
(size, then id), their expected copies are prefix-summed, one
random offset per source is added, and a document is emitted once for each
integer that its stretch of the sum crosses.  Ordering by size makes the words
taken follow the target closely.

Words are counted once, into a (small) table of ids, sizes and sources.  The prefix sum
is distributed: the table is range-partitioned in the total order, counted by
partition, and numbered within its partitions on top of the counts of the partitions
before.  A source that holds most rows spreads over many partitions.  The dealt
table is cut off with ``checkpoint()``, so that both uses of it see the same partitions.
``mixed_rows`` does not move texts: what is taken is kept as sorted arrays in the shared
folder, and every row looks up how often it is taken.

Defined results: a null or blank text has size 0, and a source without words has
target 0 and takes nothing; a null source is a source of its own, the last one;
rows that agree in source, size and id are interchangeable and each counts;
extra columns are not read, whatever their names; an empty table gives an empty table;
texts of any length are counted whole.  The windows over sources run over one row for
each source in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import cut, unused, written
from .ranges import Ranges

MOST_COPIES = 3
WEIGHT_CYCLE = 3
#: Code point U+0020 and U+0009 to U+000D part words.
WORD = "[^ \\t-\\r]+"
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, source_size).

    Weights 1, 2, 3 repeat over the sources in code point order, null last.  A
    source's target is its weight times a common level, but ``MOST_COPIES`` times
    its size at most.  With the sources in order of (cap / weight) the capped ones
    come first, so the level follows from running sums.  All windows here run over
    one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    so_far, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    ranked = (
        sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % WEIGHT_CYCLE + 1).cast("bigint"))
        .withColumn("cap", F.col("source_size") * MOST_COPIES)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(so_far), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(so_far), F.lit(0)))
        .withColumn("level", F.col("rest").cast("double") / F.col("weights"))
    )
    # The first source (in this order) that its own level leaves below its cap sets the level of all after it.
    free = ranked.withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    share = F.when(F.col("water").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("water")))
    return free.select("source", "source_size", share.alias("target"))


def offset_of(source: Column) -> Column:
    """The random offset of a source in [0, 1), the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(F.concat(F.lit(":"), source), F.lit("")))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def sample(sized: DataFrame, key: str) -> DataFrame:
    """Add (source_size, target, copies) to rows with ``source`` and ``size``; ``key`` orders equal sizes."""
    spark = sized.sparkSession
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col(key).asc_nulls_first()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(sized.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part", "source").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("_part").alias("_known_part"), F.col("source").alias("_source"), "_base")
    goals = targets(counts.groupBy("source").agg(F.sum("_words").alias("source_size"))).withColumnRenamed("source", "_goal_source")
    known = bases.join(goals, F.col("_source").eqNullSafe(F.col("_goal_source"))).drop("_goal_source")
    numbered = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_part", "source").orderBy(*order[1:])))
    joined = numbered.join(known, (F.col("_part") == F.col("_known_part")) & F.col("source").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = (F.col("_base") + F.col("_k")).cast("double")
    start = offset_of(F.col("source"))
    crossed = F.floor(place * rate + start) - F.floor((place - 1) * rate + start)
    return joined.withColumn("copies", F.least(crossed, F.lit(MOST_COPIES)).cast("bigint")).drop("_part", "_known_part", "_source", "_base", "_k")


def mix(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, source, copies), one for each document."""
    sized = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))
    return sample(sized, "doc_id").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mixture itself: every row as often as the sample takes it, with the columns of ``docs``.

    Rows that agree in id, source and text are one unit here: they are taken equally often.
    """
    unit = F.xxhash64("doc_id", "source", "text").alias("unit")
    sized = written(docs.select(unit, F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))
    units = written(sized.groupBy("unit").agg(F.min("source").alias("source"), F.sum("size").alias("size")))
    taken = Ranges(docs.sparkSession, "mixture")
    taken.table(sample(units, "unit").where("copies > 0").select("unit", "copies"), "unit", "copies")

    copies, again = unused("copies", docs.columns), unused("again", docs.columns)
    looked_up = docs.withColumn(copies, taken.looked_up("unit", "copies", unit, 0)).where(F.col(copies) > 0)
    return looked_up.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


#: DuckDB SQL for ``mix`` (without the last two columns).
ORACLE = """
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0)::bigint as size from documents),
sizes as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as weight, 3 * source_size as cap from sizes),
ranked as (
  select *, cap::double / weight as ratio,
    (sum(source_size) over () - coalesce(sum(cap) over w, 0))::double / (sum(weight) over () - coalesce(sum(weight) over w, 0))::double as level
  from weighed window w as (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding)),
water as (select level as water from ranked where level <= ratio order by ratio, level limit 1),
goals as (select source, source_size, least(cap::double, weight * (select water from water)) as target from ranked),
placed as (
  select s.*, g.source_size, g.target, case when g.source_size > 0 then g.target / g.source_size else 0 end as rate,
    row_number() over (partition by s.source order by s.size, s.doc_id nulls first)::double as k,
    ('0x' || substr(md5('mix-1' || coalesce(':' || s.source, '')), 1, 8))::bigint / 4294967296.0::double as start
  from sized s join goals g on s.source is not distinct from g.source)
select doc_id, size, source_size, target, size * least(floor(k * rate + start) - floor((k - 1) * rate + start), 3)::bigint as taken from placed
"""
