"""Operator 12: importance resampling of documents towards a target's distribution of hashed n-grams.

A feature is a run of 1 to ``orders`` consecutive words.  Every word gets its position (``posexplode``), a
window of ``lead()`` over each text lays the following words beside it, and the n-grams of every order are hashed
into ``BUCKETS`` buckets.  A bucket's gain is the logarithm of its share in the target over its share in the documents,
both smoothed by one.  The gains, one row for each bucket and so at most ``BUCKETS`` of them, are joined to the
features again, and a document weighs their mean.  Of the documents with ``LEAST_WORDS`` words, those with the
highest weight plus Gumbel noise are drawn, which is sampling without replacement in proportion to the weights.

Words stay where they are for order 1, which needs no following words: rows of one text are counted in
the task that made them before anything is shuffled, and one row for each text is.  For higher orders texts, once
for each distinct (id, text), are dealt by key, and the window needs no exchange but that one.  The ranks are
given in range partitions on top of the counts of the partitions before, so no task sorts all documents.

Defined results: words are runs of digits, letters a-z (A-Z are lower-cased, no other letters) and characters that
are not ASCII; a null or empty text has no words, no features and weight 0, and is never drawn; repeated rows
(same id and text) each count and get scores alike, and take ranks one after another; a null id is hashed as
an empty string and comes first among equal scores; other columns are not read, whatever their names; an
empty table gives an empty table, an empty target counts nothing; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import cut, written

BUCKETS, ORDERS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
_RUN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ("doc_id", "mark", "check")


def _lowered(word: Column) -> Column:
    """A-Z in lower case; the plain ``lower`` does it where all is ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def features(texts: DataFrame, orders: int, buckets: int) -> DataFrame:
    """Rows (doc_id, mark, check, copies, first, pos, bucket) of the texts' n-grams; a text without words has one with a null bucket."""
    key = [F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"), F.xxhash64(F.lit(1), "text").alias("check")]
    keyed = texts.select(*key, F.lit(1).cast("bigint").alias("copies"), F.col("text").cast("string").alias("text"))
    if orders > 1:
        keyed = keyed.groupBy(*_KEY).agg(F.sum("copies").alias("copies"), F.first("text").alias("text"))
    words = keyed.select(*_KEY, "copies", F.posexplode_outer(F.regexp_extract_all("text", F.lit(_RUN), F.lit(0))).alias("pos", "run"))
    words = words.select(*_KEY, "copies", "pos", _lowered(F.col("run")).alias("gram"))
    if orders > 1:
        along = Window.partitionBy(*_KEY).orderBy("pos")
        following = [F.lead("gram", k).over(along).alias(f"w{k}") for k in range(1, orders)]
        grams = F.array(*(F.array(F.col("gram"), *(F.col(f"w{k}") for k in range(1, n))) for n in range(1, orders + 1)))
        whole = F.filter(grams, lambda g: ~F.exists(g, lambda w: w.isNull()))
        words = words.select("*", *following).select(*_KEY, "copies", "pos", F.posexplode_outer(F.transform(whole, lambda g: F.array_join(g, " "))).alias("order", "gram"))
    else:
        words = words.withColumn("order", F.lit(0))
    first = (F.coalesce("pos", F.lit(0)) == 0) & (F.coalesce("order", F.lit(0)) == 0)
    bucket = (F.crc32(F.col("gram").cast("binary")) % buckets).cast("int")
    return words.select(*_KEY, "copies", first.alias("first"), (F.col("gram").isNotNull() & (F.coalesce("order", F.lit(0)) == 0)).alias("is_word"), bucket.alias("bucket"))


def gains(docs: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, gain) from the features of both sides: one for each bucket that documents have."""

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.where("bucket is not null").groupBy("bucket").agg(F.sum("copies").alias(name))

    s, t = counted(docs, "s"), counted(target.select("bucket", "copies"), "t")
    both = s.join(t, "bucket", "left").select("bucket", "s", F.coalesce("t", F.lit(0)).alias("t"))
    sizes = s.agg(F.sum("s").alias("all_s")).crossJoin(t.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("all_t")))
    real = {c: F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t")}
    ratio = (real["t"] + 1) * (real["all_s"] + buckets) / ((real["s"] + 1) * (real["all_t"] + buckets))
    return both.crossJoin(F.broadcast(sizes)).select("bucket", F.floor(1000 * F.log(ratio)).cast("bigint").alias("gain"))


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise of a document, in thousandths, the same in every run."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def weighed(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """Rows (doc_id, mark, check, n_words, n_features, weight), one for each row of ``docs``."""
    own = features(docs, orders, buckets)
    aimed = features(target.select(F.lit(None).alias("doc_id"), "text"), orders, buckets)
    known = gains(own, aimed, buckets)
    rows = F.sum(F.when(F.col("first"), F.lit(1)).otherwise(0))
    total = own.join(F.broadcast(known), "bucket", "left").groupBy(*_KEY).agg(
        rows.alias("rows"),
        F.sum(F.when(F.col("first"), F.col("copies")).otherwise(0)).alias("copies"),
        F.count(F.when(F.col("is_word"), 1)).alias("n_words"),
        F.count("bucket").alias("n_features"),
        F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"),
    )
    mean = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(0)
    each = total.select(*_KEY, "copies", F.expr("n_words div rows").alias("n_words"), F.expr("n_features div rows").alias("n_features"), mean.cast("bigint").alias("weight"))
    return each.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("_copy", "copies")


def drawn(scored: DataFrame, percent: int) -> DataFrame:
    """Rows with a rank (1, 2, 3, ... by descending score, smaller ids first) for the ``percent`` of them that come first, null for the others."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_first(), F.col("mark"), F.col("check")]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(scored.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    every = Window.partitionBy(F.lit(1))
    known = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"), F.sum("rows").over(every).alias("n"))
    place = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    placed = dealt.join(known, "part").withColumn("place", place)
    return placed.withColumn("rank", F.when(F.col("place") <= F.expr(f"({percent} * n) div 100"), F.col("place")).cast("bigint")).drop("part", "base", "n", "place")


def resample(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank), one for each row of ``docs``; ``rank`` is null where a row is not drawn."""
    scored = written(weighed(docs, target, orders, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn(scored.where(F.col("n_words") >= least_words), percent).select(out).unionByName(rest.select(out))


#: DuckDB SQL for ``resample``; CRC-32 is computed bit by bit, once for each distinct word.
ORACLE = r"""
with docs as (select row_number() over () as d, doc_id, coalesce(text, '') as text from documents),
split as (select d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from docs),
own as (select d, unnest(words) as word from split),
aimed as (select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark),
spelled as (select word, hex(encode(word)) as bytes from (select word from own union select word from aimed)),
hashed as (
  select word, xor(list_reduce(list_transform(range(length(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::bigint),
    lambda c, b: list_reduce(range(8), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(c, b)), 4294967295::bigint), 4294967295) % 10000 as bucket
  from spelled),
s as (select bucket, count(*) as s from own join hashed using (word) group by 1),
t as (select bucket, count(*) as t from aimed join hashed using (word) group by 1),
gains as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select sum(s) from s)::double + 10000) / ((s + 1)::double * (coalesce((select sum(t) from t), 0)::double + 10000))))::bigint as gain
  from s left join t using (bucket)),
weights as (select d, floor(sum(gain)::double / count(*))::bigint as weight from own join hashed using (word) join gains using (bucket) group by 1),
scored as (
  select doc_id, len(words) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from split left join weights using (d)),
placed as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls first) as place, count(*) over (partition by n_features >= 20) as n from scored)
select doc_id, n_features::bigint as n_features, weight, score, case when n_features >= 20 and place <= 10 * n // 100 then place end as rank from placed
"""
