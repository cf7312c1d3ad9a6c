"""The stored index: what searches and the lexicon read instead of tokenising all texts again.

``build`` writes it once; ``use`` lets all queries over an input folder of this application read it.  It
remembers which files it was built from and is refused when they have changed (``segments`` has one that takes changes).

Postings lie in order of (token, idx), cut by range, so that a query's few tokens are found by the
statistics of the files, and a very frequent token spreads over many files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = ("documents",)


class Stored:
    """A stored index: its tables by name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


_USED: dict[tuple[str, str], Stored] = {}


def _files(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the input files."""
    jvm, conf, seen = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in SOURCES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        store = path.getFileSystem(conf)
        found = store.listFiles(path, True)
        while found.hasNext():
            f = found.next()
            seen.append(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}")
    return "|".join(sorted(seen))


def build(spark: SparkSession, sf_dir: str, out: str) -> None:
    """Write the index of an input folder to ``out``, which must not exist, and use it."""
    from ..operators import early, grams, lexicon
    from .adapters import Views

    v = Views(spark, sf_dir, index=None)

    def put(df: DataFrame, name: str, *order: str) -> DataFrame:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        (df.repartitionByRange(parts, *order).sortWithinPartitions(*order) if order else df).write.parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    postings = put(v.postings(), "postings", "token", "idx")
    put(v.positions(), "positions", "token", "idx")
    lengths = put(postings.groupBy("idx").agg(F.sum("cnt").alias("dl")), "lengths", "idx")
    ranked = early.impacts(postings.groupBy("token", "idx").agg(F.sum("cnt").alias("tf")), lengths)
    put(early.blocks(put(ranked, "impacts", "token", "block", "idx")), "blocks", "token", "block")
    corpus = v.verses().select("idx").join(lengths, "idx", "left").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("dl", F.lit(0))).alias("avgdl"))
    per_token = postings.groupBy("token", "idx").agg(F.sum("cnt").alias("tf")).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    tokens = put(per_token.crossJoin(F.broadcast(corpus)).select("token", "df", "total", raw.alias("raw")), "tokens", "token")
    put(corpus.crossJoin(F.broadcast(tokens.agg(F.avg("raw").alias("mean_idf")))).withColumn("files", F.lit(_files(spark, sf_dir))).coalesce(1), "corpus")
    forms = put(v.forms_from(tokens.select(F.col("token").alias("form"))), "word_forms", "form")
    put(forms, "lemma_forms", "lemma", "form")
    words = put(v.words(), "words", "word", "book_slug")
    each = put(lexicon.word_stats(words).withColumn("letter", F.lower(F.substring("word", 1, 1))), "lexicon", "letter", "word")
    put(grams.counts(put(grams.postings(each), "grams", "gram", "letter", "word")), "gram_counts", "gram")
    use(spark, sf_dir, out)


def use(spark: SparkSession, sf_dir: str, out: str) -> None:
    """Let queries over ``sf_dir`` read the index at ``out``."""
    if spark.read.parquet(f"{out}/corpus").first().files != _files(spark, sf_dir):
        raise ValueError(f"{out} was not built from the files that {sf_dir} has now")
    _USED[spark.sparkContext.applicationId, sf_dir] = Stored(spark, out)


def forget(spark: SparkSession, sf_dir: str) -> None:
    _USED.pop((spark.sparkContext.applicationId, sf_dir), None)


def known(spark: SparkSession, sf_dir: str) -> Stored | None:
    return _USED.get((spark.sparkContext.applicationId, sf_dir))
