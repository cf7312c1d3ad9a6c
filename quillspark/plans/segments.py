"""A stored index that takes changes: immutable segments, tombstones, sums.

A commit writes one segment: what the new or changed texts hold, the ids whose earlier rows are ``gone``, and sums
(token and word statistics, numbers of tokens by document frequency) with the amounts that gone texts had
taken off.  Nothing that was written before is touched.  A manifest names the segments in order; it is written as
a whole under the next number, so a reader sees a commit or does not, and of two writers one fails.

Rows of a segment hold unless a later segment has their text among the gone.  Statistics are the sums over all
segments.  What a gone text held is found in rows that are kept by text (``token_rows``, ``word_rows``), in order of
idx, so that the statistics of the files find them.  A commit so reads the changed texts, their old rows, and
the sums of the tokens that they hold; it tokenises the changed texts only.

When ``FAN_OUT`` neighbouring segments at the end are of one level (powers of ``FAN_OUT`` of their texts), they are merged into
one, so every row is rewritten a logarithmic number of times and a reader meets a logarithmic number of segments.

An index holds all tables, or those that its first commit was told: one that only has to know its tokens (``STATISTICS``) has
neither postings by token, nor places, nor words by book, which are most of the work.  Queries use none that lacks a table.

``refresh`` finds by a hash of each document what has been added, changed or removed since the last commit.
The ids of documents are keys and not null; documents that share an id are changed together.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import index
from .adapters import LISTED, Views

FAN_OUT = 8
_BOOK = "book_slug string, testament string, noncanonical boolean, translation string"
#: Tables by text (column idx), in the order that they are kept in.
ROWS = {
    "postings": ("token string, idx bigint, translation string, cnt bigint", ("token", "idx")),
    "positions": ("token string, idx bigint, translation string, steps array<int>, gaps array<string>", ("token", "idx")),
    "lengths": ("idx bigint, dl bigint", ("idx",)),
    "texts": ("idx bigint, mark bigint, rows bigint", ("idx",)),
    "token_rows": ("idx bigint, token string, tf bigint, new bigint", ("idx", "token")),
    "word_rows": (f"idx bigint, word string, {_BOOK}, cnt bigint", ("idx", "word")),
}
#: Sums: keys, and what is added up.
SUMS = {
    "token_sums": ("token string, df bigint, total bigint", ("token",), ("df", "total")),
    "word_sums": (f"letter string, word string, {_BOOK}, cnt bigint", ("letter", "word", "book_slug", "testament", "noncanonical", "translation"), ("cnt",)),
    "df_sums": ("df bigint, tokens bigint", ("df",), ("tokens",)),
}
ALL = (*ROWS, *SUMS)
#: What the tables ``tokens`` and ``corpus`` are kept up to date by.
STATISTICS = ("lengths", "texts", "token_rows", "token_sums", "df_sums")
#: So many ids at most (8 MB) are sent to every task that looks for their rows; more meet these in a shuffle.
SENT = 1 << 20


class _Given(Views):
    """The relations over some documents."""

    def __init__(self, spark: SparkSession, documents: DataFrame):
        super().__init__(spark, "", index=None)
        self.documents = documents

    def table(self, name: str) -> DataFrame:
        return self.documents


def _marked(documents: DataFrame) -> DataFrame:
    """Rows (idx, mark, rows): a hash of what the index takes from each document."""
    each = documents.select(F.col("doc_id").alias("idx"), F.xxhash64("text", "lang", "source", "n_chars").alias("mark"))
    return each.groupBy("idx").agg(F.bit_xor("mark").alias("mark"), F.count(F.lit(1)).alias("rows"))


def _raw_idf(n: float, df: Column) -> Column:
    return F.log(F.lit(float(n)) - df + 0.5) - F.log(df + 0.5)


class Segments:
    """One version of a segmented index; ``table`` has the tables of a stored index."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None, holds: tuple[str, ...] = ALL):
        """``holds``: the tables of an index that has no commit yet."""
        self.spark, self.path = spark, path
        self.version = _last_version(spark, path) if version is None else version
        self.manifest = json.loads(_read(spark, f"{path}/manifest/{self.version:08d}.json")) if self.version else {"segments": [], "n": 0, "length": 0, "files": "", "holds": holds}
        self.holds = tuple(self.manifest.get("holds", ALL))

    @property
    def segments(self) -> list[dict]:
        return self.manifest["segments"]

    def part(self, segment: dict, name: str) -> DataFrame:
        if name not in (*self.holds, "gone"):
            raise ValueError(f"{self.path} was built without {name}")
        schema = "idx bigint" if name == "gone" else (ROWS | SUMS)[name][0]
        return self.spark.read.schema(schema).parquet(f"{self.path}/segments/{segment['name']}/{name}")

    def rows(self, name: str, segments: list[dict] | None = None) -> DataFrame:
        """Rows that hold of a table by text, of all segments or of neighbouring ones."""
        segments, out, gone = self.segments if segments is None else segments, [], None
        for segment in reversed(segments):
            mine = self.part(segment, name)
            out.append(mine if gone is None else mine.join(gone, "idx", "left_anti"))
            if segment["gone"]:
                late = self.part(segment, "gone")
                gone = late if gone is None else gone.unionByName(late)
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], ROWS[name][0])

    def sums(self, name: str, segments: list[dict] | None = None) -> DataFrame:
        schema, keys, amounts = SUMS[name]
        segments = self.segments if segments is None else segments
        every = reduce(DataFrame.unionByName, [self.part(s, name) for s in segments]) if segments else self.spark.createDataFrame([], schema)
        if len(segments) < 2:
            return every
        return every.groupBy(*keys).agg(*(F.sum(a).alias(a) for a in amounts)).where(" or ".join(f"{a} <> 0" for a in amounts))

    def table(self, name: str) -> DataFrame:
        from ..operators import early, lexicon

        if name == "impacts":
            return early.impacts(self.rows("token_rows"), self.rows("lengths"))
        if name == "blocks":
            return early.blocks(self.table("impacts"))
        if name == "tokens":
            return self.sums("token_sums").where("df > 0").select("token", "df", "total", _raw_idf(self.manifest["n"], F.col("df")).alias("raw"))
        if name == "corpus":
            n = self.manifest["n"]
            mean = F.sum(F.col("tokens") * _raw_idf(n, F.col("df"))) / F.sum("tokens")
            return self.sums("df_sums").where("df > 0").agg(mean.alias("mean_idf")).select(F.lit(n).cast("bigint").alias("n"), F.lit(self.manifest["length"] / n if n else None).cast("double").alias("avgdl"), "mean_idf")
        if name in ("word_forms", "lemma_forms"):
            return _Given(self.spark, None).forms_from(self.table("tokens").select(F.col("token").alias("form")))
        if name == "words":
            return self.sums("word_sums").where("cnt > 0").drop("letter")
        if name == "lexicon":
            return lexicon.word_stats(self.sums("word_sums").where("cnt > 0")).withColumn("letter", F.lower(F.substring("word", 1, 1)))
        return self.rows(name)

    def forms_near(self, words: list[str]) -> DataFrame:
        """``word_forms`` of the words that may share a lemma with one of these."""
        near = [F.startswith("token", F.lit(w[:5])) if len(w) >= 5 else F.col("token") == w for w in words]
        return _Given(self.spark, None).forms_from(self.table("tokens").where(reduce(Column.__or__, near)).select(F.col("token").alias("form")))

    # -- changes ---------------------------------------------------------------------------

    def commit(self, upserts: DataFrame | None, removed: DataFrame | None, files: str = "") -> Segments:
        """The index after some documents (all columns) have come in place of those with their ids, and those with some ids (doc_id) have gone."""
        spark = self.spark
        if upserts is None:
            upserts = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        # A table by text is made in the rows of the texts, so these are put in order and not its own, many more, rows.
        v, name = _Given(spark, upserts.sortWithinPartitions("doc_id")), uuid.uuid4().hex
        ids = upserts.select(F.col("doc_id").alias("idx"))
        if removed is not None:
            ids = ids.unionByName(removed.select(F.col("doc_id").cast("bigint").alias("idx")))
        folder = f"{self.path}/segments/{name}"

        def put(df: DataFrame, table: str, in_order: bool = False) -> DataFrame:
            schema, *order = (ROWS | SUMS | {"gone": ("idx bigint", ("idx",))})[table]
            df = df.select(*(c.split()[0] for c in schema.split(", ")))
            (df if in_order else df.repartitionByRange(*order[0]).sortWithinPartitions(*order[0])).write.parquet(f"{folder}/{table}")
            return spark.read.schema(schema).parquet(f"{folder}/{table}")

        known = self._of(ids.distinct(), "texts")
        gone = put(known.select("idx"), "gone")
        own_rows, holds = v.distinct_ids(), self.holds
        texts = put(_marked(upserts), "texts")
        token_rows = put(v.tokens_by_text(), "token_rows", own_rows)
        lengths = put(token_rows.groupBy("idx").agg(F.sum("tf").alias("dl")), "lengths")
        sides = F.inline(F.array(F.struct(F.lit("new").alias("translation"), F.col("new").alias("cnt")), F.struct(F.lit("old").alias("translation"), (F.col("tf") - F.col("new")).alias("cnt"))))
        if "postings" in holds:
            put(token_rows.select("token", "idx", sides).where("cnt > 0"), "postings")
        if "positions" in holds:
            put(v.positions(), "positions")

        sign = lambda df, by: df.withColumn("sign", F.lit(by))
        both = lambda new, table: sign(new, 1).unionByName(sign(self._of(gone, table), -1))
        tokens = put(both(token_rows, "token_rows").groupBy("token").agg(F.sum("sign").alias("df"), F.sum(F.col("sign") * F.col("tf")).alias("total")), "token_sums")
        if "word_rows" in holds:
            words = both(put(v.words_by_text(), "word_rows", own_rows), "word_rows").groupBy("word", "book_slug", "testament", "noncanonical", "translation").agg(F.sum(F.col("sign") * F.col("cnt")).alias("cnt"))
            put(words.where("cnt <> 0").withColumn("letter", F.lower(F.substring("word", 1, 1))), "word_sums")
        before = self.sums("token_sums").select("token", F.col("df").alias("was"))
        moved = tokens.where("df <> 0").join(before, "token", "left").select(F.coalesce("was", F.lit(0)).alias("was"), (F.coalesce("was", F.lit(0)) + F.col("df")).alias("now"))
        bins = moved.select(F.inline(F.array(F.struct(F.col("was").alias("df"), F.lit(-1).alias("tokens")), F.struct(F.col("now").alias("df"), F.lit(1).alias("tokens")))))
        put(bins.where("df > 0").groupBy("df").agg(F.sum("tokens").alias("tokens")).where("tokens <> 0"), "df_sums")

        added = texts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).crossJoin(lengths.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("length"))).first()
        lost = self._of(gone, "texts").agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).crossJoin(self._of(gone, "lengths").agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("length"))).first()
        segment = {"name": name, "texts": added.n, "gone": lost.texts, "level": _level(added.n)}
        return self._next([*self.segments, segment], self.manifest["n"] + added.n - lost.n, self.manifest["length"] + added.length - lost.length, files)._merged()

    def _of(self, ids: DataFrame, table: str) -> DataFrame:
        """The rows that hold of some texts (column idx); the scans are told which, or between which."""
        rows = self.rows(table)
        if not self.segments:
            return rows
        few = [r.idx for r in ids.limit(LISTED + 1).collect()]
        if len(few) <= LISTED:
            return rows.where(F.col("idx").isin(few)) if few else rows.limit(0)
        ends = ids.agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.count("idx").alias("n")).first()
        return rows.where(F.col("idx").between(ends.a, ends.b)).join(F.broadcast(ids) if ends.n <= SENT else ids, "idx", "left_semi")

    def _next(self, segments: list[dict], n: int, length: int, files: str) -> Segments:
        _write(self.spark, f"{self.path}/manifest/{self.version + 1:08d}.json", json.dumps({"segments": segments, "n": n, "length": length, "files": files, "holds": self.holds}))
        return Segments(self.spark, self.path, self.version + 1)

    def _merged(self) -> Segments:
        """Merge segments of one level at the end, as long as there are ``FAN_OUT`` of them."""
        tail = self.segments[-FAN_OUT:]
        if len(tail) < FAN_OUT or len({s["level"] for s in tail}) > 1:
            return self
        return self.merge(len(tail))._merged()

    def merge(self, last: int) -> Segments:
        """The same index with its last so many segments as one."""
        head, tail = self.segments[:-last], self.segments[-last:]
        name = uuid.uuid4().hex
        folder = f"{self.path}/segments/{name}"
        for table, order in ((t, ROWS[t][1]) for t in ROWS if t in self.holds):
            self.rows(table, tail).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{folder}/{table}")
        for table, keys in ((t, SUMS[t][1]) for t in SUMS if t in self.holds):
            self.sums(table, tail).repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{folder}/{table}")
        gone = reduce(DataFrame.unionByName, [self.part(s, "gone") for s in tail]).distinct()
        (gone if head else gone.limit(0)).write.parquet(f"{folder}/gone")  # the first segment has nothing before it
        texts = self.spark.read.schema(ROWS["texts"][0]).parquet(f"{folder}/texts").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        segment = {"name": name, "texts": texts, "gone": sum(s["gone"] for s in tail) if head else 0, "level": _level(sum(s["texts"] for s in tail))}
        return self._next([*head, segment], self.manifest["n"], self.manifest["length"], self.manifest["files"])


def _level(texts: int) -> int:
    return int(math.log(max(1, texts)) / math.log(FAN_OUT))


def build(spark: SparkSession, sf_dir: str, out: str) -> Segments:
    """Write the index of an input folder to ``out``, which must not exist, and use it."""
    if _last_version(spark, out):
        raise ValueError(f"{out} has an index already")
    return _used(Segments(spark, out).commit(Views(spark, sf_dir, index=None).table("documents"), None, index._files(spark, sf_dir)), sf_dir)


def refresh(spark: SparkSession, sf_dir: str, out: str) -> Segments:
    """Commit what has changed in an input folder since the last commit, and use the index."""
    now, files = Segments(spark, out), index._files(spark, sf_dir)
    if now.manifest["files"] != files:
        documents = Views(spark, sf_dir, index=None).table("documents")
        old = now.rows("texts").select("idx", F.col("mark").alias("old_mark"), F.col("rows").alias("old_rows"))
        found = _marked(documents).join(old, "idx", "full").where("mark is null or old_mark is null or mark <> old_mark or rows <> old_rows").select("idx", F.col("mark").isNull().alias("lost"))
        path = f"{out}/changes/{uuid.uuid4().hex}"
        found.write.parquet(path)
        changes = spark.read.parquet(path)
        upserts = documents.join(changes.where("not lost").select(F.col("idx").alias("doc_id")), "doc_id", "left_semi")
        now = now.commit(upserts, changes.where("lost").select(F.col("idx").alias("doc_id")), files)
    return _used(now, sf_dir)


def use(spark: SparkSession, sf_dir: str, out: str) -> Segments:
    """Let queries over ``sf_dir`` read the index at ``out``."""
    now = Segments(spark, out)
    if now.manifest["files"] != index._files(spark, sf_dir):
        raise ValueError(f"{out} was not built from the files that {sf_dir} has now: refresh it")
    return _used(now, sf_dir)


def _used(now: Segments, sf_dir: str) -> Segments:
    if set(ALL) - set(now.holds):
        raise ValueError(f"{now.path} lacks tables that queries read: {sorted(set(ALL) - set(now.holds))}")
    index._USED[now.spark.sparkContext.applicationId, sf_dir] = now
    return now


# -- small files in any file system that Spark reaches ----------------------------------------


def _store(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _last_version(spark: SparkSession, path: str) -> int:
    store, place = _store(spark, f"{path}/manifest")
    if not store.exists(place):
        return 0
    names = [f.getPath().getName() for f in store.listStatus(place)]
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)


def _read(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())


def _write(spark: SparkSession, path: str, body: str) -> None:
    """Write a small file as a whole: under another name first, then renamed; a file that is there is an error."""
    store, place = _store(spark, path)
    trial = place.suffix(f".{uuid.uuid4().hex}.part")
    out = store.create(trial, False)
    out.write(bytearray(body.encode()))
    out.close()
    if store.exists(place) or not store.rename(trial, place):
        raise RuntimeError(f"{path} was written by another commit")
