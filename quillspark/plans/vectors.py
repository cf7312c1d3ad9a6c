"""An index of vectors: inverted lists over centroids, product-quantised codes, exact re-ranking.

``build`` fits centroids and code books on a bounded sample and writes every usable vector under its list: blocks of codes,
which searches read, and the vectors themselves, of which they read those that they rank again.  How many lists a
search reads follows from the sample: so many that its own neighbours would be found, whatever the vectors look like.

A null vector, one with null, infinite or no components other than zero, or of another length than the sample's first has no place
in the index, and finds nothing as a query.  Keys are whole numbers; rows that repeat one are told apart by nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .memory import frugal
from .shared import new_path, written

#: Vectors, of the smallest hashes of keys, on which centroids and code books are fitted.
SAMPLE = 16_384
#: Lists at most; their number is the square root of that of the vectors.
MOST_LISTS = 4096
#: Components that share one byte of a code.
STEP = 2
#: Rows of a block of a list, and queries that meet it at once.
BLOCK = 1024
PACK = 128
#: Lists are dealt to so many shards, at every size, as a query gets candidates from each; packs of queries to so many parts, each of which gets the codes.
SHARDS = 8
PARTS = 8
#: The share of neighbours whose lists are to be read.
RECALL = 0.97
#: Candidates by codes that are ranked again, for each row of an answer.
DEPTH = 4

Batches = Iterator[pa.RecordBatch]


def _usable(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    return vectors.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("vec")).where(F.col("key").isNotNull() & _usable(F.col("vec")))


def _unit(lists: pa.Array) -> np.ndarray:
    x = np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, np.int64)] + [(x[i : i + 2048] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 2048)])


def _centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows (which lie in order of a hash)."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.stack([np.bincount(at, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Model:
    """Centroids of lists, and a code book for every ``STEP`` components of what is left of a vector beside its centroid."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.dim = sample.shape[1]
        self.centres = _centres(sample, lists)
        self.cuts = [(a, min(a + STEP, self.dim)) for a in range(0, self.dim, STEP)]
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.books = [_centres(rest[:, a:z], 256) for a, z in self.cuts]
        self.probes = self._probes(sample)

    def _probes(self, sample: np.ndarray, asked: int = 256, k: int = 100) -> int:
        """How many of a vector's next lists hold ``RECALL`` of its next ``k`` in the sample; in all rows they are nearer, thus in fewer lists."""
        some = sample[:: max(1, len(sample) // asked)]
        k = min(k, len(sample))
        near = np.argpartition(-(some @ sample.T), k - 1, axis=1)[:, :k]
        places = np.argsort(self.order(some), axis=1)
        at = np.take_along_axis(places, _nearest(sample, self.centres)[near], axis=1)
        return int(np.quantile(at, RECALL, method="higher")) + 1

    def order(self, x: np.ndarray) -> np.ndarray:
        """All lists for each row, the next first."""
        return np.argsort((self.centres * self.centres).sum(axis=1) / 2 - x @ self.centres.T, axis=1, kind="stable")

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _nearest(x, self.centres)
        rest = x - self.centres[at]
        return at, np.stack([_nearest(rest[:, a:z], b) for (a, z), b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)

    def decoded(self, at: int, codes: np.ndarray) -> np.ndarray:
        return self.centres[at] + np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], 1)


class Vectors:
    """A written index: ``model`` (nothing if no vector is usable) and the folder of its tables."""

    def __init__(self, spark: SparkSession, path: str, model: Model | None, shards: int):
        self.spark, self.path, self.model, self.shards = spark, path, model, shards

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def search(self, queries: DataFrame, key: str, vector: str, k: int = 100, probes: int | None = None, depth: int | None = None) -> DataFrame:
        """Rows (query, key, score, rank): the ``k`` next vectors of each query by cosine (rounded to nine places, then the smaller key), itself included.

        ``probes``: lists to read, those that the sample asks for unless it is given.
        """
        spark, model = self.spark, self.model
        if model is None:
            return spark.createDataFrame([], "query bigint, key bigint, score double, rank int")
        asked = _rows(queries, key, vector).where(F.size("vec") == model.dim)
        depth = depth or k * DEPTH
        packs = self._packs(asked, min(probes or model.probes, len(model.centres)))
        blocks = self.table("codes").withColumn("shard", F.col("list") % self.shards).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        found = self._candidates(packs.withColumn("part", F.pmod(F.xxhash64("pack"), F.lit(PARTS)).cast("int")).join(blocks, ["shard", "part"]), depth)
        best = Window.partitionBy("query").orderBy(F.desc("near"), "list", "key")
        kept = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= depth).select("query", "list", "key")
        left = asked.select(F.col("key").alias("query"), F.col("vec").alias("a"))
        right = self.table("vectors").select("list", "key", F.col("vec").cast("array<double>").alias("b"))
        return _ranked(kept.join(right, ["list", "key"]).join(left, "query"), k)

    def _packs(self, asked: DataFrame, probes: int) -> DataFrame:
        """Queries in packs, for each shard whose lists they are to read: rows (shard, pack, queries, units, wanted)."""
        shared, shards = self.spark.sparkContext.broadcast(self.model), self.shards  # of bounded size

        def run(batches: Batches) -> Batches:
            model = shared.value
            task, n = TaskContext.get().partitionId() << 32, 0
            for batch in batches:
                for first in range(0, len(batch), PACK):
                    part = batch.slice(first, PACK)
                    unit = _unit(part.column(1))
                    wanted = np.zeros((len(part), len(model.centres)), bool)
                    np.put_along_axis(wanted, model.order(unit)[:, :probes], True, axis=1)
                    n += 1
                    out = [[], [], [], [], []]
                    for shard in range(shards):
                        rows = np.flatnonzero(wanted[:, shard::shards].any(axis=1))
                        if len(rows):
                            some = (shard, task + n, np.asarray(part.column(0))[rows].tobytes(), unit[rows].astype(np.float32).tobytes(), np.packbits(wanted[rows, shard::shards], axis=1).tobytes())
                            for column, value in zip(out, some, strict=True):
                                column.append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), *(pa.array(c, pa.binary()) for c in out[2:])], ["shard", "pack", "queries", "units", "wanted"])

        return asked.mapInArrow(frugal(run), "shard int, pack bigint, queries binary, units binary, wanted binary")

    def _candidates(self, pairs: DataFrame, depth: int) -> DataFrame:
        """The ``depth`` next of each query by codes, of all blocks that its pack meets in a row: rows (query, list, key, near)."""
        shared, shards = self.spark.sparkContext.broadcast(self.model), self.shards

        def run(batches: Batches) -> Batches:
            model = shared.value
            held: dict = {}

            def rows() -> Iterator[pa.RecordBatch]:
                for i, query in enumerate(held.get("queries", ())):
                    got = held["best"][i]
                    if got is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got[0]), query)), *(pa.array(c) for c in got)], ["query", "list", "key", "near"])

            for batch in batches:
                for row in batch.to_pylist():
                    if held.get("pack") != (row["shard"], row["pack"]):
                        yield from rows()
                        queries = np.frombuffer(row["queries"], np.int64)
                        held = {"pack": (row["shard"], row["pack"]), "queries": queries, "best": [None] * len(queries), "units": np.frombuffer(row["units"], np.float32).reshape(len(queries), -1)}
                        held["wanted"] = np.unpackbits(np.frombuffer(row["wanted"], np.uint8).reshape(len(queries), -1), axis=1)
                    who = np.flatnonzero(held["wanted"][:, row["list"] // shards])
                    if not len(who):
                        continue
                    keys = np.frombuffer(row["keys"], np.int64)
                    codes = np.frombuffer(row["codes"], np.uint8).reshape(len(keys), -1)
                    near = (held["units"][who] @ model.decoded(row["list"], codes).T.astype(np.float32)).astype(np.float32)
                    for i, scores in zip(who, near, strict=True):
                        held["best"][i] = _merged(held["best"][i], row["list"], keys, scores, depth)
            yield from rows()

        narrow = pairs.select("shard", "pack", "queries", "units", "wanted", "list", "keys", "codes")
        return narrow.mapInArrow(frugal(run), "query bigint, list int, key bigint, near float")


def _merged(best: tuple | None, at: int, keys: np.ndarray, scores: np.ndarray, depth: int) -> tuple:
    """The ``depth`` best of what there was and a block, equal scores by smaller (list, key)."""
    if best is not None and len(best[0]) == depth:
        some = np.flatnonzero(scores >= best[2].min())
        if not len(some):
            return best
        keys, scores = keys[some], scores[some]
    lists = np.full(len(keys), at, np.int32)
    if best is not None:
        lists, keys, scores = (np.concatenate(pair) for pair in zip(best, (lists, keys, scores), strict=True))
    if len(keys) > depth:
        order = np.lexsort((keys, lists, -scores))[:depth]
        lists, keys, scores = lists[order], keys[order], scores[order]
    return lists, keys, scores


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    scored = pairs.select("query", "key", F.round(dot(F.col("a"), F.col("b")) / F.sqrt(dot(F.col("a"), F.col("a"))) / F.sqrt(dot(F.col("b"), F.col("b"))), 9).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def build(vectors: DataFrame, key: str, vector: str, out: str | None = None) -> Vectors:
    """Write the index of all usable vectors to ``out``, a place in the shared folder unless it is given."""
    spark = vectors.sparkSession
    path = out or new_path(spark, "vectors")
    rows = _rows(vectors, key, vector)
    few = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toArrow()
    if not len(few):
        return Vectors(spark, path, None, 1)
    lists = few.column("vec").combine_chunks()
    dim = len(lists[0])
    sample = _unit(lists.filter(pc.equal(pc.list_value_length(lists), dim)))
    total = rows.where(F.size("vec") == dim).count()
    model = Model(sample, min(MOST_LISTS, max(1, round(total**0.5))))
    shared = spark.sparkContext.broadcast(model)

    def code(batches: Batches) -> Batches:
        for batch in batches:
            at, codes = shared.value.coded(_unit(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], ["list", "key", "code", "vec"])

    def block(batches: Batches) -> Batches:
        """Rows of one list that lie one behind the other, ``BLOCK`` at most."""
        for batch in batches:
            at = np.asarray(batch.column(0))
            borders = np.append(0, np.flatnonzero(at[1:] != at[:-1]) + 1) if len(at) else []
            ends = np.append(borders[1:], len(at)) if len(at) else []
            cuts = [(i, min(i + BLOCK, z)) for a, z in zip(borders, ends, strict=True) for i in range(int(a), int(z), BLOCK)]
            keys = [np.asarray(batch.column(1))[a:z].tobytes() for a, z in cuts]
            codes = [b"".join(batch.column(2)[a:z].to_pylist()) for a, z in cuts]
            yield pa.RecordBatch.from_arrays([pa.array([int(at[a]) for a, _ in cuts], pa.int32()), pa.array(keys, pa.binary()), pa.array(codes, pa.binary())], ["list", "keys", "codes"])

    coded = rows.where(F.size("vec") == dim).mapInArrow(frugal(code), "list int, key bigint, code binary, vec array<double>")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # By range of (list, key): a list with a third of all rows lies in many files, a small one in one.
    kept = F.col("vec").cast("array<float>") if vectors.schema[vector].dataType.simpleString() == "array<float>" else F.col("vec")
    coded.select("list", "key", "code", kept.alias("vec")).repartitionByRange(parts, "list", "key").sortWithinPartitions("list", "key").write.partitionBy("list").parquet(f"{path}/vectors")
    dealt = written(spark.read.parquet(f"{path}/vectors").select("list", "key", "code").repartitionByRange(parts, "list", "key").sortWithinPartitions("list", "key").mapInArrow(frugal(block), "list int, keys binary, codes binary"))
    dealt.write.partitionBy("list").parquet(f"{path}/codes")
    return Vectors(spark, path, model, SHARDS)


def exact(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 100, shards: int = 16) -> DataFrame:
    """``Vectors.search`` by a look at every pair of a query and a vector of its length, in blocks: for a bounded set of queries, and to measure recall."""

    def packed(rows: DataFrame, size: int, names: tuple[str, str]) -> DataFrame:
        def run(batches: Batches) -> Batches:
            for batch in batches:
                lengths = np.asarray(pc.list_value_length(batch.column(1)))
                for dim in np.unique(lengths):
                    some = batch.filter(pa.array(lengths == dim))
                    for first in range(0, len(some), size):
                        part = some.slice(first, size)
                        yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), pa.array([np.asarray(part.column(0)).tobytes()], pa.binary()), pa.array([_unit(part.column(1)).tobytes()], pa.binary())], ["dim", *names])

        return rows.mapInArrow(frugal(run), f"dim int, {names[0]} binary, {names[1]} binary")

    def score(batches: Batches) -> Batches:
        held, best, names = None, [], np.zeros(0, np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            for query, got in zip(names, best, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got[1]), query)), pa.array(got[1]), pa.array(got[2])], ["query", "key", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if held != row["queries"]:
                    yield from rows()
                    held, names = row["queries"], np.frombuffer(row["queries"], np.int64)
                    best = [None] * len(names)
                keys = np.frombuffer(row["keys"], np.int64)
                scores = np.frombuffer(row["units"], np.float64).reshape(len(names), -1) @ np.frombuffer(row["others"], np.float64).reshape(len(keys), -1).T
                best = [_merged(b, 0, keys, line, k) for b, line in zip(best, np.round(scores, 9), strict=True)]
        yield from rows()

    left = packed(_rows(queries, key, vector), PACK, ("queries", "units")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = packed(_rows(vectors, key, vector), BLOCK, ("keys", "others")).withColumn("shard", F.pmod(F.xxhash64("keys"), F.lit(shards)).cast("int"))
    found = left.join(right, ["dim", "shard"]).mapInArrow(frugal(score), "query bigint, key bigint, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
