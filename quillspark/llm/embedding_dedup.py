"""Operator 3: embedding near-dedup by p-stable hashing for Euclidean distance.

Vectors are scaled to length 1, so that a cosine of c is a distance of
sqrt(2 - 2c).  Each of several tables projects a vector on ``width`` random normal
directions, shifts, divides by ``BUCKET`` and rounds down; vectors with equal codes
share a bucket, and pairs within a bucket are checked by exact cosine in double
precision.  A pair that shares buckets of several tables counts in the first only.

The width follows the number n of distinct vectors, so that a vector meets ``COMPANY``
unrelated (orthogonal) others in a table at most, and the number of tables follows the
width, so that a pair right at the threshold is missed with a probability of ``MISS``
at most, and nearer pairs far more rarely (``plan``).  Tables grow as n to the power 0.27,
unrelated pairs that are compared as n to the power 1.27.

Only keys are dealt to buckets.  Buckets of one vector go, and of buckets with the same
members in several tables the first is left; vectors travel to these only.  Equal
vectors form one class and are compared once.  A bucket larger than
``BLOCK`` is cut into blocks, and each pair of blocks is a unit of work of its own,
so no task holds a whole bucket.  What leaves a unit is a sum of links per class
and a spanning set of its links, never its pairs.

Defined results: null vectors, vectors of zeros and vectors with null, NaN or
infinite parts link with nothing and are their own component; vectors of different
length never link; repeated rows are vectors of their own; rows with a null id are
compared like others, but a component is named by its smallest id that is not null;
other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import connected_components, stars
from ..plans.memory import frugal
from ..plans.shared import written
from .textscan import mix

THRESHOLD = 0.9
BUCKET, COMPANY, MISS = 2.0, 0.25, 0.05
LEAST_WIDTH = 8
BLOCK = 1024
#: Buckets of so many vectors at most are checked together, pair by pair, so many pairs at once.
SMALL, PAIRS = 48, 1 << 16
#: Tables whose codes are computed at once when pairs are told that met before.
STEP = 8
SEED = 20240611


@lru_cache(maxsize=8)
def _directions(dim: int, tables: int, width: int, bucket: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, tables * width)), rng.uniform(0, bucket, tables * width)


def shared_cell(cosine: float, bucket: float = BUCKET) -> float:
    """Probability that two unit vectors fall into one cell of one projection."""
    r = bucket / math.sqrt(max(2 - 2 * cosine, 1e-12))
    outside = math.erfc(r / math.sqrt(2))
    return 1 - outside - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(vectors: int, threshold: float = THRESHOLD, bucket: float = BUCKET) -> tuple[int, int]:
    """(tables, width) for so many distinct vectors."""
    width = max(LEAST_WIDTH, math.ceil(math.log(max(vectors, 1) / COMPANY) / -math.log(shared_cell(0.0, bucket))))
    met = shared_cell(threshold, bucket) ** width
    return max(1, math.ceil(math.log(MISS) / math.log1p(-met))) if met < 1 else 1, width


def bucket_codes(unit: np.ndarray, tables: int, width: int, bucket: float = BUCKET, first: int = 0, last: int | None = None) -> np.ndarray:
    """int64 code of each unit vector (rows) in the tables (columns) from ``first`` to before ``last``."""
    lines, shifts = _directions(unit.shape[1], tables, width, bucket)
    last = tables if last is None else last
    here = slice(first * width, last * width)
    cells = np.floor((unit @ lines[:, here] + shifts[here]) / bucket).astype(np.int64).view(np.uint64).reshape(len(unit), last - first, width)
    code = np.full((len(unit), last - first), np.uint64(unit.shape[1]))
    for k in range(width):
        code = mix(code * np.uint64(0x9FB21C651E98DF25) + cells[:, :, k])
    return code.view(np.int64)


def _unit(lists: pa.Array) -> np.ndarray:
    """Rows of equal length, scaled to length 1 in double precision."""
    flat = np.asarray(lists.flatten()).astype(np.float64)
    x = flat.reshape(len(lists), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # very large and very small parts must not overflow when squared
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """One row (vector, class, first, copies) for each distinct usable vector."""
    usable = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)
    finite = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    some = F.exists(vector_col, lambda v: v != 0)
    picked = vectors.where(usable & finite & some).select(F.col(vector_col).alias("vector"), F.col(id_col).cast("bigint").alias("id"))
    grouped = picked.groupBy("vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    return grouped.withColumn("class", F.xxhash64("vector"))


def _codes(classes: DataFrame, shape: tuple[int, int, float]) -> DataFrame:
    """Rows (class, codes)."""
    tables = shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            lengths = np.diff(np.asarray(lists.offsets))
            codes = np.zeros((len(batch), tables), np.int64)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                codes[at] = bucket_codes(_unit(lists.take(pa.array(at))), *shape)
            kind = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * tables, pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(1), kind], ["class", "codes"])

    return classes.select("vector", "class").mapInArrow(frugal(run), "class bigint, codes array<bigint>")


def _units(classes: DataFrame, coded: DataFrame) -> DataFrame:
    """Rows (bucket, table, left, right, side, class, copies, vector): each vector in each unit of work that needs it."""
    keys = coded.select("class", F.posexplode("codes").alias("table", "bucket"))
    sizes = keys.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("class")).alias("members")).where("size > 1")
    # Of buckets with the same members that of the first table is left: no pair of theirs met before it.
    once = sizes.groupBy("members", "size").agg(F.min(F.struct("table", "bucket")).alias("at"))
    once = once.select("at.table", "at.bucket", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int").alias("blocks"))
    own = F.pmod(F.hash("class", "table"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = keys.join(once, ["table", "bucket"]).withColumn("own", own).withColumn("other", other)
    dealt = dealt.select("class", "table", "bucket", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), (F.col("own") > F.col("other")).alias("side"))
    return dealt.join(classes.select("class", "copies", "vector"), "class").select("table", "bucket", "left", "right", "side", "class", "copies", "vector")


def _spanning(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set of edges with the same components as the bipartite graph ``linked`` over the classes."""
    a, b = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        b2 = np.minimum(b, np.where(linked, a[:, None], top).min(axis=0))
        a2 = np.minimum(a, np.where(linked, b2[None, :], top).min(axis=1))
        if np.array_equal(a2, a) and np.array_equal(b2, b):
            break
        a, b = a2, b2
    ends, roots = np.concatenate([left, right]), np.concatenate([a, b])
    moved = ends != roots
    return ends[moved], roots[moved]


def _check(table: int, side: np.ndarray, classes: np.ndarray, copies: np.ndarray, lists: pa.Array, threshold: float, shape: tuple, same: bool) -> tuple[np.ndarray, ...]:
    """(class, links) sums and (class, root) edges of one unit of work."""
    unit = _unit(lists)
    tables, width, bucket = shape
    a = np.flatnonzero(~side)
    b = a if same else np.flatnonzero(side)
    sums = np.zeros(len(unit), np.int64)
    ends, roots = [], []
    for i in range(0, len(a), BLOCK):
        for j in range(0, len(b), BLOCK):
            x, y = a[i : i + BLOCK], b[j : j + BLOCK]
            if same and j < i:
                continue
            linked = unit[x] @ unit[y].T >= threshold
            if same and i == j:
                linked &= np.tri(len(x), len(y), -1, dtype=bool).T
            for t in range(0, table, STEP):  # pairs that met in a table before are counted there
                p, q = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
                if not len(p):
                    break
                upto = min(t + STEP, table)
                f, g = (bucket_codes(unit[at], tables, width, bucket, t, upto) for at in (x[p], y[q]))
                fresh = linked[np.ix_(p, q)]
                for k in range(upto - t):
                    fresh &= f[:, k][:, None] != g[:, k][None, :]
                linked[np.ix_(p, q)] = fresh
            if linked.any():
                sums[x] += (linked * copies[y][None, :]).sum(axis=1)
                sums[y] += (linked * copies[x][:, None]).sum(axis=0)
                e, r = _spanning(linked, classes[x], classes[y])
                ends.append(e)
                roots.append(r)
    none = np.zeros(0, np.int64)
    hit = np.flatnonzero(sums)
    return classes[hit], sums[hit], np.concatenate(ends) if ends else none, np.concatenate(roots) if roots else none


def _met_before(unit: np.ndarray, a: np.ndarray, b: np.ndarray, table: np.ndarray, shape: tuple) -> np.ndarray:
    """Mask of the pairs (a, b) of rows that share a bucket of a table before their own."""
    met = np.zeros(len(a), bool)
    for t in range(0, int(table.max(initial=0)), STEP):
        open_ = np.flatnonzero(~met & (table > t))
        if not len(open_):
            break
        rows, back = np.unique(np.concatenate([a[open_], b[open_]]), return_inverse=True)
        codes = bucket_codes(unit[rows], *shape, t, min(t + STEP, shape[0]))
        same = codes[back[: len(open_)]] == codes[back[len(open_) :]]
        same &= np.arange(t, t + codes.shape[1])[None, :] < table[open_][:, None]
        met[open_] = same.any(axis=1)
    return met


def _check_small(tables: np.ndarray, starts: np.ndarray, sizes: np.ndarray, classes: np.ndarray, copies: np.ndarray, lists: pa.Array, threshold: float, shape: tuple) -> Iterator[tuple[np.ndarray, ...]]:
    """``_check`` of many whole buckets, which lie one behind the other; ``starts``: their first rows."""
    every = np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
    lengths = np.diff(np.asarray(lists.offsets))[every]
    for dim in np.unique(lengths):
        rows = every[lengths == dim]
        unit = _unit(lists.take(pa.array(rows)))
        bucket = np.searchsorted(starts, rows, side="right") - 1
        after = starts[bucket] + sizes[bucket] - 1 - rows  # members behind each row
        upto = np.cumsum(after)
        for first in range(0, int(upto[-1]), PAIRS):
            at = np.arange(first, min(first + PAIRS, int(upto[-1])))
            a = np.searchsorted(upto, at, side="right")
            b = a + 1 + at - (upto[a] - after[a])
            near = np.flatnonzero(np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold)
            a, b = a[near], b[near]
            fresh = ~_met_before(unit, a, b, tables[bucket[a]], shape)
            x, y = rows[a[fresh]], rows[b[fresh]]
            if len(x):
                yield np.concatenate([classes[x], classes[y]]), np.concatenate([copies[y], copies[x]]), *stars(classes[x], classes[y])


def _linked(units: DataFrame, threshold: float, shape: tuple) -> DataFrame:
    """Rows (class, links, root): sums have no root, edges have no links."""
    order = ["table", "bucket", "left", "right"]

    def emit(found: list[tuple]) -> pa.RecordBatch:
        c, n, e, r = (np.concatenate([f[i] for f in found]) for i in range(4))
        c, back = np.unique(c, return_inverse=True)
        n = np.bincount(back, n, len(c)).astype(np.int64)
        links = pa.array(np.concatenate([n, np.zeros(len(e), np.int64)]))
        roots = pa.array(np.concatenate([np.zeros(len(c), np.int64), r]), mask=np.concatenate([np.ones(len(c), bool), np.zeros(len(r), bool)]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([c, e])), links, roots], ["class", "links", "root"])

    def solve(rows: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        keys = np.stack([np.asarray(rows[k]) for k in order], 1)
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        sizes = np.diff(np.append(starts, len(keys)))
        whole = keys[starts, 2] == keys[starts, 3]
        side, classes, copies = (np.asarray(rows[k]) for k in ("side", "class", "copies"))
        lists = rows["vector"].combine_chunks()
        small = (sizes > 1) & (sizes <= SMALL) & whole
        if small.any():
            yield from _check_small(keys[starts[small], 0].astype(np.int64), starts[small], sizes[small], classes, copies, lists, threshold, shape)
        for i in np.flatnonzero((sizes > 1) & ~small):
            a, z = starts[i], starts[i] + sizes[i]
            yield _check(int(keys[a, 0]), side[a:z], classes[a:z], copies[a:z], lists.slice(a, z - a), threshold, shape, whole[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        found, waiting = [], 0

        def groups() -> Iterator[pa.Table]:
            """The rows, cut between units of work."""
            nonlocal held
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                rows = rows if held is None else pa.concat_tables([held, rows])
                last = [rows[k][len(rows) - 1].as_py() for k in order]
                same = np.ones(len(rows), bool)
                for k, v in zip(order, last, strict=True):
                    same &= np.asarray(rows[k]) == v
                start = len(rows) - int(same.sum())
                if start:
                    yield rows.slice(0, start)
                held = rows.slice(start)
            if held is not None:
                yield held

        for rows in groups():
            for part in solve(rows):
                found.append(part)
                waiting += len(part[0]) + len(part[2])
                if waiting > 200_000:
                    yield emit(found)
                    found, waiting = [], 0
        if waiting:
            yield emit(found)

    dealt = units.repartition(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(frugal(run), "class bigint, links bigint, root bigint")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", shape: tuple[int, int, float] | None = None) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of ``vectors``; ``shape``: (tables, width, bucket) instead of ``plan``'s."""
    classes = written(_classes(vectors, id_col, vector_col))
    shape = shape or (*plan(classes.count(), threshold), BUCKET)
    coded = written(_codes(classes, shape))
    found = written(_linked(_units(classes, coded), threshold, shape))
    links = found.where("root is null").groupBy("class").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("root is not null").select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = classes.join(parts, classes["class"] == parts["node"], "left").withColumn("component", F.coalesce("component", "class")).drop("node")
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    facts = named.join(names, "component").join(links, "class", "left").select("vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("_v"))
    joined = rows.join(facts, F.col("_v") == F.col("vector"), "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: DuckDB SQL for ``near_vectors``, with all pairs.
ORACLE = """
with recursive vectors as (
  select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
units as (select vec_id, v, sqrt(list_dot_product(v, v)) as norm from vectors),
links as (select a.vec_id as a, b.vec_id as b from units a join units b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9::double),
reached(node, other) as (select vec_id, vec_id from embeddings union select r.node, l.b from reached r join links l on l.a = r.other),
named as (select node, min(other) as component_id from reached group by node)
select e.vec_id, (select count(*) from links where a = e.vec_id) as n_links, n.component_id, e.vec_id = n.component_id as kept from embeddings e join named n on n.node = e.vec_id
"""
