"""Connected components of an edge table, distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import frugal
from .shared import cut, written

#: So many edges are left to one task; more are first contracted by partition and then settled in rounds.
ONE_TASK_EDGES = 1_000_000

#: Alternating stars need O(log² n) rounds; this only guards against an endless loop.
MOST_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component): the smallest node reachable from each node that has an edge.

    Large-star and small-star steps alternate until nothing changes.  A node's
    neighbours are never gathered: their minimum is aggregated and joined back, so a
    hub is an ordinary skewed join.  Each round's edges are checkpointed; only a
    count and a checksum reach the driver.  Edges are contracted by partition before,
    and if ``ONE_TASK_EDGES`` at most are left, one task settles them.  Null ends and
    loops are ignored, repeated edges do no harm.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    pairs = written(pairs.mapInArrow(frugal(_forest), "u bigint, v bigint"))
    if pairs.count() <= ONE_TASK_EDGES:
        whole = pairs.coalesce(1).mapInArrow(frugal(_forest), "u bigint, v bigint")
        return _with_roots(whole)
    seen = _mark(pairs)
    for _ in range(MOST_ROUNDS):
        if seen[0] == 0:
            break
        pairs = cut(_small_star(_large_star(pairs)))
        now = _mark(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return _with_roots(pairs.distinct())


def _with_roots(stars: DataFrame) -> DataFrame:
    """(node, component) from edges that all lead to a component's smallest node."""
    both = F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component"))))
    return stars.select(both).distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each node of a partition to the smallest node it is connected to there."""
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        waiting.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        size += len(batch)
        if size > ONE_TASK_EDGES:
            u, v = stars(np.concatenate([u, *(x for x, _ in waiting)]), np.concatenate([v, *(y for _, y in waiting)]))
            waiting, size = [], 0
    u, v = stars(np.concatenate([u, *(x for x, _ in waiting)]), np.concatenate([v, *(y for _, y in waiting)]))
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest one that the edges (u, v) connect it to."""
    nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = back[: len(u)], back[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        grown = root.copy()
        np.minimum.at(grown, root[a], low)
        np.minimum.at(grown, root[b], low)
        while True:
            jumped = grown[grown]
            if np.array_equal(jumped, grown):
                break
            grown = jumped
        if np.array_equal(grown, root):
            break
        root = grown
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _mark(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
