"""Tables that tasks look up: sorted 64-bit keys with columns, cut by key range, memory-mapped from the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from ..plans.memory import frugal
from ..plans.shared import written
from ..plans.sharedfiles import ROWS, ArrayStore, array_row
from .blocks import blocks_batch, bucket, by_key, pack, partition_keys
from .textscan import Chunk, chunks

FLUSH = 1_000_000
_U = np.uint64


class Ranges:
    """Arrays by name and key range, and which ranges have them."""

    def __init__(self, spark: SparkSession, kind: str):
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.keys = partition_keys(self.parts)
        self.store = ArrayStore(spark, kind)
        self.held: dict[str, set[int]] = {}

    def edges(self, keys: np.ndarray) -> np.ndarray:
        """Where the ascending keys of each range begin, and the end."""
        return np.searchsorted(bucket(keys, self.parts), np.arange(self.parts + 1).astype(_U))

    def places(self, name: str, keys: np.ndarray, edges: np.ndarray | None = None) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """(range, its keys, their places in the range's array, which are there) for ascending keys."""
        edges = self.edges(keys) if edges is None else edges
        for p in np.flatnonzero(np.diff(edges)).tolist():
            if p in self.held.get(name, ()):
                here, known = slice(edges[p], edges[p + 1]), self.store.get(name, p)
                place = np.minimum(np.searchsorted(known, keys[here]), len(known) - 1)
                yield p, here, place, known[place] == keys[here]

    def values(self, name: str, column: str, keys: np.ndarray, absent: int) -> np.ndarray:
        """The column's value of each key, in any order."""
        order = np.argsort(keys)
        out = np.full(len(keys), absent, np.int64)
        for p, here, place, hit in self.places(name, keys[order]):
            out[order[here][hit]] = self.store.get(column, p)[place[hit]]
        return out

    def looked_up(self, name: str, column: str, key: Column, absent: int) -> Column:
        """The column's value of each row's key, which alone goes to the worker; the row stays in the JVM."""

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for keys in batches:
                yield pa.array(self.values(name, column, np.asarray(keys).view(_U), absent))

        return F.arrow_udf(frugal(run), "bigint", ArrowUDFType.SCALAR_ITER).asNondeterministic()(key)  # so that it runs once for a row

    def blocks(self, columns: list[np.ndarray]) -> pa.RecordBatch:
        """Columns by range; the first are the keys, which ascend."""
        edges = self.edges(columns[0])
        return blocks_batch(self.keys, [(p, pack(*(c[edges[p] : edges[p + 1]] for c in columns))) for p in range(self.parts) if edges[p] < edges[p + 1]])

    def keep(self, blocks: DataFrame, run: Callable[[list[list[np.ndarray]]], list[np.ndarray]], *names: str) -> None:
        """Let ``run`` make the arrays of each range from its blocks."""
        number_of = {k: p for p, k in enumerate(self.keys)}

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, got in by_key(batches):
                arrays = run(got)
                if len(arrays[0]):
                    for name, array in zip(names, arrays, strict=True):
                        yield from self.store.put(name, number_of[key], array)
                    yield array_row("facts", number_of[key], np.zeros(0))

        rows = written(blocks.repartition(self.parts, "to").sortWithinPartitions("to").mapInArrow(frugal(store), ROWS))
        self.store.publish(rows, *names)
        held = {r.part for r in rows.where("name = 'facts'").select("part").collect()}
        self.held |= dict.fromkeys(names, held)

    def table(self, rows: DataFrame, *names: str) -> None:
        """Keep the columns (bigint, distinct keys first) of a table under these names."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = np.asarray(batch.column(0)).view(_U)
                order = np.argsort(keys)
                if len(order):
                    yield self.blocks([keys[order], *(np.asarray(batch.column(i))[order] for i in range(1, batch.num_columns))])

        def arrays(got: list) -> list[np.ndarray]:
            columns = [np.concatenate([x[i] for x in got]) for i in range(len(got[0]))]
            order = np.argsort(columns[0])
            return [c[order] for c in columns]

        self.keep(rows.mapInArrow(frugal(run), "to int, block binary"), arrays, *names)


def flushed(texts: DataFrame, scan: Callable[[Chunk, pa.RecordBatch], tuple], flush: Callable[[list], pa.RecordBatch], limit: int = FLUSH) -> DataFrame:
    """Blocks (to, block) that ``flush`` makes of what ``scan`` finds in some chunks of the last column; the first array tells how much that is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for chunk in chunks(batch.column(batch.num_columns - 1)):
                held.append(scan(chunk, batch))
                size += len(held[-1][0])
                if size >= limit:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return texts.mapInArrow(frugal(run), "to int, block binary")
