"""Numpy arrays that tasks store and workers memory-map, in whatever file system the shared folder is.

In a folder that is a path on every machine (``file:``) a task writes an array as a file,
and workers map it there.  In any other file system that Spark reaches (HDFS, an object
store), tasks hand their arrays on as rows; Spark writes these as Parquet, and
``SparkContext.addFile`` brings the table to the work folder of every executor that runs a
task, also of one that replaces a lost one.  A worker unpacks an array there once and maps it;
the folder goes with its executor.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import kept
from .shared import new_path

ROWS = "name string, part int, seq int, block binary"
BLOCK = 16 << 20


def array_row(name: str, part: int, array: np.ndarray, seq: int = 0) -> pa.RecordBatch:
    """A small array as one row of ``ROWS``, wherever the store is; ``array_of`` reads it."""
    return _row(name, part, seq, np.ascontiguousarray(array, np.int64).tobytes())


def array_of(block: bytes) -> np.ndarray:
    return np.frombuffer(block, np.int64)


def _row(name: str, part: int, seq: int, block: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([block], pa.binary())], ["name", "part", "seq", "block"])


class ArrayStore:
    """Arrays by name and part number.  Tasks ``put``, the driver publishes what a job has put, workers ``get``."""

    def __init__(self, spark: SparkSession, kind: str):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new_path(spark, kind))
        store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # a path without a scheme is the default one's
        folder = folder.makeQualified(store.getUri(), store.getWorkingDirectory()).toString()
        self.folder = "file:/" + folder.removeprefix("file:").lstrip("/") if folder.startswith("file:") else folder
        self.tables: dict[str, str] = {}

    @property
    def near(self) -> bool:
        return self.folder.startswith("file:")

    def put(self, name: str, part: int, array: np.ndarray) -> Iterator[pa.RecordBatch]:
        """In a task: store an array; what is yielded belongs to the task's rows (``ROWS``)."""
        if self.near:
            _save(self._file(name, part), array)
            return
        body = io.BytesIO()
        np.save(body, np.ascontiguousarray(array))
        whole = body.getbuffer()
        for seq, at in enumerate(range(0, len(whole), BLOCK)):
            yield _row(name, part, seq, bytes(whole[at : at + BLOCK]))

    def publish(self, rows: DataFrame, *names: str) -> None:
        """On the driver, after the job whose (written) rows these are."""
        if self.near:
            return
        spark, table = rows.sparkSession, f"arrays-{uuid.uuid4().hex}"
        path = f"{self.folder}/{table}"
        rows.where(F.col("name").isin(*names)).write.partitionBy("name", "part").parquet(path)
        spark.sparkContext.addFile(path, recursive=True)
        self.tables |= dict.fromkeys(names, table)

    def get(self, name: str, part: int) -> np.ndarray:
        """In a worker: an array that was published, memory-mapped."""
        if self.near:
            return _mapped(self._file(name, part))
        from pyspark import SparkFiles

        return _mapped(_unpacked(f"{SparkFiles.getRootDirectory()}/{self.tables[name]}", name, part))

    def _file(self, name: str, part: int) -> str:
        return f"{self.folder.removeprefix('file:')}/{name}-{part:05d}.npy"


def _save(path: str, array: np.ndarray) -> None:
    """A repeated or speculative task replaces the file in one step."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    trial = f"{path}.{uuid.uuid4().hex}.part"
    with open(trial, "wb") as out:
        np.save(out, np.ascontiguousarray(array))
    os.replace(trial, path)


def _unpacked(table: str, name: str, part: int) -> str:
    """The array's file beside its table, made from the table's blocks if it is not there."""
    import pyarrow.parquet as pq

    path = f"{table}-{name}-{part:05d}.npy"
    if not os.path.exists(path):
        folder = f"{table}/name={name}/part={part}"
        rows = pa.concat_tables(pq.ParquetFile(f"{folder}/{f}").read(["seq", "block"]) for f in os.listdir(folder) if f.endswith(".parquet")).sort_by("seq")
        trial = f"{path}.{uuid.uuid4().hex}.part"
        with open(trial, "wb") as out:
            for block in rows["block"]:
                out.write(block.as_buffer())
        os.replace(trial, path)
    return path


@lru_cache(maxsize=4096)
def _mapped(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r")


kept("maps", _mapped.cache_clear)
