"""Text encoders and rerankers: any model that maps a list of texts to vectors or scores, run in batches by the workers.

A model is given as a function that loads it; each task calls it once.  ``first_letters`` is a model
that needs no files and stands in where none is at hand.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.memory import frugal

Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[str, list[str]], np.ndarray]
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def encoded(rows: DataFrame, key: str, text: str, load: Callable[[], Encoder], batch: int = 256, element: str = "float", unit: bool = True) -> DataFrame:
    """Rows (key, vec) with vectors of length 1, or of zeros (as the model gives them without ``unit``), as floats or doubles; a null text counts as empty."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for part in batches:
            for first in range(0, len(part), batch):
                some = part.slice(first, batch)
                vectors = np.asarray(model([t or "" for t in some.column(1).to_pylist()]), np.float64)
                if unit:
                    vectors = vectors / np.maximum(np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), 1e-12)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.ravel(), pa.float64() if element == "double" else pa.float32()))
                yield pa.RecordBatch.from_arrays([some.column(0), lists], ["key", "vec"])

    return rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(frugal(run), f"key {kind}, vec array<{element}>")


def rescored(rows: DataFrame, key: str, text: str, query: str, load: Callable[[], Scorer], batch: int = 64) -> DataFrame:
    """Rows (key, score): how well each text answers the query, by a cross-encoder."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for part in batches:
            for first in range(0, len(part), batch):
                some = part.slice(first, batch)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.asarray(model(query, [t or "" for t in some.column(1).to_pylist()]), np.float64))], ["key", "score"])

    return rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(frugal(run), f"key {kind}, score double")


def first_letters() -> Encoder:
    """How many words begin with each letter."""
    word = re.compile("[a-z]+")

    def model(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(LETTERS)))
        for i, t in enumerate(texts):
            for w in word.findall(t.lower()):
                out[i, ord(w[0]) - 97] += 1
        return out

    return model
