"""Which texts hold a string anywhere: winnowed fingerprints, an equi-join, and a look at the text.

Strings of one length have one fingerprint size: of the first ``w`` runs of ``k`` characters the least hash.  A text
has the least hash of every ``w`` neighbouring runs, so wherever the string stands in it, its fingerprint
is among them.  Strings of eight characters or fewer are their own runs.  Every candidate is looked at, so hashes need not tell strings apart.

Null and empty strings and texts are held by nothing and hold nothing; rows without a key are not looked at.  A
string counts once however often it is given; equal (string, key) pairs are one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.memory import frugal
from ..plans.shared import written

#: Least length of a string: (characters of a run, runs of a window).  A string of that length or more has a whole window.
TIERS = {40: (20, 21), 17: (12, 6), 9: (8, 2), **{n: (n, 1) for n in range(8, 0, -1)}}
#: Fingerprints of one batch that goes on.
CHUNK = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tier_of(text: Column) -> Column:
    """The tier of a string's length."""
    tier = F.lit(None).cast("int")
    for least in sorted(TIERS):
        tier = F.when(F.length(text) >= least, least).otherwise(tier)
    return tier


def _runs(text: str, k: int) -> np.ndarray:
    """A hash of every run of ``k`` characters."""
    with np.errstate(over="ignore"):
        unit = (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)) * _ODD
        unit ^= unit >> np.uint64(29)
        total, done, power, factor = None, 0, 1, np.uint64(0x2545F4914F6CDD1D)
        block = unit
        while True:  # runs of k from those of powers of two
            if k & power:
                if total is None:
                    total, done = block, power
                else:
                    size = len(unit) - done - power + 1
                    total, done = total[:size] * factor + block[done : done + size], done + power
            if power * 2 > k:
                break
            block = block[: len(block) - power] * factor + block[power:]
            factor, power = factor * factor, power * 2
        total = total ^ (total >> np.uint64(31))
        total *= _ODD
        return total ^ (total >> np.uint64(32))


def prints(text: str, tier: int) -> np.ndarray:
    """The different fingerprints of a text at one tier."""
    k, w = TIERS[tier]
    if len(text) < k + w - 1:
        return np.empty(0, np.uint64)
    hashes = _runs(text, k)
    if w > 1:
        hashes = np.lib.stride_tricks.sliding_window_view(hashes, w).min(axis=1)
    return np.unique(hashes)


def _fingerprints(batches: Iterator[pa.RecordBatch], tiers: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("tier", pa.int32()), ("print", pa.int64())])

    def packed(rows):
        sizes = [len(p) for _, _, p in rows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array([k for k, _, _ in rows], np.int64), sizes)),
                pa.array(np.repeat(np.array([t for _, t, _ in rows], np.int32), sizes)),
                pa.array(np.concatenate([p for _, _, p in rows]).view(np.int64)),
            ],
            schema=schema,
        )

    rows, held = [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for tier in tiers:
                found = prints(text.as_py(), tier)
                rows.append((key, tier, found))
                held += len(found)
            if held >= CHUNK:
                yield packed(rows)
                rows, held = [], 0
    if rows:
        yield packed(rows)


def _needle_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("string", pa.string()), ("tier", pa.int32()), ("print", pa.int64())])
    for batch in batches:
        strings, tiers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        found = np.array([_runs(s[: sum(TIERS[t]) - 1], TIERS[t][0]).min() for s, t in zip(strings, tiers)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tiers, pa.int32()), pa.array(found.view(np.int64))], schema=schema)


def holders(strings: DataFrame, string: str, texts: DataFrame, key: str, text: str) -> DataFrame:
    """(string, key): every text that holds a string, and the strings themselves as they are given.

    What is shuffled is a key and a hash for one in eleven characters of a text (for strings of 40 characters or
    more), unless the strings are so few that Spark sends them to the texts.  Keys are whole numbers.
    """
    given = strings.select(F.col(string).alias("string")).where("string <> ''").distinct().withColumn("tier", tier_of(F.col("string")))
    tiers = tuple(sorted(r[0] for r in given.select("tier").distinct().collect()))  # eleven at most
    needles = given.mapInArrow(_needle_prints, "string string, tier int, print bigint")
    rows = texts.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where("key is not null and text <> ''")
    marks = rows.mapInArrow(frugal(lambda batches: _fingerprints(batches, tiers)), "key bigint, tier int, print bigint")
    candidates = written(marks.join(needles, ["tier", "print"]).select("string", "key"))  # of known size, so that texts travel only if these are many
    return candidates.join(rows, "key").where(F.contains("text", "string")).select("string", "key").distinct()
