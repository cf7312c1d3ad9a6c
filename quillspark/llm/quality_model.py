"""Operator 2: quality classifier, histogram gradient-boosted trees over document statistics.

The statistics of a text (lengths, shares of kinds of characters, repetition,
entropy) are computed in numpy for many texts at once.  Trees are grown on the
driver from a bounded sample of labelled rows (``MOST_ROWS`` of them, the smallest
hashes of their ids; with fewer labels all are used), on histograms of binned
statistics.  A tree is a full binary tree of depth ``DEPTH`` laid out in arrays:
node k has the children 2k+1 and 2k+2, so a batch of rows walks down all trees by
index arithmetic.

Defined results: a null or empty text has all statistics 0 and gets the score that
belongs to them; a document labelled several times counts once, with label 1 if at
least half of its labels say so, labels other than 0 and 1 not counting; without
labels of both kinds every score is the share of label 1 (0.5 without labels);
repeated rows score alike; a null id is not held out; other columns are not read;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.memory import frugal
from .quality_rules import base_counts
from .textscan import IS_SPACE, Chunk, chunks, mix, row_runs, run_hashes, span_hashes

MOST_ROWS = 20_000
FOLDS, HELD = 3, 1
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT, RIDGE = 150, 4, 64, 0.1, 5.0, 1.0
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"

_CODE = np.arange(256)
_KINDS = {
    "upper": (_CODE >= 65) & (_CODE <= 90),
    "lower": (_CODE >= 97) & (_CODE <= 122),
    "digit": (_CODE >= 48) & (_CODE <= 57),
    "symbol": np.isin(_CODE, [ord(c) for c in "#*$%&|<>"]),
    "stop": np.isin(_CODE, [ord(c) for c in ".?"]),
    "shout": _CODE == ord("!"),
    "comma": np.isin(_CODE, [ord(c) for c in ",;:"]),
    "bracket": np.isin(_CODE, [ord(c) for c in "()[]{}\"'/\\@_-=+~^`"]),
    "marked": _CODE >= 128,
    "space": IS_SPACE,
    "feed": _CODE == 10,
}
NAMES = (
    "log_words", "log_bytes", "word_bytes", "word_bytes_sd", *(f"{k}_share" for k in _KINDS), "words_per_line", "dup_line_share", "distinct_words", "top_word",
    "repeat_words", "repeat_pairs", "byte_entropy", "bare_words", "closed_words", "capital_words", "shouted_words", "short_words", "words_per_stop",
)


def statistics(chunk: Chunk) -> np.ndarray:
    """One row of ``NAMES`` for each text."""
    n, size = len(chunk), chunk.lengths
    starts, ends = chunk.words()
    rows = chunk.row_of(starts) if len(starts) else np.zeros(0, np.int64)
    hashes = span_hashes(chunk.lower(), starts, ends)
    base = base_counts(chunk, starts, ends, hashes)
    words = base["n_words"]
    per_word, per_byte = np.maximum(words, 1), np.maximum(size, 1)
    lens = (ends - starts).astype(np.float64)
    mean = np.bincount(rows, lens, n) / per_word
    spread = np.sqrt(np.maximum(np.bincount(rows, lens * lens, n) / per_word - mean * mean, 0))
    byte_rows = np.repeat(np.arange(n), size)
    tally = np.bincount(byte_rows * 256 + chunk.buf, minlength=n * 256).reshape(n, 256) if n else np.zeros((0, 256))
    share = tally / per_byte[:, None]
    entropy = -(share * np.log2(np.maximum(share, 1e-12))).sum(axis=1)
    kinds = [tally[:, mask].sum(axis=1) / per_byte for mask in _KINDS.values()]
    salted = mix(hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at, times = np.unique(salted, return_index=True, return_counts=True)
    distinct = np.bincount(rows[at], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, rows[at], times)
    inside = np.flatnonzero(row_runs(rows, 2))
    pairs = run_hashes(salted, 2)[inside] if len(inside) else np.zeros(0, np.uint64)
    _, pair_at = np.unique(pairs, return_index=True)
    n_pairs = np.bincount(rows[inside], minlength=n)
    distinct_pairs = np.bincount(rows[inside][pair_at], minlength=n)
    first, last = (chunk.buf[starts], chunk.buf[ends - 1]) if len(starts) else (np.zeros(0, np.uint8),) * 2
    letter = _KINDS["upper"] | _KINDS["lower"] | _KINDS["marked"]
    letters = np.append(0, np.cumsum(letter[chunk.buf]))
    small = np.append(0, np.cumsum((_KINDS["lower"] | _KINDS["marked"])[chunk.buf]))
    ink, low = letters[ends] - letters[starts], small[ends] - small[starts]
    closing = _KINDS["stop"] | _KINDS["comma"] | _KINDS["shout"]
    flags = [ink == 0, closing[last], _KINDS["upper"][first], (ink > 1) & (low == 0), lens <= 3]
    lines = tally[:, 10] + 1
    stops = tally[:, [ord(c) for c in ".?!"]].sum(axis=1)
    columns = [
        np.log1p(words), np.log1p(size), mean, spread, *kinds, words / lines, base["n_dup_lines"] / lines, distinct / per_word, top / per_word, base["n_repeat_words"] / per_word,
        1 - distinct_pairs / np.maximum(n_pairs, 1), entropy, *(np.bincount(rows, f, n) / per_word for f in flags), words / (stops + 1),
    ]
    out = np.stack(columns, axis=1).astype(np.float64)
    out[size == 0] = 0
    return out


@dataclass
class Trees:
    """All trees in arrays: an inner node's feature and threshold, a leaf's value (log-odds)."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Walk all rows down every tree; a row goes right where its statistic exceeds the threshold."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (len(value) - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boost trees for the logistic loss, level by level, on histograms of gradients and curvatures."""
    share = float(y.mean()) if len(y) else 0.5
    inner, leaves = 2**depth - 1, 2**depth
    if share in (0.0, 1.0) or not len(y):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    n, m = x.shape
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0, method="lower").T
    binned = np.stack([np.searchsorted(np.unique(edges[j]), x[:, j], side="left") for j in range(m)], axis=1)
    cuts = [np.unique(edges[j]) for j in range(m)]
    start = float(np.log(share / (1 - share)))
    at = np.full(n, start)
    features, thresholds, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    offsets = np.arange(m) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-at))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            slot = ((node - (width - 1)) * (m * bins))[:, None] + offsets[None, :] + binned
            flat = slot.ravel()
            sum_g = np.bincount(flat, np.repeat(g, m), width * m * bins).reshape(width, m, bins).cumsum(axis=2)
            sum_h = np.bincount(flat, np.repeat(h, m), width * m * bins).reshape(width, m, bins).cumsum(axis=2)
            all_g, all_h = sum_g[:, :, -1:], sum_h[:, :, -1:]
            rest_g, rest_h = all_g - sum_g, all_h - sum_h
            gain = sum_g**2 / (sum_h + RIDGE) + rest_g**2 / (rest_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(sum_h < LEAST_WEIGHT) | (rest_h < LEAST_WEIGHT)] = 0
            flat_gain = gain.reshape(width, -1)
            best = flat_gain.argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if flat_gain[k, best[k]] > 1e-9 and b < len(cuts[j]):
                    features[t, width - 1 + k], thresholds[t, width - 1 + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > thresholds[t, node])
        leaf = node - inner
        values[t] = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        at += values[t][leaf]
    return Trees(start, features, thresholds, values)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def _statistics_rows(texts: DataFrame) -> DataFrame:
    """Rows (doc_id, label, x) from rows (doc_id, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                x = statistics(chunk)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(chunk) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), batch.column(1).slice(chunk.first, len(chunk)), lists], ["doc_id", "label", "x"])

    return texts.mapInArrow(frugal(run), "doc_id bigint, label int, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Trees:
    """Trees from the labelled documents that are not held out; the sample is at most ``most_rows`` labels."""
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    each = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    sample = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    once = _statistics_rows(picked).groupBy("doc_id", "label").agg(F.min("x").alias("x"))
    rows = once.orderBy("doc_id").collect()
    return grow(np.array([r.x for r in rows], np.float64).reshape(len(rows), len(NAMES)), np.array([r.label for r in rows], np.float64))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """Rows (``SCHEMA``) of every text.  One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                p = trees.score(statistics(chunk))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), batch.column(1).slice(chunk.first, len(chunk)), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(frugal(run), SCHEMA)


def learn_and_score(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    return score(docs, learn(docs, labels, most_rows))
