"""Vectorised scanning of whole text columns.

Everything here works on the raw UTF-8 bytes of an Arrow string column, many
documents at once: word spans, line spans and 64-bit hashes come out as numpy
arrays, so the per-word cost in Python is a few dozen nanoseconds.

A word is a maximal run of bytes outside ``0x20, 0x09-0x0D``.  Those bytes never
occur inside a multi-byte UTF-8 sequence, so byte runs and code point runs agree.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document forms a chunk of its own.
CHUNK_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWER_BITS = 16
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(which: int) -> np.ndarray:
    if which not in _POWERS:
        out = np.full(1 << _POWER_BITS, np.uint64(_BASES[which]))
        out[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[which] = np.multiply.accumulate(out)
    return _POWERS[which]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of ``buf``; spans do not overlap, ascend and may be empty.

    The hash is a polynomial in the byte's place within its span, so equal bytes
    give equal hashes wherever they stand.
    """
    lens = (ends - starts).astype(np.int64)
    out = np.zeros(len(starts), np.uint64)
    total = int(lens.sum())
    if total:
        full = lens > 0
        first = np.zeros(len(lens), np.int64)
        np.cumsum(lens[:-1], out=first[1:])
        if total == len(buf) and len(buf):
            data = buf
        else:
            keep = np.zeros(len(buf) + 1, np.int8)
            keep[starts[full]] = 1
            keep[ends[full]] -= 1
            data = buf[np.cumsum(keep[:-1], dtype=np.int8).view(bool)]
        place = np.arange(total, dtype=np.int64) - np.repeat(first, lens)
        values = data.astype(np.uint64)
        values += np.uint64(1)
        if int(lens.max()) > 1 << _POWER_BITS:
            values += (place >> _POWER_BITS).astype(np.uint64) << np.uint64(9)
            place &= (1 << _POWER_BITS) - 1
        values *= _powers(which)[place]
        out[full] = np.add.reduceat(values, first[full])
    return mix(out + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def run_hashes(items: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` consecutive hashes; shorter by ``width - 1``."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for k in range(width):
        acc *= np.uint64(0x9FB21C651E98DF25)
        acc += items[k : k + n]
    return mix(acc)


@dataclass
class Chunk:
    """Some consecutive rows of a batch: ``buf[offsets[i]:offsets[i+1]]`` is row ``first + i``."""

    first: int
    buf: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def lower(self) -> np.ndarray:
        return LOWER[self.buf]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all words, in order; none crosses a row."""
        ink = ~IS_SPACE[self.buf]
        before = np.zeros(len(ink), bool)
        before[1:] = ink[:-1]
        edge = self.offsets[:-1][self.lengths > 0]
        before[edge] = False
        starts = np.flatnonzero(ink & ~before)
        after = np.zeros(len(ink), bool)
        after[:-1] = ink[1:]
        after[edge[1:] - 1 if len(edge) and edge[0] == 0 else edge - 1] = False
        return starts, np.flatnonzero(ink & ~after) + 1

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the lines of every row (cut at line feeds, which belong to none)."""
        feeds = np.flatnonzero(self.buf == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], feeds + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.offsets[1:], feeds]), kind="stable")
        return starts, ends

    def row_of(self, places: np.ndarray) -> np.ndarray:
        """The row (within the chunk) that holds each byte place; places ascend."""
        return np.searchsorted(self.offsets, places, side="right") - 1

    def per_row(self, places: np.ndarray) -> np.ndarray:
        """How many of the ascending places each row holds."""
        return np.diff(np.searchsorted(places, self.offsets))

    def raw(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array, limit: int | None = None) -> Iterator[Chunk]:
    """Cut a string column into chunks of about ``limit`` bytes."""
    limit = limit or CHUNK_BYTES
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield Chunk(at, everything[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def row_runs(rows: np.ndarray, width: int) -> np.ndarray:
    """Mask of the windows of ``width`` items that stay within one row; rows ascend."""
    n = len(rows) - width + 1
    return rows[width - 1 :] == rows[:n] if n > 0 else np.zeros(0, bool)
