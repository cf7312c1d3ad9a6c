"""Arrays packed into blocks that an exchange deals to numbered partitions."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; uint64 arrays must ascend and are stored as the byte planes of their gaps."""
    parts = [struct.pack("<i", len(arrays))]
    for x in arrays:
        sorted_ = x.dtype == np.uint64
        raw = np.ascontiguousarray(np.diff(x, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T).tobytes() if sorted_ else np.ascontiguousarray(x).tobytes()
        parts.append(struct.pack("<2sq", x.dtype.str[1:].encode(), len(x)) + raw)
    return b"".join(parts)


def unpack(block: bytes) -> list[np.ndarray]:
    n, at, out = struct.unpack_from("<i", block)[0], 4, []
    for _ in range(n):
        kind, size = struct.unpack_from("<2sq", block, at)
        at += struct.calcsize("<2sq")
        dtype = np.dtype(kind.decode())
        raw = np.frombuffer(block, np.uint8, size * dtype.itemsize, at)
        at += size * dtype.itemsize
        out.append(np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64) if dtype == np.uint64 else raw.view(dtype))
    return out


def partition_keys(parts: int) -> list[int]:
    """For each partition number an integer that Spark's hash partitioning (Murmur3, seed 42) deals to it."""
    found = np.full(parts, -1, np.int64)
    upto = 0
    while (found < 0).any():
        k = np.arange(upto, upto + 16 * parts + 64, dtype=np.uint32)
        upto += len(k)
        h = _rotate(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593) ^ np.uint32(42)
        h = (_rotate(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        part = (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % parts
        where, first = np.unique(part, return_index=True)
        fresh = found[where] < 0
        found[where[fresh]] = k[first[fresh]]
    return found.tolist()


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def bucket(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The key range (of ``parts``) of each hash; ascends with it."""
    return ((hashes >> _U(32)) * _U(parts)) >> _U(32)


def blocks_batch(keys: list[int], parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """Rows (to, block) for the numbered partitions."""
    return pa.RecordBatch.from_arrays([pa.array([keys[b] for b, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["to", "block"])


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Unpacked blocks, key by key; the rows come sorted by key."""
    key, got = None, []
    for batch in batches:
        for k, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if k != key and got:
                yield key, got
                got = []
            key = k
            got.append(unpack(block.as_py()))
    if got:
        yield key, got
