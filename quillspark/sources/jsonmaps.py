"""Files that hold one JSON object, read by as many tasks as they have blocks.

What a block of bytes means depends on what stands before it: whether it begins inside a string, and how deep.  A
first pass finds for every block whether its quotes are odd in number and how much deeper it ends if it begins outside or inside of a
string; the driver puts these few numbers in a row, which gives each block its start; a second pass cuts the
entries.  An entry belongs to the block that has the comma or brace before it, and is read to its end in
whatever block that lies.  No task holds more than a block and an entry.

A key that occurs twice gives two rows.  Files without entries give none; a file that is no object is refused.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.memory import frugal
from .places import listed, opened

BLOCK = 16 << 20
_QUOTE, _BACK, _COMMA = 34, 92, 44
_STEP = np.zeros(256, np.int64)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1
_SIGN = _STEP != 0
_SIGN[_COMMA] = True

Block = tuple[str, int, int]  # file, first byte, bytes


def _backs_before(file, at: int) -> int:
    """How many backslashes in a row end before byte ``at``."""
    count = 0
    while at > count:
        size = min(64, at - count)
        file.seek(at - count - size)
        piece = file.read(size)
        run = size - len(piece.rstrip(b"\\"))
        count += run
        if run < size:
            break
    return count


def _scan(file, at: int, size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """A block, the places of its braces, brackets and commas, the quotes before each (odd: 1), and the quotes' number as an array of one."""
    carried = _backs_before(file, at)
    file.seek(at)
    block = file.read(size)
    codes = np.frombuffer(block, np.uint8)
    quotes, backs = np.flatnonzero(codes == _QUOTE), np.flatnonzero(codes == _BACK)
    if len(backs) or carried:
        first = np.r_[True, np.diff(backs) != 1] if len(backs) else np.empty(0, bool)
        start = backs[first][np.cumsum(first) - 1] if len(backs) else backs
        run = backs - start + 1
        if len(backs) and backs[0] == 0:
            run = run + np.where(start == 0, carried, 0)
        before = np.zeros(len(codes) + 1, np.uint8)  # odd run of backslashes just before a place
        before[backs + 1] = run & 1
        before[0] = carried & 1
        quotes = quotes[before[quotes] == 0]
    signs = np.flatnonzero(_SIGN[codes])
    return block, signs, np.searchsorted(quotes, signs) & 1, np.array([len(quotes)])


def _effect(file, at: int, size: int) -> tuple[int, int, int]:
    """(odd quotes, deeper if begun outside, deeper if begun inside of a string)."""
    block, signs, odd, quotes = _scan(file, at, size)
    steps = _STEP[np.frombuffer(block, np.uint8)[signs]]
    return int(quotes[0] & 1), int(steps[odd == 0].sum()), int(steps[odd == 1].sum())


def _cuts(file, at: int, size: int, inside: int, depth: int) -> tuple[bytes, list[tuple[int, bool]], int, int]:
    """A block, its (place, whether an entry begins after it) at the top, and the state at its end."""
    block, signs, odd, quotes = _scan(file, at, size)
    signs = signs[odd == inside]
    codes = np.frombuffer(block, np.uint8)[signs]
    after = depth + np.cumsum(_STEP[codes])
    if depth == 0 and len(codes) and codes[0] != ord("{"):
        raise ValueError("not a JSON object")
    begins = (after == 1) & ((codes == ord("{")) | (codes == _COMMA))
    begins &= (codes == _COMMA) | (np.r_[depth, after[:-1]] == 0)
    ends = (after == 0) & (_STEP[codes] < 0)
    at_top = np.flatnonzero(begins | ends)
    places = list(zip(signs[at_top].tolist(), begins[at_top].tolist()))
    return block, places, inside ^ int(quotes[0] & 1), int(after[-1]) if len(after) else depth


def _entries(file, length: int, at: int, size: int, inside: int, depth: int) -> Iterator[bytes]:
    """Every entry that begins in a block."""
    block, places, inside, depth = _cuts(file, at, size, inside, depth)
    for (place, begins), (end, _) in zip(places, places[1:]):
        if begins:
            yield block[place + 1 : end]
    if not places or not places[-1][1]:
        return
    pieces, at = [block[places[-1][0] + 1 :]], at + len(block)
    while at < length:
        block, places, inside, depth = _cuts(file, at, size, inside, depth)
        if places:
            pieces.append(block[: places[0][0]])
            yield b"".join(pieces)
            return
        pieces.append(block)
        at += len(block)
    raise ValueError("a JSON object without an end")


_DECODER = json.JSONDecoder()


def parsed(entry: bytes) -> tuple[str, str] | None:
    """(key, value as JSON) of an entry; None for blanks."""
    text = entry.decode("utf-8").strip()
    if not text:
        return None
    key, end = _DECODER.raw_decode(text)
    return key, text[end:].lstrip()[1:].strip()


def json_map(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(key, value): the entries of every file at ``path``, values as JSON texts."""
    files = listed(spark, path)
    lengths = dict(files)
    blocks = [(file, at, min(block, size - at)) for file, size in files for at in range(0, size, block)]
    if not blocks:
        return spark.createDataFrame([], "key string, value string")

    def effects(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                with opened(blocks[i][0]) as f:
                    odd, outside, within = _effect(f, *blocks[i][1:])
                yield pa.RecordBatch.from_pydict({"id": [i], "odd": [odd], "outside": [outside], "within": [within]})

    ids = spark.range(0, len(blocks), 1, len(blocks))
    found = {r.id: r for r in ids.mapInArrow(effects, "id bigint, odd bigint, outside bigint, within bigint").collect()}  # four numbers a block
    starts, inside, depth = [], 0, 0
    for i, (_, at, _) in enumerate(blocks):
        if at == 0:
            inside = depth = 0
        starts.append((inside, depth))
        depth += found[i].within if inside else found[i].outside
        inside ^= found[i].odd

    def entries(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                file, at, _ = blocks[i]
                with opened(file) as f:
                    rows, held = [], 0
                    for entry in _entries(f, lengths[file], at, block, *starts[i]):
                        row = parsed(entry)
                        if row is not None:
                            rows.append(row)
                            held += len(entry)
                        if held >= 1 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    yield _batch(rows)

    return ids.mapInArrow(frugal(entries), "key string, value string")


def _batch(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["key", "value"])


def write_json_map(df: DataFrame, key: str, value: str, path: str) -> None:
    """Rows as files of one object each, one for every partition; ``value`` is JSON, keys are any text."""

    def lines(batches):
        yield pa.RecordBatch.from_pydict({"value": ["{"]})
        comma = ""
        for batch in batches:
            texts = []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.append(f"{comma}{json.dumps(k, ensure_ascii=False)}: {x}")
                comma = ","
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])
        yield pa.RecordBatch.from_pydict({"value": ["}"]})

    rows = df.selectExpr(f"cast(`{key}` as string) as key", f"`{value}` as value").where("key is not null and value is not null")
    rows.mapInArrow(frugal(lines), "value string").write.text(path)
