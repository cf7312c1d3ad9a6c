"""Operator 5: substring dedup by sliding sentence spans.

A text is cut into sentences: after ``. ! ?`` (closing quotes and brackets may follow), their full-width forms, and at
line ends.  From every sentence a span runs over ``SENTENCES`` sentences, however short they are.  So every run of
``SENTENCES`` sentences or more that occurs again is found.

Passages without such borders have a second rule beside the first: from every word a window runs over ``WORDS`` words, so
every passage of ``WORDS`` words or more that occurs again is found, wherever it begins and whatever
marks it has.  A character of a script written without blanks (Han, kana, Thai, Lao, Khmer, Burmese,
Tibetan) counts as a word.  Spans and windows have hashes of their own and are treated alike:

1. The leading 40 bits of all span hashes are brought together by hash range; those that
   occur again are kept as sorted arrays in the shared folder.
2. Of the spans that have one of them each task sends the first occurrence by (doc_id, text
   hash, place) that it saw, once, however often it saw the span.  A task per hash range
   keeps the first occurrence of all in the shared folder.
3. Every text looks its spans up.  Where a span is not the first occurrence, all
   sentences, or words of a window, that it covers are removed.

The first occurrence stays whole, but for what a repeat that overlaps it covers.  ``n_sentences`` counts a text's
sentences, ``n_removed`` those that lost words.  Neither texts nor occurrences are shuffled, so a passage that very many
texts share is no more work for any task than another.

Defined results: comparison ignores the case of A-Z and the kind of white space;
null and empty texts, and texts too short for a span, stay as they are; rows that
agree in id and text are one occurrence and are treated alike; rows that share an
id only are told apart by a 64-bit hash of their text; a null id sorts first; other
columns pass through, but columns named like the two added ones give way to them;
an empty table gives an empty table; texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.memory import frugal
from .blocks import blocks_batch, pack
from .ranges import Ranges, flushed
from .textscan import Chunk, chunks, mix, span_hashes

SENTENCES, WORDS = 3, 20
#: Low bits of a hash that the first pass leaves out.
SHORT = 24
NO_ID = -(2**63)
_U = np.uint64
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_CLOSER = np.zeros(256, bool)
_CLOSER[[ord(c) for c in "\"')]"]] = True
#: Full-width full stop, exclamation and question mark.
_WIDE_STOPS = [tuple(c.encode()) for c in "\u3002\uff01\uff1f"]

#: First two bytes of the characters that count as words.
_ALONE = np.zeros(1 << 16, bool)
for _first, _last in ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3000, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):
    _ALONE[int.from_bytes(chr(_first).encode()[:2]) : int.from_bytes(chr(_last).encode()[:2]) + 1] = True
_ALONE.reshape(256, 256)[:, [*range(0x80), *range(0xC0, 0x100)]] = False


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def units(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, and of the characters that count as words."""
    starts, ends = chunk.words()
    buf = chunk.buf
    lead = np.flatnonzero(buf[:-1] >= 0xE0)
    lead = lead[_ALONE[buf[lead].astype(np.int64) << 8 | buf[lead + 1]]]
    if not len(lead):
        return starts, ends
    stop = lead + np.where(buf[lead] >= 0xF0, 4, 3)
    return np.union1d(starts, np.append(lead, np.setdiff1d(stop, ends))), np.union1d(ends, np.append(stop, np.setdiff1d(lead, starts)))


Cuts = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def sentences(chunk: Chunk) -> Cuts:
    """(first word, word after the last) of each sentence, and the words' starts, ends and hashes."""
    starts, ends = units(chunk)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, starts, ends, none.astype(_U)
    end = chunk.buf[ends - 1]
    closes = _STOP[end] | (_CLOSER[end] & _STOP[chunk.buf[np.maximum(ends - 2, starts)]])
    wide = np.flatnonzero((ends - starts >= 3) & (end >= 0x80))
    tail = [chunk.buf[ends[wide] - k] for k in (3, 2, 1)]
    for stop in _WIDE_STOPS:
        closes[wide] |= (tail[0] == stop[0]) & (tail[1] == stop[1]) & (tail[2] == stop[2])
    feeds = np.flatnonzero(chunk.buf == 10)
    line = np.searchsorted(feeds, starts)
    row = chunk.row_of(starts)
    closes[:-1] |= (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    closes[-1] = True
    last = np.flatnonzero(closes) + 1
    return np.append(0, last[:-1]), last, starts, ends, span_hashes(chunk.lower(), starts, ends)


_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Sets the hashes of sentence spans apart from those of windows.
_SALT = _U(0xA0761D6478BD642F)


def spans(chunk: Chunk, cuts: Cuts, bases: tuple[int, ...] = _BASES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(row, place among the row's words, words covered, hash, check) of every span and window; no check with one base."""
    first, last, starts, _, words = cuts
    none = np.zeros(0, np.int64)
    if not len(first):
        return none, none, none, none.astype(_U), none.astype(np.uint32)
    row = chunk.row_of(starts)
    runs = max(0, len(first) - SENTENCES + 1)
    windows = np.arange(max(0, len(words) - WORDS + 1))
    a, b = np.append(first[:runs], windows), np.append(last[len(last) - runs :], windows + WORDS)
    whole = row[a] == row[b - 1]
    n_runs, a, b = int(whole[:runs].sum()), a[whole], b[whole]
    found = []
    for base in bases:
        power = np.full(len(words) + 1, _U(base))
        power[0] = 1
        inverse = np.full(len(words) + 1, _U(_inverse(base)))
        inverse[0] = 1
        sums = np.append(_U(0), np.cumsum(words * np.multiply.accumulate(power)[:-1], dtype=_U))
        state = (sums[b] - sums[a]) * np.multiply.accumulate(inverse)[a] + (b - a).astype(_U)
        state[:n_runs] += _SALT
        found.append(mix(state))
    own = row[a]
    return own, a - np.searchsorted(row, np.arange(len(chunk)))[own], b - a, found[0], (found[1] >> _U(32)).astype(np.uint32) if len(bases) > 1 else None


def _halves(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower and upper 16 bits, which compress better apart."""
    return (place & 0xFFFF).astype(np.uint16), (place >> 16).astype(np.uint16)


def _whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.int32) | high.astype(np.int32) << 16


def _among(hashes: np.ndarray, found: Ranges) -> np.ndarray:
    """Mask of the ascending hashes that are, shortened, among those that occur again."""
    out = np.zeros(len(hashes), bool)
    for _, here, _, hit in found.places("seen", hashes >> _U(SHORT), found.edges(hashes)):
        out[here] = hit
    return out


def _seen_again(texts: DataFrame, found: Ranges) -> None:
    """Step 1."""

    def flush(held: list) -> pa.RecordBatch:
        short, times = np.unique(np.concatenate([h[0] for h in held]), return_counts=True)
        edges = found.edges(short << _U(SHORT))
        return blocks_batch(found.keys, [(p, pack(short[edges[p] : edges[p + 1]], times[edges[p] : edges[p + 1]] > 1)) for p in range(found.parts) if edges[p] < edges[p + 1]])

    def again(got: list) -> list[np.ndarray]:
        short, several = (np.concatenate([x[i] for x in got]) for i in range(2))
        order = np.argsort(short)
        short, several = short[order], several[order]
        several[1:] |= short[1:] == short[:-1]
        short = short[several]
        return [short[np.append(True, short[1:] != short[:-1])[: len(short)]]]

    found.keep(flushed(texts.select("text"), lambda chunk, _: (spans(chunk, sentences(chunk), _BASES[:1])[3] >> _U(SHORT),), flush), again, "seen")


FIRST = ("hash", "check", "id", "mark", "place")


def _earliest(hashes: np.ndarray, check: np.ndarray, place: np.ndarray, owner: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Index of the first occurrence of each span, by ascending hash; ``owner``: the place of a span's text in ``ids`` and ``marks``."""
    order = np.argsort(hashes, kind="stable")
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = hashes[order[1:]] == hashes[order[:-1]]
    many = np.flatnonzero(same[1:] | same[:-1])  # only these need a closer look
    at = order[many]
    order[many] = at[np.lexsort((place[at], marks[owner[at]], ids[owner[at]], check[at], hashes[at]))]
    new = np.ones(len(order), bool)
    new[1:] = ~same[1:-1] | (check[order[1:]] != check[order[:-1]])
    return order[new]


def _first_occurrences(texts: DataFrame, found: Ranges) -> None:
    """Step 2."""

    def scan(chunk: Chunk, batch: pa.RecordBatch) -> tuple:
        row, place, _, hashes, check = spans(chunk, sentences(chunk))
        order = np.argsort(hashes)
        order = order[_among(hashes[order], found)]
        here = slice(chunk.first, chunk.first + len(chunk))
        return hashes[order], check[order], place[order].astype(np.int32), row[order].astype(np.int32), np.asarray(batch.column(0))[here], np.asarray(batch.column(1))[here]

    def flush(held: list) -> pa.RecordBatch:
        base = np.cumsum([0, *(len(h[4]) for h in held)])
        hashes, check, place = (np.concatenate([h[i] for h in held]) for i in range(3))
        owner = np.concatenate([h[3] + b for h, b in zip(held, base[:-1], strict=True)])
        ids, marks = (np.concatenate([h[i] for h in held]) for i in (4, 5))
        at = _earliest(hashes, check, place, owner, ids, marks)
        hashes, check, place, owner = hashes[at], check[at], place[at], owner[at]
        edges, out = found.edges(hashes), []
        for p in range(found.parts):
            here = slice(edges[p], edges[p + 1])
            if edges[p] < edges[p + 1]:
                local, back = np.unique(owner[here], return_inverse=True)
                out.append((p, pack(hashes[here], check[here], back.astype(np.uint16 if len(local) < 65536 else np.uint32), *_halves(place[here]), ids[local], marks[local])))
        return blocks_batch(found.keys, out)

    def earliest(got: list) -> list[np.ndarray]:
        hashes, check = (np.concatenate([x[i] for x in got]) for i in range(2))
        place = np.concatenate([_whole(x[3], x[4]) for x in got])
        base = np.cumsum([0, *(len(x[5]) for x in got)])
        owner = np.concatenate([x[2] + b for x, b in zip(got, base[:-1], strict=True)])
        ids, marks = (np.concatenate([x[i] for x in got]) for i in (5, 6))
        at = _earliest(hashes, check, place, owner, ids, marks)
        return [hashes[at], check[at], ids[owner[at]], marks[owner[at]], place[at]]

    found.keep(flushed(texts, scan, flush), earliest, *FIRST)


def _later(chunk: Chunk, cuts: Cuts, ids: np.ndarray, marks: np.ndarray, found: Ranges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, number of words) of the spans that are not first occurrences, by row."""
    row, place, covers, hashes, check = spans(chunk, cuts)
    order = np.argsort(hashes)
    late = np.zeros(len(order), bool)
    for p, here, at, hit in found.places("hash", hashes[order], found.edges(hashes[order])):
        mine = order[here][hit]
        first = {name: found.store.get(name, p)[at[hit]] for name in FIRST[1:]}
        same = (first["id"] == ids[row[mine]]) & (first["mark"] == marks[row[mine]]) & (first["place"] == place[mine])
        late[mine] = (first["check"] == check[mine]) & ~same
    late = np.flatnonzero(late)
    late = late[np.argsort(row[late], kind="stable")]
    return row[late], place[late], covers[late]


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", added: tuple[str, str] = ("n_sentences", "n_removed")) -> DataFrame:
    """``docs`` with repeated spans cut out of the text, and the numbers of all and of removed sentences added."""
    id_ = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id")
    mark = F.xxhash64(F.col(text_col)).alias("mark")
    texts = docs.select(id_, mark, F.col(text_col).cast("string").alias("text"))
    found = Ranges(docs.sparkSession, "spans")
    _seen_again(texts, found)
    _first_occurrences(texts, found)
    at, given = docs.columns.index(text_col), {n.lower() for n in added}
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in given]
    names = [*(docs.columns[i] for i in kept), *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, marks = batch.column(0), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            column = rows.field(at)
            for chunk in chunks(pc.cast(column, pa.string())):
                here = slice(chunk.first, chunk.first + len(chunk))
                cuts = sentences(chunk)
                row, place, covers = _later(chunk, cuts, ids[here], marks[here], found)
                first, last, starts, _, _ = cuts
                of_sentence, of_word = (chunk.row_of(starts[x]) for x in (first, slice(None)))
                edge, begin, hits = (np.searchsorted(x, np.arange(len(chunk) + 1)) for x in (of_sentence, of_word, row))
                gone = np.zeros(len(chunk), np.int64)
                texts_ = column.slice(chunk.first, len(chunk))
                if len(row):
                    own = texts_.to_pylist()
                    for i in np.flatnonzero(np.diff(hits)).tolist():
                        mine, its_words = slice(hits[i], hits[i + 1]), slice(begin[i], begin[i + 1])
                        own[i], dead = _cut(chunk, i, starts[its_words], place[mine], covers[mine])
                        gone[i] = np.logical_or.reduceat(dead, first[edge[i] : edge[i + 1]] - begin[i]).sum()
                    texts_ = pa.array(own, column.type)
                columns = [texts_ if i == at else rows.field(i).slice(chunk.first, len(chunk)) for i in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(edge), pa.int64()), pa.array(gone)], names)

    whole = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), id_, mark)
    schema = StructType([*(docs.schema[i] for i in kept), *(StructField(n, LongType()) for n in added)])
    return whole.mapInArrow(frugal(run), schema)


def _cut(chunk: Chunk, i: int, begin: np.ndarray, place: np.ndarray, covers: np.ndarray) -> tuple[str, np.ndarray]:
    """Row ``i`` without the covered words, each of which goes with the white space after it, and which they are; ``begin``: where its words begin."""
    change = np.zeros(len(begin) + 1, np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + covers, -1)
    dead = np.cumsum(change[:-1]) > 0
    stop = np.append(begin[1:], chunk.offsets[i + 1])
    pieces = [chunk.buf[chunk.offsets[i] : begin[0]].tobytes()]
    alive = np.flatnonzero(~dead)
    if len(alive):
        breaks = np.flatnonzero(np.append(True, np.diff(alive) != 1))
        ends_ = np.append(breaks[1:], len(alive)) - 1
        pieces += [chunk.buf[begin[a] : stop[b]].tobytes() for a, b in zip(alive[breaks], alive[ends_], strict=True)]
    return b"".join(pieces).decode(), dead
