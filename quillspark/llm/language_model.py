"""Operator 9: interpolated modified Kneser-Ney n-gram model.

Counted in Spark over all training texts, stored as sorted arrays in the shared
folder, memory-mapped by the workers that score.

* Words are known by a 64-bit hash.  A first pass counts them by hash range; a
  word's place in the sorted hashes is its number.
* A pass for each order k from 2 on counts the k-grams by the key ``number of the
  (k - 1)-gram before the last word << 32 | number of the last word``, summed within each
  task and packed as gaps of sorted keys, by hash of the key.  So the followers of a
  frequent word spread over all tasks.  A k-gram's place in its task's sorted keys
  is its number.
* For each k-gram a task knows its context and its suffix, the last k - 1 words.  How
  often a context occurs and with how many followers seen once, twice and more, and
  in how many different places a suffix continues, is summed within the task and
  then by number.  Below the highest order the continuations stand for the counts, except for
  grams at the begin of a text, before which nothing can stand.

P(w|v) = max(a(vw) - D, 0) / a(v) + g(v) P(w|v'), v' being v without its first word; P(w)
likewise, and at last the uniform 1 / (V + 1) for words never seen.  D depends on
the count (1, 2, 3 or more) and the order, by the usual formula from counts of counts.

Defined results: texts are lower-cased (A-Z); a null or empty text is its end
token only; repeated rows count each time; a null id is in training; other columns
are not read; without training texts every word has the uniform probability; an
empty table gives an empty table.  More than ``MOST`` different words, or different grams
below the highest order, raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.memory import frugal
from ..plans.shared import written
from ..plans.sharedfiles import ROWS, ArrayStore, array_of, array_row
from .blocks import blocks_batch, bucket, by_key, pack, partition_keys
from .textscan import Chunk, chunks, mix, span_hashes

ORDER = 2
END_HASH = np.uint64(0x5D0A4C1E9B3F7286)
FLUSH = 4_000_000
CHUNK = 4 << 20
FOLDS, HELD = 7, 2
#: Numbers fill 32 bits of a key.
MOST = 2**32 - 2
_U = np.uint64
_LOW = np.uint64(0xFFFFFFFF)
SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (each row's words, then its end) and the place after each row's last."""
    starts, ends = chunk.words()
    words = span_hashes(chunk.lower(), starts, ends)
    stop = np.cumsum(chunk.per_row(starts))
    return np.insert(words, stop, END_HASH), stop + np.arange(1, len(chunk) + 1)


@dataclass
class Model:
    """Where the arrays lie, and the few numbers that hold for all of them."""

    store: ArrayStore
    parts: int
    order: int
    train_tokens: int = 0
    #: By order: the first number of each part, and the number of all.  A text's begin has the number V.
    base: dict[int, list[int]] = field(default_factory=dict)
    #: By array: the parts that have one.
    held: dict[str, set[int]] = field(default_factory=dict)
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    kinds: tuple[int, int, int] = (0, 0, 0)
    continuations: int = 0

    @property
    def vocabulary(self) -> int:
        return self.base[1][-1]

    def number(self, order: int, rows: dict[int, int]) -> None:
        """Give numbers to the grams of an order, of which each part has so many."""
        self.base[order] = [0, *np.cumsum([rows.get(p, 0) for p in range(self.parts)]).tolist()]
        if self.base[order][-1] > MOST and (order == 1 or order < self.order):
            raise OverflowError(f"{self.base[order][-1]} different grams of order {order} do not fit into 32 bits")

    def owners(self, order: int, numbers: np.ndarray) -> np.ndarray:
        """The part that holds each number."""
        return np.minimum(np.searchsorted(self.base[order], numbers, side="right") - 1, self.parts - 1)

    def span(self, order: int, part: int) -> tuple[int, int]:
        """The numbers of a part; the last one of the words also has the begin."""
        return self.base[order][part], self.base[order][part + 1] + (order == 1 and part == self.parts - 1)

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and count of each of the ascending hashes."""
        return self._find(1, hashes, bucket(hashes, self.parts).astype(np.int64), "words", "word_counts")

    def grams(self, order: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and count of each of the ascending keys; the count below the highest order only once it is adjusted."""
        return self._find(order, keys, bucket(mix(keys), self.parts).astype(np.int64), f"grams{order}", f"counts{order}")

    def _find(self, order: int, keys: np.ndarray, part: np.ndarray, names: str, counts: str) -> tuple[np.ndarray, np.ndarray]:
        number, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        by_part = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[by_part], np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            if p not in self.held.get(names, ()):
                continue
            here = by_part[edges[p] : edges[p + 1]]
            known = self.store.get(names, p)
            place = np.minimum(np.searchsorted(known, keys[here]), len(known) - 1)
            hit = known[place] == keys[here]
            number[here] = np.where(hit, place + self.base[order][p], -1)
            if p in self.held.get(counts, ()):
                count[here] = np.where(hit, self.store.get(counts, p)[place], 0)
        return number, count

    def dense(self, name: str, order: int, numbers: np.ndarray, width: int) -> np.ndarray:
        """Rows of an array that has one for each number of an order; numbers ascend."""
        out = np.zeros((len(numbers), width), np.int64)
        edges = np.searchsorted(self.owners(order, numbers), np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            if p in self.held.get(name, ()):
                here = slice(edges[p], edges[p + 1])
                out[here] = self.store.get(name, p)[numbers[here] - self.base[order][p]]
        return out


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many items occur 1, 2, 3 and 4 times."""
    if n[0] == 0 or n[1] == 0:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 for k in (1, 2, 3)]
    return tuple(float(min(max(x, 0.0), k)) for k, x in zip((1, 2, 3), d, strict=True))


def _small(counts: np.ndarray) -> np.ndarray:
    top = int(counts.max()) if counts.size else 0
    return counts.astype(np.uint8 if top < 256 else np.uint32 if top < 2**32 else np.int64)


def _tally(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


# -- items: ascending keys, then columns that are summed (int64) or, as all rows of a key agree, taken (others) -----------


def _summed(columns: list[np.ndarray]) -> list[np.ndarray]:
    keys = columns[0]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    out = [keys[edge]]
    for c in columns[1:]:
        out.append((np.add.reduceat(c[order], edge, axis=0) if len(edge) else c) if c.dtype == np.int64 else c[order][edge])
    return out


def _merged(got: list[list[np.ndarray]], summed: int) -> list[np.ndarray]:
    """Blocks of one part as one; the first ``summed`` columns after the keys are counts."""
    columns = [np.concatenate([x[i] for x in got]) for i in range(len(got[0]))]
    return _summed([c.astype(np.int64) if 0 < i <= summed else c for i, c in enumerate(columns)])


def _packed(keys: list[int], to: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """The columns (ascending keys first) cut up by part."""
    by_part = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[by_part], np.arange(len(keys) + 1))
    for p in range(len(keys)):
        here = by_part[edges[p] : edges[p + 1]]
        if len(here):
            yield p, pack(*(_small(c[here]) if c.dtype == np.int64 else c[here] for c in columns))


def _counted(texts: DataFrame, keys: list[int], items: Callable[[Chunk], list[np.ndarray]], owner: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Blocks (to, block) of the items of all texts, summed within a task as far as memory is meant to be used."""

    def flush(held: list) -> pa.RecordBatch:
        columns = _summed([np.concatenate([h[i] for h in held]) for i in range(len(held[0]))])
        return blocks_batch(keys, list(_packed(keys, owner(columns[0]), columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for chunk in chunks(batch.column(0), CHUNK):
                held.append(items(chunk))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return texts.mapInArrow(frugal(run), "to int, block binary")


def _by_part(blocks: DataFrame, parts: int, run: Callable) -> DataFrame:
    return written(blocks.repartition(parts, "to").sortWithinPartitions("to").mapInArrow(frugal(run), ROWS))


def _sent(name: str, keys: list[int], blocks: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Blocks for the next exchange, as rows beside the arrays that a store puts."""
    for p, block in blocks:
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([keys[p]], pa.int32()), pa.array([0], pa.int32()), pa.array([block], pa.binary())], ["name", "part", "seq", "block"])


def _received(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("name") == name).select(F.col("part").alias("to"), "block")


def _facts(rows: DataFrame) -> dict[int, np.ndarray]:
    return {r.part: array_of(r.block) for r in rows.where("name = 'facts'").select("part", "block").collect()}


# -- training ---------------------------------------------------------------------------


def _gram_ids(chunk: Chunk, model: Model, upto: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """For each order the number of the gram that ends at each token (-1: none or unknown), and the token's place in its text."""
    hashes, stop = tokens(chunk)
    start = np.append(0, stop[:-1])
    place = np.arange(len(hashes)) - np.repeat(start, stop - start)
    distinct, back = np.unique(hashes, return_inverse=True)
    ids = {1: model.words(distinct)[0][back]}
    for k in range(2, upto + 1):
        context = _contexts(ids, place, k, model)
        ids[k] = np.full(len(hashes), -1, np.int64)
        at = np.flatnonzero((context >= 0) & (ids[1] >= 0))
        keys, back = np.unique(_keys(context[at], ids[1][at]), return_inverse=True)
        ids[k][at] = model.grams(k, keys)[0][back]
    return ids, place


def _contexts(ids: dict[int, np.ndarray], place: np.ndarray, order: int, model: Model) -> np.ndarray:
    """Number of the gram of one order less that ends before each token; -1: none or unknown."""
    before = np.append(-1, ids[order - 1][:-1])
    return np.where(place == 0, model.vocabulary, before) if order == 2 else np.where(place >= order - 2, before, -1)


def _keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return context.astype(_U) << _U(32) | word.astype(_U)


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """Count all of ``texts`` (one column ``text``) into a model of an order from 2 on, in the shared folder."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = partition_keys(parts)
    number_of = {k: p for p, k in enumerate(keys)}
    store = ArrayStore(spark, "lm")
    model = Model(store, parts, order)

    def word_items(chunk: Chunk) -> list[np.ndarray]:
        hashes, counts = np.unique(tokens(chunk)[0], return_counts=True)
        return [hashes, counts.astype(np.int64)]

    def store_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, got in by_key(batches):
            part = number_of[key]
            hashes, counts = _merged(got, 1)
            yield from store.put("words", part, hashes)
            yield from store.put("word_counts", part, counts)
            yield array_row("facts", part, np.array([len(hashes), counts.sum()]))

    rows = _by_part(_counted(texts, keys, word_items, lambda h: bucket(h, parts).astype(np.int64)), parts, store_words)
    facts = _facts(rows)
    store.publish(rows, "words", "word_counts")
    model.held |= {"words": set(facts), "word_counts": set(facts)}
    model.number(1, {p: int(x[0]) for p, x in facts.items()})
    model.train_tokens = sum(int(x[1]) for x in facts.values())
    for k in range(2, order + 1):
        _train_order(texts, model, k, keys, number_of)
    return model


def _train_order(texts: DataFrame, model: Model, k: int, keys: list[int], number_of: dict[int, int]) -> None:
    """Store the k-grams; adjust the counts of the grams of one order less; at the highest order its contexts too."""
    store, parts, highest = model.store, model.parts, k == model.order

    def items(chunk: Chunk) -> list[np.ndarray]:
        """Keys, counts, suffixes, and whether a gram stands at the begin of a text."""
        ids, place = _gram_ids(chunk, model, k - 1)
        context = _contexts(ids, place, k, model)
        at = np.flatnonzero(context >= 0)
        found, first, counts = np.unique(_keys(context[at], ids[1][at]), return_index=True, return_counts=True)
        out = [found, counts.astype(np.int64)]
        if k > 2:
            out += [ids[k - 1][at[first]].astype(np.uint32), (place[at[first]] == k - 2).astype(np.uint8)]
        return out

    def store_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, got in by_key(batches):
            part = number_of[key]
            columns = _merged(got, 1)
            del got
            found, counts = columns[:2]
            suffix = columns[2].astype(np.int64) if k > 2 else (found & _LOW).astype(np.int64)
            yield from store.put(f"grams{k}", part, found)
            yield array_row("facts", part, np.array([len(found), *_tally(counts)]))
            places = _summed([suffix.astype(_U), np.ones(len(suffix), np.int64)])
            yield from _sent("places", keys, _packed(keys, model.owners(k - 1, places[0].astype(np.int64)), places))
            if highest:
                yield from store.put(f"counts{k}", part, _small(counts))
                yield from _sent("contexts", keys, _context_blocks(model, k, keys, found, counts))
            else:  # the counts of grams at the begin of a text are all that is needed of them
                begins = columns[3].astype(bool) if k > 2 else (found >> _U(32)) == _U(model.vocabulary)
                yield from store.put(f"raw{k}", part, _small(np.where(begins, counts, 0)))

    rows = _by_part(_counted(texts, keys, items, lambda x: bucket(mix(x), parts).astype(np.int64)), parts, store_grams)
    facts = _facts(rows)
    own = [f"grams{k}", f"counts{k}" if highest else f"raw{k}"]
    store.publish(rows, *own)
    model.held |= {name: set(facts) for name in own}
    model.number(k, {p: int(x[0]) for p, x in facts.items()})
    if highest:
        model.discounts[k] = _discounts(np.sum([x[1:] for x in facts.values()], axis=0) if facts else np.zeros(4))
        _store_contexts(_received(rows, "contexts"), model, k, number_of)
    places = _received(rows, "places")
    if k > 2:  # a part none of whose grams continues anything is adjusted too
        nothing = pack(np.zeros(0, _U), np.zeros(0, np.uint8))
        places = places.unionByName(texts.sparkSession.createDataFrame([(keys[p], bytearray(nothing)) for p in sorted(model.held[f"grams{k - 1}"])], places.schema))
    _adjust(places, model, k - 1, keys, number_of)


def _context_blocks(model: Model, k: int, keys: list[int], found: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Of each context the sum of its counts and how many are 1, 2 and more, for the parts of the contexts."""
    context = found >> _U(32)
    facts = np.stack([counts, counts == 1, counts == 2, counts > 2], 1).astype(np.int64)
    context, facts = _summed([context, facts])
    yield from _packed(keys, model.owners(k - 1, context.astype(np.int64)), [context, *(np.ascontiguousarray(facts[:, i]) for i in range(4))])


def _store_contexts(blocks: DataFrame, model: Model, k: int, number_of: dict[int, int]) -> None:
    store, name = model.store, f"contexts{k}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, got in by_key(batches):
            part = number_of[key]
            context, *facts = _merged(got, 4)
            low, high = model.span(k - 1, part)
            table = np.zeros((high - low, 4), np.int64)
            table[context.astype(np.int64) - low] = np.stack(facts, 1)
            yield from store.put(name, part, _small(table))
            yield array_row("facts", part, np.zeros(1))

    rows = _by_part(blocks, model.parts, run)
    store.publish(rows, name)
    model.held[name] = set(_facts(rows))


def _adjust(blocks: DataFrame, model: Model, k: int, keys: list[int], number_of: dict[int, int]) -> None:
    """The counts of an order below the highest: in how many different places a gram continues."""
    store, name = model.store, "places" if k == 1 else f"counts{k}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, got in by_key(batches):
            part = number_of[key]
            grams, places = _merged(got, 1)
            low, high = model.span(k, part)
            if k == 1:
                counts = np.zeros((high - low, 1), np.int64)
                counts[grams.astype(np.int64) - low, 0] = places
            else:
                counts = np.array(store.get(f"raw{k}", part), np.int64)
                at = grams.astype(np.int64) - low
                counts[at] = np.where(counts[at] > 0, counts[at], places)
                yield from _sent("contexts", keys, _context_blocks(model, k, keys, store.get(f"grams{k}", part), counts))
            yield from store.put(name, part, _small(counts))
            used = counts[counts > 0]
            yield array_row("facts", part, np.array([*_tally(used), (used > 2).sum(), used.sum()]))

    rows = _by_part(blocks, model.parts, run)
    facts = _facts(rows)
    store.publish(rows, name)
    model.held[name] = set(facts)
    total = np.sum(list(facts.values()), axis=0) if facts else np.zeros(6, np.int64)
    model.discounts[k] = _discounts(total[:4])
    if k == 1:
        model.kinds, model.continuations = (int(total[0]), int(total[1]), int(total[4])), int(total[5])
    else:
        _store_contexts(_received(rows, "contexts"), model, k, number_of)


# -- scoring ----------------------------------------------------------------------------


def _discount_of(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def score_chunk(chunk: Chunk, model: Model) -> dict[str, np.ndarray]:
    hashes, stop = tokens(chunk)
    start = np.append(0, stop[:-1])
    place = np.arange(len(hashes)) - np.repeat(start, stop - start)
    distinct, back = np.unique(hashes, return_inverse=True)
    number, count = model.words(distinct)
    known = number >= 0
    places = np.zeros(len(distinct), np.int64)
    at = np.flatnonzero(known)
    at = at[np.argsort(number[at])]
    places[at] = model.dense("places", 1, number[at], 1)[:, 0]
    uniform = 1.0 / (model.vocabulary + 1)
    if model.continuations:
        d = model.discounts[1]
        rest = sum(x * n for x, n in zip(d, model.kinds, strict=True)) / model.continuations
        lower = np.maximum(places - _discount_of(places, d), 0) / model.continuations + rest * uniform
    else:
        lower = np.full(len(distinct), uniform)
    base = np.log10((count + 1) / (model.train_tokens + model.vocabulary + 1))
    p, ids = lower[back], {1: number[back]}
    for k in range(2, model.order + 1) if model.vocabulary else ():
        context = _contexts(ids, place, k, model)
        at = np.flatnonzero((context >= 0) & (ids[1] >= 0))
        keys, key_back = np.unique(_keys(context[at], ids[1][at]), return_inverse=True)
        found, seen = model.grams(k, keys)
        ids[k], own = np.full(len(p), -1, np.int64), np.zeros(len(p), np.int64)
        ids[k][at], own[at] = found[key_back], seen[key_back]
        at = np.flatnonzero(context >= 0)
        firsts, first_back = np.unique(context[at], return_inverse=True)
        table = model.dense(f"contexts{k}", k - 1, firsts, 4)
        d, total = model.discounts[k], np.maximum(table[:, 0], 1)
        back_off = np.where(table[:, 0] > 0, table[:, 1:] @ np.array(d) / total, 1.0)
        p[at] = np.maximum(own[at] - _discount_of(own[at], d), 0) / total[first_back] + back_off[first_back] * p[at]
    return {
        "n_tokens": stop - start,
        "n_known": np.add.reduceat(known[back].astype(np.int64), start),
        "base_score": np.add.reduceat(base[back], start),
        "score": np.add.reduceat(np.log10(p), start),
    }


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (``SCHEMA``) of every text, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2), CHUNK):
                out, here = score_chunk(chunk, model), (chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(*here), batch.column(1).slice(*here), pa.array(out["n_tokens"], pa.int64()), pa.array(out["n_known"], pa.int64()), pa.array(np.full(len(chunk), model.train_tokens), pa.int64()), pa.array(out["base_score"], pa.float64()), pa.array(out["score"], pa.float64())],
                    [f.strip().split(" ")[0] for f in SCHEMA.split(",")],
                )

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(frugal(run), SCHEMA)


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Learn from the rows that are not held out, and score all."""
    model = train(docs.where(~held_out(F.col(id_col))).select(F.col(text_col).cast("string").alias("text")), order)
    return score(docs, model, id_col, text_col)
