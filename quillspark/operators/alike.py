"""Words alike in form and meaning, compared where those of one stem meet.

A word's vector is the mean of those of its texts.  Texts are added up in Arrow, many at a time, so that a word
is sent once for many texts and not once for each; the sums of a stem go to one unit of work, which
adds them up and compares its words there.  Vectors never travel with pairs.  A stem whose sums are larger than
``BLOCK`` is cut into blocks of words, and each pair of blocks is a unit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.memory import frugal
from ..plans.shared import written
from .bags import pieces

Batches = Iterator[pa.RecordBatch]
#: Words of texts, each counted once for a text, that are added up together.
PLACES = 1 << 22
#: Bytes of sums in a block of a stem, and in a partition.
BLOCK = 32 << 20
#: Vectors that are added up or compared at once, and compared pairs in memory.
ROWS, CELLS = 1 << 14, 1 << 21
#: A word that meets so many others at most is compared pair by pair, with the words of other stems.
FEW = 32


def _gathered(batches: Batches, places: int) -> Iterator[tuple[pa.DictionaryArray, np.ndarray, pa.RecordBatch]]:
    """Words of many texts, the number of the text of each, and the texts."""
    words, at, parts, texts, n = [], [], [], 0, 0

    def made() -> tuple:
        coded = pa.chunked_array(words).unify_dictionaries()
        codes = pa.concat_arrays([c.indices for c in coded.chunks])
        return pa.DictionaryArray.from_arrays(codes, coded.chunk(0).dictionary), np.concatenate(at), pa.Table.from_batches(parts)

    for batch in batches:
        for part in pieces([batch]):
            words.append(part.column("tokens").flatten().dictionary_encode())
            at.append(np.repeat(np.arange(texts, texts + len(part), dtype=np.int32), np.asarray(pc.list_value_length(part.column("tokens")))))
            parts.append(part.select([c for c in part.schema.names if c != "tokens"]))
            texts, n = texts + len(part), n + len(part) + len(words[-1])
            if n >= places:
                yield made()
                words, at, parts, texts, n = [], [], [], 0, 0
    if words:
        yield made()


def _sizes(rows: DataFrame, stem: int) -> DataFrame:
    """Rows (stem, rows): how many rows ``_sums`` has of a stem."""

    def run(batches: Batches) -> Batches:
        for words, _, _ in _gathered(batches, PLACES):
            found = pc.value_counts(pc.utf8_slice_codeunits(words.dictionary, 0, stem))
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["stem", "rows"])

    return rows.select("tokens").mapInArrow(frugal(run), "stem string, rows bigint").groupBy("stem").agg(F.sum("rows").alias("rows"))


def _binary(rows: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _dense(lists: pa.ChunkedArray, dim: int, kind: type) -> tuple[np.ndarray, np.ndarray | None]:
    """Vectors as rows, and where they have a number; None if all have all."""
    flat, sizes = pc.list_flatten(lists), np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    if not flat.null_count and (sizes == dim).all():
        return flat.to_numpy().reshape(-1, dim), None
    has = np.asarray(flat.is_valid())
    row = np.repeat(np.arange(len(sizes)), sizes)[has]
    place = (np.arange(len(has)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[has]
    vectors, given = np.zeros((len(sizes), dim), kind), np.zeros((len(sizes), dim), bool)
    vectors[row, place], given[row, place] = flat.drop_null().to_numpy(), True
    return vectors, given


def _sums(rows: DataFrame, dim: int, kind: type) -> DataFrame:
    """Rows (token, n, v), one of a word for many texts: the sum of n vectors.

    ``v`` has the bytes of a vector if n is 1, of doubles if n is more, and of doubles and how many
    numbers each is the sum of, if some have none in a place.
    """

    def added(words: pa.Array, codes: np.ndarray, texts: np.ndarray, vectors: np.ndarray, given: np.ndarray | None) -> Batches:
        n = np.bincount(codes, minlength=len(words))
        often = n[codes] > (1 if given is None else 0)
        one = np.flatnonzero(~often)
        for k in range(0, len(one), ROWS):
            some = one[k : k + ROWS]
            yield out(words, codes[some], n, vectors[texts[some]])
        codes, texts = codes[often], texts[often]
        order = np.argsort(codes, kind="stable")
        codes, texts = codes[order], texts[order]
        begin = np.flatnonzero(np.diff(codes, prepend=-1))
        for some in np.split(begin, np.flatnonzero(np.diff(begin // ROWS)) + 1):
            if len(some):
                mine = texts[some[0] : some[-1] + n[codes[some[-1]]]]
                parts = [np.add.reduceat(x[mine].astype(np.float64), some - some[0], axis=0) for x in (vectors, given) if x is not None]
                yield out(words, codes[some], n, np.hstack(parts))

    def out(words: pa.Array, some: np.ndarray, n: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([words.take(pa.array(some)), pa.array(n[some].astype(np.int64)), _binary(values)], ["token", "n", "v"])

    def run(batches: Batches) -> Batches:
        for words, texts, table in _gathered(batches, PLACES):
            vectors, given = _dense(table.column("embedding"), dim, kind)
            codes = np.asarray(words.indices)
            if given is None:
                yield from added(words.dictionary, codes, texts, vectors, None)
                continue
            whole = given.all(axis=1)[texts]
            yield from added(words.dictionary, codes[whole], texts[whole], vectors, None)
            yield from added(words.dictionary, codes[~whole], texts[~whole], vectors, given)

    return rows.select("tokens", "embedding").mapInArrow(frugal(run), "token string, n bigint, v binary")


def _changes(*columns: pa.Array) -> np.ndarray:
    """Is a row another than the one before it?"""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)))
    return new


def _means(v: pa.Array, n: np.ndarray, starts: np.ndarray, dim: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of words whose sums begin at the rows ``starts``, and whether one has a place without any number."""
    size = np.asarray(pc.binary_length(v))
    total, counts = np.zeros((len(v), dim)), None
    for width, dtype in {dim * np.dtype(kind).itemsize: kind, dim * 8: np.float64, dim * 16: np.float64}.items():
        mine = size == width
        if mine.any():
            _, ends, body = (got := v.filter(pa.array(mine))).buffers()
            first = np.frombuffer(ends, np.int32)[got.offset]
            values = np.frombuffer(body, dtype, len(got) * width // np.dtype(dtype).itemsize, first).reshape(len(got), -1)
            total[mine] = values[:, :dim]
            if width == dim * 16:
                counts = np.repeat(n[:, None], dim, axis=1) if counts is None else counts
                counts[mine] = values[:, dim:]
    of = np.add.reduceat(n[:, None] if counts is None else counts, starts, axis=0)
    return np.add.reduceat(total, starts, axis=0) / of, (of == 0).any(axis=1)


def _dot(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products added up one after the other."""
    return np.cumsum(p * q, axis=1)[:, -1]


def _pairs(units: DataFrame, dim: int, kind: type, least_prefix: int, least_share: float, least_cosine: float) -> DataFrame:
    def near(batch: pa.RecordBatch) -> Batches:
        unit, token = _changes(*(batch.column(c) for c in ("stem", "i", "j"))), batch.column("token")
        starts = np.flatnonzero(unit | _changes(token))
        vectors, lacking = _means(batch.column("v"), np.asarray(batch.column("n")).astype(np.float64), starts, dim, kind)
        unit, token = np.cumsum(unit)[starts], token.take(pa.array(starts))
        block, i, j = (np.asarray(batch.column(c))[starts] for c in ("block", "i", "j"))
        length, norm = np.asarray(pc.utf8_length(token)), np.sqrt(_dot(vectors, vectors))
        common = np.maximum(np.ceil(length * least_share).astype(np.int64), least_prefix)

        def out(short: np.ndarray, long: np.ndarray) -> Batches:
            some = ((length[long] > length[short]) | ((length[long] == length[short]) & (long > short))) & ((i[short] == j[short]) | (block[short] != block[long])) & ~lacking[short] & ~lacking[long]
            short, long = short[some], long[some]
            for k in range(0, len(short), ROWS):
                s, t = short[k : k + ROWS], long[k : k + ROWS]
                cosine = _dot(vectors[s], vectors[t]) / (norm[s] * norm[t])
                s, t, cosine = (x[~(cosine < least_cosine)] for x in (s, t, cosine))
                if len(s):
                    # rows are in the order of their words
                    yield pa.RecordBatch.from_arrays([token.take(pa.array(np.minimum(s, t))), token.take(pa.array(np.maximum(s, t))), pa.array(cosine)], ["a", "b", "cosine"])

        for letters in range(least_prefix, common.max(initial=0) + 1):
            # Words with so many letters in common follow each other.
            new = _changes(pc.utf8_slice_codeunits(token, 0, letters), pa.array(unit))
            run, begin = np.cumsum(new) - 1, np.flatnonzero(new)
            size = np.diff(np.append(begin, len(new)))
            shorts = np.flatnonzero((common == letters) & (length >= letters) & (size[run] > 1))
            few = shorts[size[run[shorts]] <= FEW]
            step = max(1, ROWS // FEW)
            for k in range(0, len(few), step):
                some = few[k : k + step]
                n = size[run[some]]
                yield from out(np.repeat(some, n), np.repeat(begin[run[some]] - np.cumsum(n) + n, n) + np.arange(n.sum()))
            many = shorts[size[run[shorts]] > FEW]
            for group in np.split(many, np.flatnonzero(np.diff(run[many])) + 1):
                if not len(group):
                    continue
                lo, n = begin[run[group[0]]], size[run[group[0]]]
                for to in range(lo, lo + n, CELLS >> 5):
                    there = slice(to, min(to + (CELLS >> 5), lo + n))
                    step = max(1, CELLS // (there.stop - to))
                    for k in range(0, len(group), step):
                        mine = group[k : k + step]
                        # A little less is asked for, as the order of the sum is another.
                        s, t = np.nonzero(~(vectors[mine] @ vectors[there].T < (least_cosine - 1e-9) * (norm[mine][:, None] * norm[there])))
                        yield from out(mine[s], t + to)

    def run(batches: Batches) -> Batches:
        held, n = [], 0
        for batch in batches:
            new = np.flatnonzero(_changes(*(batch.column(c) for c in ("stem", "i", "j"))))
            if n + len(batch) >= ROWS and len(new) > 1:
                with np.errstate(all="ignore"):
                    yield from near(joined([*held, batch.slice(0, new[-1])]))
                held, n, batch = [], 0, batch.slice(new[-1])
            held.append(batch)
            n += len(batch)
        if n:
            with np.errstate(all="ignore"):
                yield from near(joined(held))

    def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(c) for b in batches]) for c in batches[0].schema.names], batches[0].schema.names)

    return units.mapInArrow(frugal(run), "a string, b string, cosine double")


def alike(rows: DataFrame, least_prefix: int, least_share: float, least_cosine: float) -> DataFrame:
    """(a, b, cosine) of words that share a prefix, ``least_share`` of the shorter one, and whose pooled vectors are near.

    ``rows``: (tokens, embedding) of each text: its distinct words, all of ``least_prefix`` letters at least.
    """
    spark = rows.sparkSession
    kind = np.float32 if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64
    rows = written(rows.where("embedding is not null").select("tokens", F.col("embedding").cast("array<float>" if kind is np.float32 else "array<double>").alias("embedding")))
    dim = rows.agg(F.max(F.size("embedding")).alias("dim")).first().dim or 0
    if not dim:
        return spark.createDataFrame([], "a string, b string, cosine double")
    most = max(1, BLOCK // (8 * dim))
    sizes = _sizes(rows, least_prefix).agg(F.sum("rows").alias("rows"), F.sum(F.when(F.col("rows") > most, F.col("rows") * F.ceil(F.col("rows") / most))).alias("again"), F.collect_list(F.when(F.col("rows") > most, F.struct("stem", "rows"))).alias("large")).first()
    sums = _sums(rows, dim, kind).withColumn("stem", F.substring("token", 1, least_prefix))
    if sizes.large:  # not more than all rows / most
        large = spark.createDataFrame([(r.stem, math.ceil(r.rows / most)) for r in sizes.large], "stem string, blocks int")
        sums = sums.join(F.broadcast(large), "stem", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        sums = sums.withColumn("block", F.pmod(F.xxhash64("token"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        units = sums.select("stem", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "token", "n", "v")
    else:
        units = sums.select("stem", *(F.lit(0).alias(c) for c in ("i", "j", "block")), "token", "n", "v")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(((sizes.rows or 0) + (sizes.again or 0)) / most))
    units = units.repartition(partitions, "stem", "i", "j").sortWithinPartitions("stem", "i", "j", "token")
    return _pairs(units, dim, kind, least_prefix, least_share, least_cosine)
