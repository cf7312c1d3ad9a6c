"""The words of texts, told apart and counted in Arrow in the row of their text, so that no row per word is shuffled.

Rows (idx, new, old) go in, one per text, ids distinct.  Words are runs of letters in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.memory import frugal

Batches = Iterator[pa.RecordBatch]
#: Texts that are looked at together.
TEXTS = 1024
SIDES = ("new", "old")
NO_LETTERS = r"\PL+"


def _words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words, and in the text of which number each is."""
    texts = pc.fill_null(texts, "")
    lists = pc.split_pattern_regex(pc.utf8_lower(texts) if lower else texts, pattern=NO_LETTERS)
    words, at = lists.flatten(), np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
    some = pc.not_equal(words, "")  # before and after the first and the last word
    return words.filter(some), at[np.asarray(some)]


def pieces(batches: Batches) -> Batches:
    for batch in batches:
        for first in range(0, len(batch), TEXTS):
            yield batch.slice(first, TEXTS)


def _runs(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers in order, and how often each is there."""
    numbers = np.sort(numbers)
    starts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])) if len(numbers) else np.zeros(0, np.int64)
    return numbers[starts], np.diff(np.append(starts, len(numbers)))


def _given(sides: DataFrame) -> DataFrame:
    return sides.select(F.col("idx").cast("bigint").alias("idx"), *SIDES)


def counted(sides: DataFrame, keep: list[str] | None = None, apart: bool = True) -> DataFrame:
    """Rows (token, idx, translation, cnt, dl), of some tokens only if they are given; dl is the number of words of the text, on both sides.

    If sides are not told apart, a token of a text has one row, with no matter which of them.
    """

    def run(batches: Batches) -> Batches:
        wanted = None if keep is None else pa.array(keep, pa.string())
        for part in pieces(batches):
            words, places, dl = [], [], np.zeros(len(part), np.int64)
            for side in range(len(SIDES)):
                mine, at = _words(part.column(side + 1))
                dl += np.bincount(at, minlength=len(part))
                if wanted is not None:
                    some = pc.is_in(mine, value_set=wanted)
                    mine, at = mine.filter(some), at[np.asarray(some)]
                words.append(mine)
                places.append(at * len(SIDES) + (side if apart else 0))
            coded = pa.concat_arrays(words).dictionary_encode()
            size = max(1, len(coded.dictionary))
            found, n = _runs(np.concatenate(places) * size + np.asarray(coded.indices))
            place, code = found // size, found % size
            text = place // len(SIDES)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code)), part.column(0).take(pa.array(text)), pa.array(SIDES).take(pa.array(place % len(SIDES))), pa.array(n, pa.int64()), pa.array(dl[text])], ["token", "idx", "translation", "cnt", "dl"])

    return _given(sides).mapInArrow(frugal(run), "token string, idx bigint, translation string, cnt bigint, dl bigint")


def sums(sides: DataFrame) -> DataFrame:
    """Rows (token, df, dl): in how many texts a token is; the dl add up to the number of all words."""

    def run(batches: Batches) -> Batches:
        for part in pieces(batches):
            (a, at), (b, bt) = (_words(part.column(side + 1)) for side in range(len(SIDES)))
            coded = pa.concat_arrays([a, b]).dictionary_encode()
            size = max(1, len(coded.dictionary))
            found, _ = _runs(np.concatenate([at, bt]) * size + np.asarray(coded.indices))
            dl = np.zeros(len(coded.dictionary), np.int64)
            dl[:1] = len(coded)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(found % size, minlength=len(dl))[: len(dl)].astype(np.int64)), pa.array(dl)], ["token", "df", "dl"])

    return _given(sides).mapInArrow(frugal(run), "token string, df bigint, dl bigint").groupBy("token").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl"))


def by_text(sides: DataFrame) -> DataFrame:
    """Rows (idx, token, tf, new), those of a text together: how often a token is in it, and how often on its new side."""

    def run(batches: Batches) -> Batches:
        for part in pieces(batches):
            (a, at), (b, bt) = (_words(part.column(side + 1)) for side in range(len(SIDES)))
            coded = pa.concat_arrays([a, b]).dictionary_encode()
            size = max(1, len(coded.dictionary))
            places = np.concatenate([at, bt]) * size + np.asarray(coded.indices)
            found, n = _runs(places)
            first, m = _runs(places[: len(a)])
            new = np.zeros(len(found), np.int64)
            new[np.searchsorted(found, first)] = m
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(found // size)), coded.dictionary.take(pa.array(found % size)), pa.array(n, pa.int64()), pa.array(new)], ["idx", "token", "tf", "new"])

    return _given(sides).mapInArrow(frugal(run), "idx bigint, token string, tf bigint, new bigint")


def cased(sides: DataFrame, kept: str) -> DataFrame:
    """Rows (idx, word, the columns of the schema ``kept``, translation, cnt), those of a text together, of its words as they are written."""
    names = [c.split()[0] for c in kept.split(", ")]

    def run(batches: Batches) -> Batches:
        for part in pieces(batches):
            for side, translation in enumerate(SIDES):
                words, at = _words(part.column(side + 1), lower=False)
                coded = words.dictionary_encode()
                size = max(1, len(coded.dictionary))
                found, n = _runs(at * size + np.asarray(coded.indices))
                text = pa.array(found // size)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(text), coded.dictionary.take(pa.array(found % size)), *(part.column(c).take(text) for c in names), pa.repeat(translation, len(found)), pa.array(n, pa.int64())], ["idx", "word", *names, "translation", "cnt"]
                )

    given = sides.select(F.col("idx").cast("bigint").alias("idx"), *SIDES, *names)
    return given.mapInArrow(frugal(run), f"idx bigint, word string, {kept}, translation string, cnt bigint")


def told_apart(sides: DataFrame, least: int, kept: str) -> DataFrame:
    """Rows (tokens, the columns of the schema ``kept``), one of a text: its distinct tokens of so many letters at least, on both sides."""
    names = [c.split()[0] for c in kept.split(", ")]

    def run(batches: Batches) -> Batches:
        for part in pieces(batches):
            (a, at), (b, bt) = (_words(part.column(side)) for side in range(len(SIDES)))
            words, at = pa.concat_arrays([a, b]), np.concatenate([at, bt])
            some = pc.greater_equal(pc.utf8_length(words), least)
            coded, at = words.filter(some).dictionary_encode(), at[np.asarray(some)]
            size = max(1, len(coded.dictionary))
            found, _ = _runs(at * size + np.asarray(coded.indices))
            ends = np.append(0, np.cumsum(np.bincount(found // size, minlength=len(part))))
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), coded.dictionary.take(pa.array(found % size)))
            yield pa.RecordBatch.from_arrays([tokens, *(part.column(c) for c in names)], ["tokens", *names])

    return sides.select(*SIDES, *names).mapInArrow(frugal(run), f"tokens array<string>, {kept}")
