"""Phrases by positional postings: no text is read.

A word here is a run of word characters, as the border before a phrase sees them.  A row of
``positions`` holds the occurrences of a word in one text: their places among the words of the text, each as its
distance from the one before (the first from -1), and what stands after each up to the next word.  A row covers
``BLOCK`` words of a text, so it stays small in a text of any length.  The ids of texts are distinct.

A phrase is its words and what stands between them.  All but the last word must be whole words; the last one is a
prefix, as suffixes count, unless signs follow it.  Occurrences of the words meet in one equi-join, as a
grouping on (text, place of the word minus its place in the phrase), whatever the number of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.memory import frugal
from .bags import pieces

BLOCK = 1024
#: Word characters, as ``(?U)\\w`` has them: letters, marks, digits, connectors, joiners, and enclosed letters, which are alphabetic too.
SIGNS = r"\p{L}\p{M}\p{Nl}\p{Nd}\p{Pc}\x{200C}\x{200D}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}"


def positions(sides: DataFrame) -> DataFrame:
    """Rows (token, idx, translation, steps array<int>, gaps array<string>) from rows (idx, translation, text); made in Arrow in the row of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            texts = pc.fill_null(part.column("text"), "")
            words = pc.split_pattern_regex(texts, pattern=f"[^{SIGNS}]+").flatten()
            words = words.filter(pc.not_equal(words, ""))  # before and after the first and the last word
            gaps = pc.split_pattern_regex(texts, pattern=f"[{SIGNS}]+")  # before the first word, then after each
            n = np.asarray(pc.list_value_length(gaps)) - 1
            text, pos = np.repeat(np.arange(len(part)), n), np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
            coded = words.dictionary_encode()
            size, blocks = max(1, len(coded.dictionary)), n.max(initial=0) // BLOCK + 1
            key = (text * blocks + pos // BLOCK) * size + np.asarray(coded.indices)
            order = np.argsort(key, kind="stable")
            key, pos = key[order], pos[order]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            steps = np.diff(pos, prepend=-1)
            steps[starts] = pos[starts] + 1
            ends = pa.array(np.append(starts, len(key)), pa.int32())
            after = np.arange(len(words)) + text + 1  # without what stands before the first word of each text
            held = pa.ListArray.from_arrays(ends, pa.array(steps, pa.int32())), pa.ListArray.from_arrays(ends, gaps.flatten().take(pa.array(after[order])))
            place = pa.array(text[order][starts])
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(key[starts] % size)), part.column("idx").take(place), part.column("translation").take(place), *held], ["token", "idx", "translation", "steps", "gaps"])

    given = sides.select(F.col("idx").cast("bigint").alias("idx"), "translation", F.lower("text").alias("text"))
    return given.mapInArrow(frugal(run), "token string, idx bigint, translation string, steps array<int>, gaps array<string>")


def _places(steps: Column) -> Column:
    """The places again: running sums of the distances."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(-1).alias("at"))
    return F.aggregate(steps, start, lambda acc, x: F.struct(F.array_append(acc["out"], acc["at"] + x).alias("out"), (acc["at"] + x).alias("at")))["out"]


@dataclass(frozen=True)
class Phrase:
    """Words, what stands after each but the last, and what stands after that (none: it is a prefix)."""

    words: tuple[str, ...]
    gaps: tuple[str, ...]
    tail: str

    @classmethod
    def parse(cls, phrase: str) -> Phrase:
        pieces = re.findall(r"(\w+)(\W*)", phrase.lower())
        if not pieces or not re.match(r"\w", phrase):
            raise ValueError("a phrase begins with a word")
        return cls(tuple(w for w, _ in pieces), tuple(g for _, g in pieces[:-1]), pieces[-1][1])

    @property
    def overlaps(self) -> bool:
        """May one occurrence begin inside of another?  Then those that do are left out, from the left."""
        n = len(self.words)
        return any(all(self.words[k + i] == self.words[i] or k + i == n - 1 and self.words[i].startswith(self.words[k + i]) for i in range(n - k)) for k in range(1, n))

    def wanted(self) -> Column:
        """The tokens that the phrase needs: a filter that the statistics of sorted files answer."""
        last = self.words[-1]
        rest = F.col("token").isin(list(dict.fromkeys(self.words[:-1] if not self.tail else self.words)))
        return rest if self.tail else (rest | F.startswith("token", F.lit(last)) if len(self.words) > 1 else F.startswith("token", F.lit(last)))

    def fits(self, token: Column, gap: Column) -> Column:
        """The places in the phrase that an occurrence can have."""
        last = len(self.words) - 1
        fit = [F.when((token == w) & (gap == g), F.lit(i)) for i, (w, g) in enumerate(zip(self.words[:last], self.gaps, strict=True))]
        ending = (token == self.words[last]) & F.startswith(gap, F.lit(self.tail)) if self.tail else F.startswith(token, F.lit(self.words[last]))
        return F.array_compact(F.array(*fit, F.when(ending, F.lit(last))))


def phrase_counts(postings: DataFrame, phrase: str) -> DataFrame:
    """Rows (idx, translation, n): how often a phrase occurs in each text that has it."""
    wanted = Phrase.parse(phrase)
    n = len(wanted.words)
    each = postings.where(wanted.wanted()).select("token", "idx", "translation", F.explode(F.arrays_zip(_places(F.col("steps")).alias("pos"), F.col("gaps").alias("gap"))).alias("at"))
    hits = each.select("idx", "translation", "at.pos", F.explode(wanted.fits(F.col("token"), F.col("at.gap"))).alias("place"))
    starts = hits.groupBy("idx", "translation", (F.col("pos") - F.col("place")).alias("start")).agg(F.count(F.lit(1)).alias("found")).where(F.col("found") == n)
    if not wanted.overlaps:
        return starts.groupBy("idx", "translation").agg(F.count(F.lit(1)).alias("n"))
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-n).alias("last"))
    counted = F.aggregate(F.array_sort(F.collect_list("start")), none, lambda acc, x: F.when(x >= acc["last"] + n, F.struct((acc["n"] + 1).alias("n"), x.alias("last"))).otherwise(acc))
    return starts.groupBy("idx", "translation").agg(counted["n"].alias("n"))


def matches(postings: DataFrame, verses: DataFrame, phrase: str, translation: str = "both") -> DataFrame:
    """What a scan of the texts for the phrase finds: (idx, book_slug, chapter, verse, exact_count, total_count)."""
    used = postings if translation == "both" else postings.where(F.col("translation") == translation)
    counted = phrase_counts(used, phrase).groupBy("idx").agg(F.sum("n").alias("total_count"))
    return counted.join(verses, "idx").select("idx", "book_slug", "chapter", "verse", F.col("total_count").alias("exact_count"), "total_count")
