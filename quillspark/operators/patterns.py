"""Many terms in one pass over whole texts: one automaton over all of them, instead of a join of terms with texts.

A term is found where it stands between word borders, in lower case (A to Z only).  What each term keeps is its first few
texts by key; for labels that have several terms no more is needed, as ``first_contexts`` shows.

The automaton goes to every worker, so its size is checked: terms are counted first and cut into shards of
``SHARD_CHARS`` characters, each of which takes its own pass over the texts.

Null and empty texts and terms have no hits, rows without a key are not looked at, and rows that repeat a key are one text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.memory import frugal
from ..plans.shared import written

#: Characters of the terms of one automaton: some 100 MB in a worker.
SHARD_CHARS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)
#: Runs of word characters and what stands between them.
RUNS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"


def fold(text: Column) -> Column:
    """``text`` with A to Z as a to z and nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def words_and_pairs(text: Column, least: int) -> Column:
    """The different terms of a label: its words of ``least`` letters or more, and words with one blank between them."""
    runs = F.regexp_extract_all(fold(text), F.lit(RUNS), F.lit(0))
    words = F.filter(runs, lambda r: r.rlike(r"^[\p{L}\p{N}_]") & (F.length(r) >= least))
    pairs = F.transform(runs, lambda r, i: F.when((F.get(runs, i + 1) == " ") & F.get(runs, i + 2).isNotNull() & r.rlike(r"^[\p{L}\p{N}_]"), F.concat(r, F.lit(" "), F.get(runs, i + 2))))
    return F.array_distinct(F.concat(words, F.filter(pairs, lambda p: p.isNotNull())))


def _automaton(terms: list[str]):
    import ahocorasick

    made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, term in enumerate(terms):
        made.add_word(term, i)
    made.make_automaton()
    return made


def bordered(automaton, terms: list[str], text: str) -> dict[int, list[int]]:
    """{term: [occurrences, place of the first]} of one text."""
    found: dict[int, list[int]] = {}
    low = text.lower() if text.isascii() else text.translate(_FOLD)
    size = len(low)
    for last, i in automaton.iter(low):
        start, after = last + 1 - len(terms[i]), last + 1
        if start and (low[start - 1].isalnum() or low[start - 1] == "_"):
            continue
        if after < size and (low[after].isalnum() or low[after] == "_"):
            continue
        hit = found.get(i)
        if hit is None:
            found[i] = [1, start]
        else:
            hit[0] += 1
    return found


class _Walk:
    """One task: all its texts through one automaton; of each term the ``k`` smallest keys are kept."""

    def __init__(self, terms, k: int, schema: pa.Schema) -> None:
        self.terms, self.k, self.schema = terms, k, schema

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = self.terms.value
        if not terms:
            return
        automaton = _automaton(terms)
        kept: dict[int, dict[object, list[int]]] = {}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for i, (n, place) in bordered(automaton, terms, text.as_py()).items():
                    of = kept.setdefault(i, {})
                    if key in of:
                        of[key] = [of[key][0] + n, min(of[key][1], place)]
                    elif len(of) < self.k:
                        of[key] = [n, place]
                    elif key < (most := max(of)):
                        del of[most]
                        of[key] = [n, place]
        rows = [(terms[i], key, n, place) for i, of in kept.items() for key, (n, place) in of.items()]
        for at in range(0, len(rows), 50_000):
            columns = zip(*rows[at : at + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def first_hits(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str, k: int = 3, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(term, key, n, place): the first ``k`` texts by key that show each term, how often, and where first (characters before it).

    Keys are whole numbers.  Terms are folded as texts are, so terms that differ in case only are one.
    """
    spark = texts.sparkSession
    wanted = written(terms.select(fold(F.col(term)).alias("term")).where("term <> ''").distinct())
    chars = wanted.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).head()[0]
    shards = max(1, math.ceil(chars / shard_chars))
    rows = texts.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where("key is not null and text <> ''")
    schema = pa.schema([("term", pa.string()), ("key", pa.int64()), ("n", pa.int64()), ("place", pa.int64())])
    found = None
    for shard in range(shards):
        part = wanted if shards == 1 else wanted.where(F.pmod(F.xxhash64("term"), F.lit(shards)) == shard)
        held = spark.sparkContext.broadcast(sorted(r[0] for r in part.collect()))  # at most about shard_chars characters
        one = rows.mapInArrow(frugal(_Walk(held, k, schema)), "term string, key bigint, n bigint, place bigint")
        if shards > 1:
            one = written(one)
            held.destroy()
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("term").orderBy("key")
    sums = found.groupBy("term", "key").agg(F.sum("n").alias("n"), F.min("place").alias("place"))
    return sums.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def first_contexts(texts: DataFrame, key: str, text: str, labels: DataFrame, item: str, terms: Column, k: int = 3, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(item, key, n_terms, n_hits, first_term, r): the first ``k`` texts that show any term of a label.

    A label's first ``k`` texts are among the first ``k`` of each of its terms that they show: were there ``k`` smaller ones
    for a term, they would come before.  So counts over what ``first_hits`` keeps are those over all texts.
    """
    of = labels.select(F.col(item).alias("item"), F.explode(terms).alias("term")).where("item is not null and term <> ''").select("item", fold(F.col("term")).alias("term")).distinct()
    hits = first_hits(texts, key, text, of, "term", k, shard_chars).join(of, "term")
    counts = hits.groupBy("item", "key").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("n").alias("n_hits"), F.min("term").alias("first_term"))
    order = Window.partitionBy("item").orderBy("key")
    return counts.withColumn("r", F.row_number().over(order).cast("bigint")).where(F.col("r") <= k)
