"""Operator 11: audit of how the sources of a language differ in their terms.

A term is a run of letters (A-Z, a-z and all that is not ASCII), of which A-Z are lower-cased.  A language keeps
the terms that ``LEAST_DOCS`` of its documents have.  With ``count`` its occurrences there, every group (language,
source), and every language, gives a kept term the smoothed share
``p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))``.

1. Tasks count (language, source, term) of their texts, merged in bounded tables before anything is shuffled.
2. The counts are dealt by hash of (language, term) to shards, as many to a partition as their number asks for.  DuckDB
   adds them up by vectorised SQL in each shard and keeps the terms that are frequent enough.
3. Spark adds up ``N`` and ``V``, and deals them to the shards that have terms of the language.
4. In each shard DuckDB makes ``p``, the first ``TOP`` terms of every group, and partial sums for the pairs of sources.  With
   ``z`` for the share of a term that a group has not, the sum of ``|p - q|`` over all kept terms is
   ``V |z - z'|``, and for each term of one side ``|p - z'| - |z - z'|`` more, and for each of both sides
   ``|p - q| - |p - z'| - |z - q| + |z - z'|`` more.  So only terms that a source has cost work: those
   of one side by their distinct ``p``, those of both sides in one join.
5. Spark merges the sums and the rankings.

Defined results: a null or empty language or source is one named '', a null text has no terms; a group
without terms still has its rows of part ``pair``; a language with one source has none; a language
without kept terms (V = 0) gives its pairs the value 0; ties are ranked by the item's bytes; repeated rows are documents of
their own; all arithmetic is on integers (of 128 bits where products need them); other columns are not read; an
empty table gives an empty table; texts of any length are counted whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.memory import frugal
from ..plans.shared import written
from .bpe import take_spans
from .textscan import LOWER, Chunk, chunks

LEAST_DOCS, TOP, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
#: Rows of counts that a task holds, and that a shard has on average.
HELD, SHARD = 400_000, 1_000_000
_COUNTS = "lang string, source string, term string, docs bigint, n bigint"
_KEPT = "shard int, lang string, source string, term string, n bigint"
_PARTS = "kind string, lang string, source string, item string, value bigint"

Batched = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def _terms(chunk: Chunk) -> tuple[pa.Array, np.ndarray]:
    """All terms of a chunk in order, and the row of each."""
    inside = _TERM[chunk.buf]
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    begins = chunk.offsets[:-1][chunk.lengths > 0]
    before[begins] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[begins[begins > 0] - 1] = False
    lens = np.flatnonzero(inside & ~after) + 1 - starts
    data = LOWER[take_spans(chunk.buf, starts, lens)] if len(starts) else np.zeros(0, np.uint8)
    where = np.append(0, np.cumsum(lens)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(data))), chunk.row_of(starts)


def _counted(chunk: Chunk, groups: np.ndarray, names: pa.StructArray) -> pa.Table:
    """Rows (lang, source, term, docs, n) of a chunk; ``groups``: the group of each row."""
    terms, row = _terms(chunk)
    coded = terms.dictionary_encode()
    code, size = np.asarray(coded.indices).astype(np.int64), max(1, len(coded.dictionary))
    pair, times = np.unique(row * size + code, return_counts=True)  # one for each document
    key, back, docs = np.unique(groups[pair // size] * size + pair % size, return_inverse=True, return_counts=True)
    n = np.bincount(back, times, len(key)).astype(np.int64)
    own = names.take(pa.array(key // size))
    return pa.table([own.field(0), own.field(1), coded.dictionary.take(pa.array(key % size)), pa.array(docs.astype(np.int64)), pa.array(n)], ["lang", "source", "term", "docs", "n"])


def _merged(tables: list[pa.Table]) -> pa.Table:
    both = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("docs", "sum"), ("n", "sum")])
    return both.rename_columns(["lang", "source", "term", "docs", "n"]).combine_chunks()


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, docs, n), several for one term, and one with an empty term for each group that a task saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for batch in batches:
            both = [batch.column(i).dictionary_encode() for i in range(2)]
            wide = max(1, len(both[1].dictionary))
            pair, group = np.unique(np.asarray(both[0].indices).astype(np.int64) * wide + np.asarray(both[1].indices), return_inverse=True)
            names = pa.StructArray.from_arrays([both[0].dictionary.take(pa.array(pair // wide)), both[1].dictionary.take(pa.array(pair % wide))], ["lang", "source"])
            new = [(g["lang"], g["source"]) for g in names.to_pylist() if (g["lang"], g["source"]) not in seen]
            seen.update(new)
            if new:
                yield pa.RecordBatch.from_pylist([{"lang": a, "source": b, "term": "", "docs": 0, "n": 0} for a, b in new], pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("n", pa.int64())]))
            for chunk in chunks(batch.column(2)):
                held.append(_counted(chunk, group[chunk.first : chunk.first + len(chunk)], names))
                size += len(held[-1])
                if size >= HELD:
                    held = [_merged(held)]
                    size = len(held[0])
                    if size >= HELD // 2:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if size:
            yield from _merged(held).to_batches()

    picked = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return picked.mapInArrow(frugal(run), _COUNTS)


def _duck(**tables: pa.Table):
    """A DuckDB of this task alone, in memory and on one core."""
    import duckdb

    con = duckdb.connect(config={"threads": 1})
    for name, table in tables.items():
        con.register(name, table)
    return con


_SUMS = f"""
select lang, source, term, sum(n)::bigint as n from counts
semi join (select lang, term from counts group by lang, term having sum(docs) >= {LEAST_DOCS}) using (lang, term)
group by lang, source, term"""


def _kept_terms(counts: DataFrame, parts: int, each: int) -> DataFrame:
    """Step 2: rows (shard, lang, source, term, n) of the kept terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        with _duck(counts=pa.Table.from_batches(got)) as con:
            found = con.sql(f"select {got[0].column(0)[0].as_py()}::int as shard, * from ({_SUMS})").to_arrow_table()
        yield from found.cast(pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())])).to_batches()

    return _by_shard(counts.select(_shard(parts, each), "*"), parts).mapInArrow(frugal(_one_shard(run)), _KEPT)


def _by_shard(rows: DataFrame, parts: int) -> DataFrame:
    """Rows with a shard as their first column, dealt so that a partition has whole shards, one after another."""
    return rows.repartition(parts, "lang", "term").sortWithinPartitions("shard")


def _shard(parts: int, each: int) -> Column:
    """The shard of a (lang, term): ``each`` of them to the partition that Spark deals it to."""
    return (F.pmod(F.hash("lang", "term"), F.lit(parts)) * each + F.pmod(F.xxhash64("lang", "term"), F.lit(each))).cast("int").alias("shard")


def _one_shard(run: Batched) -> Batched:
    """``run`` for the batches of each shard in turn; they come sorted by their first column."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            shard = np.asarray(batch.column(0))
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held and shard[a] != now:
                    yield from run(iter(held))
                    held = []
                now = shard[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from run(iter(held))

    return task


def _share(n: str, group: str) -> str:
    return f"(1 + ({SCALE}::hugeint * ({n} + {SMOOTH})) // ({group}.total + {SMOOTH} * {group}.v))::bigint"


#: Step 4, in each shard: ``counts`` (lang, source, term, n), ``facts`` (lang, source, total, v, lang_total).
_SHARED = f"""
create table own as select c.lang, c.source, c.term, c.n, {_share("c.n", "f")} as p, {_share("0", "f")} as z
from counts c join facts f on c.lang = f.lang and c.source = f.source;
create table whole as select t.lang, t.term, (1 + ({SCALE}::hugeint * (t.n + {SMOOTH})) // (f.total + {SMOOTH} * f.v))::bigint as q
from (select lang, term, sum(n)::bigint as n from counts group by all) t
join (select lang, max(lang_total) as total, max(v) as v from facts group by lang) f on t.lang = f.lang"""
_TOP_TERMS = f"""
select 'term' as kind, lang, source, term as item, value from (
  select o.lang, o.source, o.term, o.p - w.q as value, row_number() over (partition by o.lang, o.source order by o.p - w.q desc, o.term) as r
  from own o join whole w on o.lang = w.lang and o.term = w.term where o.p > w.q)
where r <= {TOP}"""
_ONE_SIDE = f"""
select 'one' as kind, h.lang, h.source, f.source as item, sum(h.k * (abs(h.p - f.z) - abs(h.z - f.z)))::bigint as value
from (select lang, source, p, z, count(*) as k from own group by all) h
join (select lang, source, {_share("0", "facts")} as z from facts) f on h.lang = f.lang and h.source <> f.source group by all"""
_BOTH_SIDES = """
select 'both' as kind, a.lang, a.source, b.source as item, sum(abs(a.p - b.p) - abs(a.p - b.z) - abs(a.z - b.p) + abs(a.z - b.z))::bigint as value
from own a join own b on a.lang = b.lang and a.term = b.term and a.source < b.source group by all"""


def _partial_sums(kept: DataFrame, facts: DataFrame, parts: int) -> DataFrame:
    """Step 4: rows (kind, lang, source, item, value) of every shard."""
    schema = pa.schema([("kind", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        is_fact = pc.is_valid(rows["v"])
        counts, known = rows.filter(pc.invert(is_fact)), rows.filter(is_fact).rename_columns(["shard", "lang", "source", "term", "total", "v", "lang_total"])
        with _duck(counts=counts, facts=known) as con:
            con.execute(_SHARED)
            for query in (_TOP_TERMS, _ONE_SIDE, _BOTH_SIDES):
                yield from con.sql(query).to_arrow_table().cast(schema).to_batches()

    none = F.lit(None).cast("bigint")
    # Any term of the language leads its facts to the shard's partition.
    there = kept.groupBy("shard", "lang").agg(F.min("term").alias("term")).join(facts, "lang").select("shard", "lang", "source", "term", F.col("total").alias("n"), "v", "lang_total")
    both = kept.select("shard", "lang", "source", "term", "n", none.alias("v"), none.alias("lang_total")).unionByName(there)
    return _by_shard(both, parts).mapInArrow(frugal(_one_shard(run)), _PARTS)


def audit(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, part, item, value, rank)."""
    spark = docs.sparkSession
    counts = written(term_counts(docs))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = max(1, -(-counts.count() // (SHARD * parts)))
    kept = written(_kept_terms(counts.where("term <> ''"), parts, each))
    groups = counts.where("term = ''").select("lang", "source").distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    terms = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    facts = groups.join(sums, ["lang", "source"], "left").join(of_lang, "lang", "left").join(terms, "lang", "left")
    facts = written(facts.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total", "v", "lang_total"))))
    partial = written(_partial_sums(kept, facts.where("v > 0"), parts))

    places = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = partial.where("kind = 'term'").withColumn("rank", F.row_number().over(places)).where(F.col("rank") <= TOP)
    zero = F.when(F.col("v") > 0, F.expr(f"1 + {SCALE * SMOOTH} div (total + {SMOOTH} * v)")).otherwise(0)
    mine = facts.select("lang", "source", "v", zero.alias("z"))
    theirs = mine.select("lang", F.col("source").alias("item"), F.col("z").alias("other"))
    base = mine.join(theirs, "lang").where("source <> item").select("lang", "source", "item", (F.col("v") * F.abs(F.col("z") - F.col("other"))).alias("value"))
    summed = partial.where("kind <> 'term'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))  # over the shards, before both directions are made
    found = summed.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("pair"), "value")
    pairs = base.unionByName(found.select("lang", "pair.*", "value")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(places))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(out).unionByName(top.withColumn("part", F.lit("term")).select(out))


#: DuckDB SQL for ``audit``.
ORACLE = r"""
with docs as (select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
words as (
  select d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term from words group by all having count(distinct d) >= 30),
counts as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by all),
groups as (select distinct lang, source from docs),
sizes as (
  select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as total, (select count(*) from kept k where k.lang = g.lang)::hugeint as v
  from groups g left join counts c using (lang, source) group by all),
shares as (
  select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (s.total + 5 * s.v) as p
  from sizes s join kept k using (lang) left join counts c on c.lang = s.lang and c.source = s.source and c.term = k.term),
langs as (
  select lang, term, 1 + (1000000000::hugeint * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) as q
  from counts join (select lang, sum(total)::hugeint as total, max(v) as v from sizes group by lang) using (lang) group by all),
sums as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
tops as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from shares join langs using (lang, term) where n > 0 and p > q)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from (select * from pairs union all select * from tops) qualify part = 'pair' or rank <= 50
"""
