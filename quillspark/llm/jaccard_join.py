"""Operator 6: n-gram Jaccard join by a grouped prefix join.

Texts whose shingle sets agree form one class; only classes are compared.

1. Of texts with the same words one is chosen (``copy``).  Its shingles are counted by hash
   range, summed within each task first; those that occur in several such texts are kept with their
   counts as sorted arrays in the shared folder.  What occurs in one text only can be
   in no intersection.
2. Every text looks its shingles up: a class knows its set size, its shared shingles and
   their rarity.  The prefix of a set of n shingles has n - ceil(t n) + 1 of them,
   rarest first; the unique ones come before all others, and a class whose prefix
   holds unique ones only can link with nothing.  No posting travels, so a shingle that
   very many texts share is no more work for any task than another.
3. Classes with the same size and prefix form a group; groups are indexed by their
   prefix shingles.  Within a group the members are compared with its lead.  Each posting list
   then pairs the leads of its groups with one pivot, the group whose shingles are most widely
   shared; then its groups that are still apart with a random one; then, in lists that still hold several
   components, all groups that are apart.  Pairs of groups pass size and overlap
   filters and are expanded to those members that are apart; pairs of members pass the same filters and
   that of the bitmaps and are verified on the whole sets.  Every pair of classes that is similar is thus either
   verified or already connected, so components are exact.
4. All links lie within components.  To count them the classes of a component are cut
   into blocks, and each pair of blocks is a unit of work of its own, in which all pairs
   are verified at once; what leaves it are sums by class.  ``near_links`` returns the pairs themselves.  This work grows with the
   square of a component, as exact counts demand.

Defined results: ``n_shingles`` 0 (null, empty or blank text) links with nothing;
a text of fewer words than a shingle counts as one shingle; repeated rows and texts
with equal sets fall into one component; a null id is never a component's name
unless no other id is there; other columns are not read; an empty table gives an
empty table; texts of any length are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import connected_components
from ..plans.memory import frugal
from ..plans.shared import unused, written
from .blocks import blocks_batch, pack
from .ranges import Ranges, flushed
from .textscan import Chunk, chunks, mix, row_runs, run_hashes, span_hashes

WIDTH = 5
PERCENT = 75
#: 64-bit words of a set's parity bitmap.
PARITY_WORDS = 16
#: Classes in a block of a component, and shingles of which a unit of work counts at once.
BLOCK, COLUMNS = 512, 4096
_U = np.uint64


# -- shingles ---------------------------------------------------------------------------


Words = tuple[np.ndarray, np.ndarray]


def words_of(chunk: Chunk) -> Words:
    """Hash (A-Z lower-cased) and row of every word."""
    starts, ends = chunk.words()
    return span_hashes(chunk.lower(), starts, ends), chunk.row_of(starts)


def shingle_sets(n: int, words: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash) of the distinct shingles of ``n`` rows, in row order, and every row's set size."""
    hashed, rows = words
    whole = row_runs(rows, width)
    hashes, owner = run_hashes(hashed, width)[whole], rows[: len(whole)][whole]
    counts = np.bincount(rows, minlength=n)
    for few in range(1, width):  # a short text is one shingle
        short = np.flatnonzero(counts == few)
        if len(short):
            first = np.searchsorted(rows, short)
            hashes = np.append(hashes, mix(run_hashes(hashed, few)[first] + _U(few)))
            owner = np.append(owner, short)
    _, at = np.unique(mix(hashes) + owner.astype(_U) * _U(0x9E3779B97F4A7C15), return_index=True)
    at = at[np.argsort(owner[at], kind="stable")]
    hashes, owner = hashes[at], owner[at]
    return owner, hashes, np.bincount(owner, minlength=n)


def set_keys(owner: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name of every row's set, whatever the order of its members."""
    total = np.zeros(len(sizes), _U)
    if len(owner):
        filled = np.flatnonzero(sizes)
        first = np.cumsum(sizes[filled]) - sizes[filled]
        total[filled] = np.add.reduceat(mix(hashes ^ _U(0xA0761D6478BD642F)), first)
    return mix(total + sizes.astype(_U))


def copy_keys(n: int, words: Words) -> np.ndarray:
    """A 64-bit name of the words, in their order, of each of ``n`` rows."""
    hashed, rows = words
    counts = np.bincount(rows, minlength=n)
    first = np.cumsum(counts) - counts
    out = np.zeros(n, _U)
    if len(hashed):
        place = np.arange(len(hashed)) - np.repeat(first, counts)
        filled = np.flatnonzero(counts)
        out[filled] = np.add.reduceat(mix(hashed + mix(place.astype(_U) + _U(1))), first[filled])
    return mix(out + counts.astype(_U))


def row_mark(docs: DataFrame) -> Column:
    """A 64-bit hash of a row's columns, but for those with maps, which have no hash."""
    return F.xxhash64(*(F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))


def _chosen(texts: DataFrame, found: Ranges) -> None:
    """Keep, for words that several rows have, which row (mark) stands for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                yield pa.RecordBatch.from_arrays([pa.array(copy_keys(len(chunk), words_of(chunk)).view(np.int64)), batch.column(1).slice(chunk.first, len(chunk))], ["copy", "mark"])

    copies = texts.mapInArrow(frugal(run), "copy bigint, mark bigint")
    several = copies.groupBy("copy").agg(F.min("mark").alias("mark"), F.count(F.lit(1)).alias("times")).where("times > 1")
    found.table(several.select("copy", "mark"), "copy", "copy_mark")


def _stands(words: Words, marks: np.ndarray, found: Ranges) -> np.ndarray:
    """Mask of the rows that stand for their words."""
    keys, out = copy_keys(len(marks), words), np.ones(len(marks), bool)
    order = np.argsort(keys)
    for p, here, place, hit in found.places("copy", keys[order]):
        rows = order[here][hit]
        out[rows] = found.store.get("copy_mark", p)[place[hit]] == marks[rows]
    return out


def _count_shingles(texts: DataFrame, found: Ranges, width: int) -> None:
    """Step 1: keep the shingles of several chosen texts with their counts."""

    def scan(chunk: Chunk, batch: pa.RecordBatch) -> tuple:
        words = words_of(chunk)
        mine = _stands(words, np.asarray(batch.column(1))[chunk.first : chunk.first + len(chunk)], found)[words[1]]
        return (shingle_sets(len(chunk), (words[0][mine], words[1][mine]), width)[1],)

    def flush(held: list) -> pa.RecordBatch:
        hashes, times = np.unique(np.concatenate([h[0] for h in held]), return_counts=True)
        return found.blocks([hashes, times.astype(np.uint8 if times.max(initial=0) < 256 else np.uint32)])

    def several(got: list) -> list[np.ndarray]:
        hashes, times = np.concatenate([x[0] for x in got]), np.concatenate([x[1].astype(np.int64) for x in got])
        order = np.argsort(hashes)
        hashes, times = hashes[order], times[order]
        edge = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)])
        times = np.add.reduceat(times, edge) if len(edge) else times
        return [hashes[edge][times > 1], np.minimum(times[times > 1], 2**32 - 1).astype(np.uint32)]

    found.keep(flushed(texts, scan, flush), several, "shingle", "times")


def _parity(members: np.ndarray) -> np.ndarray:
    """Bitmap in which each member flips one bit: two bitmaps differ in no more bits than their sets in members."""
    bit = mix(members ^ _U(0x8CB92BA72F3D8DD7)) % _U(64 * PARITY_WORDS)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


ROW = "doc_id bigint, mark bigint, n_shingles bigint, class bigint"
PROFILE = "shared bigint, parity array<bigint>, spread double, signature bigint, prefix array<bigint>, members binary"


def _profiled(texts: DataFrame, found: Ranges, width: int, percent: int) -> DataFrame:
    """Step 2: ``ROW`` for every row, and for a chosen one whose class may link ``PROFILE`` (``members``: its shared shingles, ascending)."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    names = [f.strip().split(" ")[0] for f in f"{ROW}, {PROFILE}".split(",")]

    def profile(n: int, hashes: np.ndarray, times: np.ndarray) -> tuple | None:
        """``hashes``: the shared shingles by rarity."""
        need = -(-percent * n // 100)
        indexed = (n - need + 1) - (n - len(hashes))
        if len(hashes) < need or indexed <= 0:
            return None
        prefix = hashes[:indexed]
        signature = mix(np.array([mix(prefix).sum(dtype=_U) + _U(n)], _U)).view(np.int64)[0]
        return len(hashes), _parity(hashes), float(times.mean() * len(hashes) / n), int(signature), prefix.view(np.int64), np.sort(hashes).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                here = (chunk.first, len(chunk))
                marks = batch.column(1).slice(*here)
                words = words_of(chunk)
                owner, hashes, sizes = shingle_sets(len(chunk), words, width)
                mine = np.flatnonzero(_stands(words, np.asarray(marks), found)[owner])
                owner_, hashes_ = owner[mine], hashes[mine]
                times = found.values("shingle", "times", hashes_, 0)
                shared = times > 0
                owner_, hashes_, times = owner_[shared], hashes_[shared], times[shared]
                order = np.lexsort((hashes_, times, owner_))
                owner_, hashes_, times = owner_[order], hashes_[order], times[order]
                edge = np.searchsorted(owner_, np.arange(len(chunk) + 1))
                found_ = [profile(int(sizes[i]), hashes_[edge[i] : edge[i + 1]], times[edge[i] : edge[i + 1]]) if edge[i] < edge[i + 1] else None for i in range(len(chunk))]
                columns = [pa.array([None if f is None else f[c] for f in found_], k) for c, k in enumerate(kinds)]
                own = [batch.column(0).slice(*here), marks, pa.array(sizes, pa.int64()), pa.array(set_keys(owner, hashes, sizes).view(np.int64))]
                yield pa.RecordBatch.from_arrays([*own, *columns], names)

    return texts.mapInArrow(frugal(run), f"{ROW}, {PROFILE}")


def _keep_sets(members: DataFrame, found: Ranges) -> None:
    """Keep the shared shingles of each class (rows class, n, members): ``set`` has the classes, ``set_end`` where theirs end in ``set_members``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = np.asarray(batch.column(0)).view(_U), np.asarray(batch.column(1))
            order = np.argsort(keys)
            sets = [np.frombuffer(batch.column(2)[i].as_buffer(), np.int64) for i in order.tolist()]
            sizes = np.array([len(x) for x in sets], np.int32)
            edges = found.edges(keys[order])
            parts = [(p, slice(edges[p], edges[p + 1])) for p in range(found.parts) if edges[p] < edges[p + 1]]
            if parts:
                yield blocks_batch(found.keys, [(p, pack(keys[order][x], n[order][x], sizes[x], np.concatenate(sets[x]))) for p, x in parts])

    def arrays(got: list) -> list[np.ndarray]:
        keys, n, sizes = (np.concatenate([x[i] for x in got]) for i in range(3))
        flat = np.concatenate([x[3] for x in got])
        stop = np.cumsum(sizes, dtype=np.int64)
        _, first = np.unique(keys, return_index=True)  # equal texts of several tasks
        sets = [flat[stop[i] - sizes[i] : stop[i]] for i in first.tolist()]
        return [keys[first], n[first], np.cumsum(sizes[first], dtype=np.int64), np.concatenate(sets)]

    found.keep(members.mapInArrow(frugal(run), "to int, block binary"), arrays, "set", "set_n", "set_end", "set_members")


def _sets(classes: np.ndarray, found: Ranges) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct ones of some classes, ascending as unsigned numbers, their set sizes and their shared shingles."""
    keys = np.unique(classes.view(_U))
    n, sets = np.zeros(len(keys), np.int64), [np.zeros(0, _U)] * len(keys)
    for p, here, place, _ in found.places("set", keys):
        ends, flat = found.store.get("set_end", p), found.store.get("set_members", p)
        n[here] = found.store.get("set_n", p)[place]
        for i, at in enumerate(place.tolist(), here.start):
            sets[i] = np.asarray(flat[ends[at - 1] if at else 0 : ends[at]]).view(_U)
    return keys, n, sets


def _prepared(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, Ranges]:
    """The rows (``ROW``), the profiles (class, n, ``PROFILE`` without members), one for each class that may link, and the sets of these."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_mark(docs).alias("mark"), F.col(text_col).cast("string").alias("text"))
    found = Ranges(docs.sparkSession, "shingles")
    _chosen(texts, found)
    _count_shingles(texts, found, width)
    rows = written(_profiled(texts, found, width, percent))
    linkable = rows.where("signature is not null").withColumn("n", F.col("n_shingles"))
    _keep_sets(linkable.select("class", "n", "members"), found)
    profiles = written(linkable.select("class", "n", "shared", "parity", "spread", "signature", "prefix").dropDuplicates(["class"]))
    return rows.select("doc_id", "mark", "n_shingles", "class"), profiles, found


# -- pairs ------------------------------------------------------------------------------


def _verified(pairs: DataFrame, found: Ranges, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar, by their whole shared sets, which are looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.asarray(batch.column(i)) for i in range(2))
            keys, n, sets = _sets(np.concatenate([a, b]), found)
            x, y = (np.searchsorted(keys, c.view(_U)) for c in (a, b))
            keep = np.zeros(len(batch), bool)
            for i, (p, q) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
                large, small = (sets[p], sets[q]) if len(sets[p]) >= len(sets[q]) else (sets[q], sets[p])
                common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                keep[i] = 100 * common >= percent * (n[p] + n[q] - common)
            yield batch.filter(pa.array(keep))

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.select("a", "b").repartition(parts, "a", "b").mapInArrow(frugal(run), "a bigint, b bigint")


def _may_link(a: str, b: str, percent: int) -> str:
    """What must hold if two sets of x and y shingles are similar (t: the threshold).

    Their sizes differ by t at most; they have t (x + y) / (1 + t) in common, and no
    class has more in common with others than its shared shingles; and they differ in
    (1 - t) (x + y) / (1 + t) shingles at most, namely in all unique ones and in the
    shared ones of which the bitmaps tell.
    """
    sizes = f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)"
    common = f"{100 + percent} * least({a}.shared, {b}.shared) >= {percent} * ({a}.n + {b}.n)"
    bits = " + ".join(f"bit_count({a}.p{i} ^ {b}.p{i})" for i in range(PARITY_WORDS))
    apart = f"{100 + percent} * ({a}.n - {a}.shared + {b}.n - {b}.shared + {bits}) <= {100 - percent} * ({a}.n + {b}.n)"
    return f"{sizes} and {common} and {apart}"


def _facts() -> Column:
    return F.struct("class", "n", "shared", *(F.col("parity")[i].alias(f"p{i}") for i in range(PARITY_WORDS)))


def _facts() -> Column:
    return F.struct("class", "n", "shared", *(F.col("parity")[i].alias(f"p{i}") for i in range(PARITY_WORDS)))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _groups_may_link(x: str, y: str, percent: int) -> str:
    """``_may_link`` for groups: by size, by the most shared shingles of a member, and by the bits that all members of one group have and none of the other."""
    sizes = f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)"
    common = f"{100 + percent} * least({x}.shared, {y}.shared) >= {percent} * ({x}.n + {y}.n)"
    bits = " + ".join(f"bit_count(({x}.all{i} & ~{y}.any{i}) | ({y}.all{i} & ~{x}.any{i}))" for i in range(PARITY_WORDS))
    apart = f"{100 + percent} * ({x}.n - {x}.shared + {y}.n - {y}.shared + {bits}) <= {100 - percent} * ({x}.n + {y}.n)"
    return f"{sizes} and {common} and {apart}"


def _class_components(profiles: DataFrame, found: Ranges, percent: int) -> DataFrame:
    """Step 3: (node, component) of all classes that are linked."""
    own = profiles.groupBy("signature", "n").agg(
        F.max_by("prefix", "class").alias("prefix"), F.max_by(_facts(), F.struct("spread", "class")).alias("one"), F.max("spread").alias("spread"), F.max("shared").alias("shared"), F.count(F.lit(1)).alias("times"),
        *(f(F.col("parity")[i]).alias(f"{name}{i}") for i in range(PARITY_WORDS) for name, f in (("all", F.bit_and), ("any", F.bit_or))),
    )
    groups = written(own.withColumn("group", F.xxhash64("signature", "n")))
    members = profiles.select(F.xxhash64("signature", "n").alias("group"), _facts().alias("x"))
    # Within a group: members against their lead.
    alike = members.join(groups.where("times > 1").select("group", F.col("one").alias("y")), "group").where("x.class <> y.class").select("x", "y")
    # Between groups: the lead of each group in a list against the lead of the list's pivot.
    index = groups.select(F.explode("prefix").alias("token"), F.col("one").alias("x"), "spread")
    pivots = index.groupBy("token").agg(F.max_by("x", F.struct("spread", "x.class")).alias("y"), F.count(F.lit(1)).alias("lists")).where("lists > 1").select("token", "y")
    leads = index.join(written(pivots), "token").select("x", "y").unionByName(alike).where("x.class <> y.class").where(_may_link("x", "y", percent))
    links = written(_verified(_ordered(leads.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))), found, percent))
    # What is still apart: each list takes a random pivot, so that a group meets many; then all that is left.
    for pivot in (True, False):
        labels = written(connected_components(links))
        links = written(links.unionByName(_verified(_expanded(_group_pairs(groups, members, labels, percent, pivot), members, labels, percent), found, percent)))
    return connected_components(links)


def _group_pairs(groups: DataFrame, members: DataFrame, labels: DataFrame, percent: int, pivot: bool) -> DataFrame:
    """Pairs (g, h) of groups that share a prefix shingle and are not wholly in one component: with a pivot of each list, or all.

    ``rest``: how many shingles a set has from the shared one on.  At the first one that two sets share,
    these must suffice for what similar sets have in common.  Groups meet those of their own and the next
    band of sizes only.
    """
    named = members.select("group", F.col("x.class").alias("class")).join(labels, F.col("class") == F.col("node"), "left").withColumn("part", F.coalesce("component", "class"))
    parts = named.groupBy("group").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    placed = groups.join(parts, "group").select("*", F.posexplode("prefix").alias("at", "token"))
    band = F.floor(F.log(F.col("n")) / math.log(1.0001 * 100 / percent)).cast("bigint") if percent < 100 else F.col("n")
    placed = placed.withColumn("rest", F.col("shared") - F.col("at")).withColumn("own", band).withColumn("band", F.explode(F.array("own", F.col("own") - 1)))
    # A list is the groups of one shingle in one band of sizes and the next.
    open_ = written(placed.groupBy("token", "band").agg(F.min("low").alias("low_"), F.max("high").alias("high_")).where("low_ <> high_").select("token", "band"))
    bits = [f"{name}{i}" for i in range(PARITY_WORDS) for name in ("all", "any")]
    index = written(placed.join(open_, ["token", "band"], "left_semi").select("token", "band", "own", F.struct("group", "n", "shared", "rest", "low", "high", *bits).alias("x")))
    if pivot:
        others = written(index.groupBy("token", "band").agg(F.max_by("x", F.xxhash64("x.group", "token")).alias("y")))
        pairs = index.join(others, ["token", "band"])
    else:
        others = index.select("token", "band", F.col("own").alias("other"), F.col("x").alias("y"))
        pairs = index.where("own = band").join(others, ["token", "band"]).where("own < other or x.group <= y.group")
    apart = pairs.where("least(x.low, y.low) <> greatest(x.high, y.high)").where(f"{100 + percent} * least(x.rest, y.rest) >= {percent} * (x.n + y.n)").where(_groups_may_link("x", "y", percent))
    return apart.select(F.least("x.group", "y.group").alias("g"), F.greatest("x.group", "y.group").alias("h")).distinct()


def _expanded(pairs: DataFrame, members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of the paired groups that are in different components and may link."""
    named = members.join(labels, F.col("x.class") == F.col("node"), "left").select("group", "x", F.coalesce("component", "x.class").alias("part"))
    left, right = named.select(F.col("group").alias("g"), "x", "part"), named.select(F.col("group").alias("h"), F.col("x").alias("y"), F.col("part").alias("other"))
    met = written(pairs).join(left, "g").join(right, "h").where("part <> other and (g <> h or x.class < y.class)").where(_may_link("x", "y", percent))
    return _ordered(met.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")))


# -- links ------------------------------------------------------------------------------


def _units(parts: DataFrame, weights: DataFrame) -> DataFrame:
    """Each linked class in each unit of work of its component."""
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    blocks = written(sizes.select("component", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int").alias("blocks")))
    weighed = parts.join(weights, parts["node"] == weights["class"]).select("component", "class", "times")
    own = F.pmod(F.hash("class"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = weighed.join(blocks, "component").withColumn("own", own).withColumn("other", other)
    return dealt.select("component", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), (F.col("own") > F.col("other")).alias("side"), "class", "times")


def _similar(n: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets are similar, as a symmetric matrix; what they share is counted some shingles at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1
    number = np.cumsum(several) - 1
    at = several[token]
    owner, token = owner[at], number[token[at]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(several.sum()), COLUMNS):
        a, z = np.searchsorted(token, [first, first + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[a:z], token[a:z] - first] = 1
        common += has @ has.T
    common = common.astype(np.int64)
    out = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    np.fill_diagonal(out, False)
    return out


def _counted(units: DataFrame, found: Ranges, percent: int, pairs: bool) -> DataFrame:
    """Rows (a, b, links): sums by class (a), or with ``pairs`` the pairs of similar classes, a < b."""
    order = ["component", "left", "right"]

    def solve(side: np.ndarray, names: np.ndarray, times: np.ndarray, whole: bool) -> pa.RecordBatch:
        keys, n, sets = _sets(names, found)
        at = np.searchsorted(keys, names.view(_U))
        near = _similar(n[at], [sets[i] for i in at], percent)
        if not whole:
            near &= side[:, None] != side[None, :]
        if pairs:
            x, y = np.nonzero(np.triu(near))
            a, b, links = np.minimum(names[x], names[y]), np.maximum(names[x], names[y]), np.ones(len(x), np.int64)
        else:
            a, links = names, near @ times
            a, links = a[links > 0], links[links > 0]
            b = np.zeros(len(a), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            columns = [np.asarray(batch.column(i)) for i in range(6)]
            keys = np.stack(columns[:3], 1)
            edge = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else np.zeros(0, np.int64)
            for first, last in zip(edge, np.append(edge[1:], len(keys)), strict=True):
                if held and tuple(keys[first]) != key:
                    yield solve(*(np.concatenate([h[i] for h in held]) for i in range(3)), key[1] == key[2])
                    held = []
                key = tuple(keys[first])
                held.append([c[first:last] for c in columns[3:]])
        if held:
            yield solve(*(np.concatenate([h[i] for h in held]) for i in range(3)), key[1] == key[2])

    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(frugal(run), "a bigint, b bigint, links bigint")


# -- results ----------------------------------------------------------------------------


def _named(rows: DataFrame, linked: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``rows`` with their component's least (id, mark), null ids last, and their class's ``links``, if rows (class, links) are given.

    ``linked``: (node, component) of the linked classes.  What is known of a class meets the rows in one join, which AQE splits
    where a class has very many.
    """
    lead = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    firsts = rows.where("n_shingles > 0").groupBy("class").agg(F.min(lead).alias("first"), (F.count(F.lit(1)) - 1).alias("copies"))
    firsts = written(firsts.join(linked, firsts["class"] == linked["node"], "left").select("class", "first", "copies", F.coalesce("component", "class").alias("component")))
    names = written(firsts.groupBy("component").agg(F.min("first").alias("lead")))
    facts = firsts.join(names, "component").select(F.col("class").alias("_class"), "lead", "copies")
    if links is not None:
        others = links.select(F.col("class").alias("_other"), "links")
        facts = facts.join(others, F.col("_class") == F.col("_other"), "left").select("_class", "lead", (F.col("copies") + F.coalesce("links", F.lit(0))).alias("copies"))
    named = rows.join(written(facts), (F.col("class") == F.col("_class")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("lead.doc_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), "class", "mark", F.when(F.col("n_shingles") > 0, F.col("lead.mark")).alias("lead_mark"), F.coalesce("copies", F.lit(0)).cast("bigint").alias("n_links"))


def near_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, class), one for each row of ``docs``."""
    rows, profiles, found = _prepared(docs, width, percent, id_col, text_col)
    return _named(rows, written(_class_components(profiles, found, percent))).select("doc_id", "n_shingles", "component_id", "class")


def _weights(rows: DataFrame) -> DataFrame:
    return rows.where("n_shingles > 0").groupBy("class").agg(F.count(F.lit(1)).alias("times"))


def near_links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All pairs (a, b) of similar classes, a < b, and the rows (doc_id, n_shingles, class) of their members.

    Rows of one class are similar to each other, if they have shingles.
    """
    rows, profiles, found = _prepared(docs, width, percent, id_col, text_col)
    parts = written(_class_components(profiles, found, percent))
    pairs = _counted(_units(parts, written(_weights(rows))), found, percent, True)
    return written(pairs.select("a", "b")), rows.select("doc_id", "n_shingles", "class")


def link_counts(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``near_components`` with ``n_links``: to how many other rows each is similar."""
    rows, profiles, found = _prepared(docs, width, percent, id_col, text_col)
    parts, weights = written(_class_components(profiles, found, percent)), written(_weights(rows))
    sums = _counted(_units(parts, weights), found, percent, False).groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    return _named(rows, parts, written(sums)).select("doc_id", "n_shingles", "component_id", "class", "n_links")


#: What becomes of a row: it stays, goes, or stays once among equal rows.
_STAYS, _GOES, _ONCE = 0, 1, 2


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Of each component the row with the least id (null last, then by a hash of the row); columns as they are.

    Of equal rows one stays; rows without shingles all stay.  Texts are not shuffled: rows look
    up what becomes of them.
    """
    rows, profiles, sets = _prepared(docs, width, percent, "doc_id", "text")
    named = written(_named(rows, written(_class_components(profiles, sets, percent))).where("n_shingles > 0"))
    gone = named.where("mark <> lead_mark").select("mark", F.lit(_GOES).cast("bigint").alias("fate")).distinct()
    equal = named.where("mark = lead_mark").groupBy("mark").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    found = Ranges(docs.sparkSession, "fates")
    found.table(gone.unionByName(equal.select("mark", F.lit(_ONCE).cast("bigint").alias("fate"))), "mark", "fate")
    fate, mark = unused("fate", docs.columns), unused("mark", docs.columns)
    keyed = docs.withColumn(mark, row_mark(docs))
    left = keyed.withColumn(fate, found.looked_up("mark", "fate", F.col(mark), _STAYS))
    single = left.where(F.col(fate) == _ONCE).dropDuplicates([mark])
    return left.where(F.col(fate) == _STAYS).unionByName(single).select(*docs.columns)


#: DuckDB SQL for ``link_counts`` (without the classes).
ORACLE = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ') || ' #' || len(w)] else [] end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by 1),
common as (select x.doc_id as a, y.doc_id as b, count(*) as c from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2),
links as (select a, b from common join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * c >= 75 * (p.n + q.n - c)),
reached(node, other) as (select doc_id, doc_id from documents union select r.node, l.b from reached r join links l on l.a = r.other),
named as (select node, min(other) as component_id from reached group by node)
select d.doc_id, coalesce(z.n, 0) as n_shingles, n.component_id, (select count(*) from links where a = d.doc_id) as n_links from documents d join named n on n.node = d.doc_id left join sizes z on z.doc_id = d.doc_id
"""
