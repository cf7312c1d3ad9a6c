"""Operators over the whole corpus against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import blocks, chat, chat_template, embedding_dedup, jaccard_join, language_model, mixing, span_dedup
from quillspark.llm.textscan import span_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near_texts(n, seed):
    """Families of near copies, exact copies, short and empty texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 60))] for _ in range(6)]
    out = ["", None, " \n", "one", "One", "a b c d", "a b c d e"]
    for _ in range(n):
        b = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            k = rng.randrange(len(b) + 1)
            if rng.random() < 0.5:
                b.insert(k, rng.choice(vocabulary))
            elif b:
                b.pop(min(k, len(b) - 1))
        out.append(" ".join(b))
    return out


def union_find(links, nodes):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def shingles(text):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def similar_links(sets):
    ids = sorted(sets)
    return [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


def test_jaccard_join(spark, sf_dir):
    texts = near_texts(160, 1) + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, component_id string, class int")
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = union_find(similar_links(sets), sets)
    got = jaccard_join.near_components(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}
    rest = jaccard_join.one_of_each(df)
    assert rest.columns == df.columns
    assert sorted(r.doc_id for r in rest.collect()) == sorted(i for i in sets if want[i] == i)


def test_jaccard_join_repeated_rows_and_nulls(spark):
    same = "a b c d e f g h"
    df = spark.createDataFrame([(1, same), (1, same), (2, same), (1, "x y z q r s t"), (None, same), (None, None), (3, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_components(df).collect()), key=str)
    assert got == sorted([(1, 4, 1), (1, 4, 1), (2, 4, 1), (1, 3, 1), (None, 4, 1), (None, 0, None), (3, 0, 3)], key=str)
    rest = sorted(((r.doc_id, r.text) for r in jaccard_join.one_of_each(df).collect()), key=str)
    assert rest == sorted([(1, same), (1, "x y z q r s t"), (None, None), (3, "")], key=str)
    assert jaccard_join.near_components(df.limit(0)).count() == 0


def test_jaccard_links(spark, sf_dir):
    texts = near_texts(160, 4) + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    words = [f"x{i}" for i in range(120)]
    texts += [" ".join([*words[:k], "odd", *words[k:]]) for k in range(5, 120, 12)]  # near copies of each other
    texts += [" ".join(words[:40] + [f"{t}{i}" for t in "ab"[:k] for i in range(k)]) for k in (0, 1, 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    links = similar_links(sets)
    pairs, rows = jaccard_join.near_links(df)
    members = defaultdict(list)
    for r in rows.collect():
        members[r["class"]].append(r.doc_id)
    found = pairs.collect()
    between = sorted((min(i, j), max(i, j)) for a, b in found for i in members[a] for j in members[b])
    assert between == sorted((i, j) for i, j in links if sets[i] != sets[j]) and len(between) > 100
    times = Counter(x for p in links for x in p)
    want = union_find(links, sets)
    got = jaccard_join.link_counts(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == {i: (len(sets[i]), want[i], times[i]) for i in sets}
    assert jaccard_join.link_counts(df.limit(0)).count() == 0


def test_partition_keys(spark):
    from pyspark.sql import functions as F

    for parts in (3, 51, 211):
        keys = blocks.partition_keys(parts)
        df = spark.createDataFrame([(k,) for k in keys], "k int").select(F.pmod(F.hash("k"), F.lit(parts)).alias("p"))
        assert [r.p for r in df.collect()] == list(range(parts))


def test_blocks_round_trip():
    a, b = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64)), np.arange(5, dtype=np.int32)
    x, y, z = blocks.unpack(blocks.pack(a, b, np.zeros(0, np.uint64)))
    assert np.array_equal(a, x) and np.array_equal(b, y) and len(z) == 0


# -- substring dedup --------------------------------------------------------------------


def cut_sentences(text):
    """The sentences of a text, each a list of the places of its words."""
    out, current, words = [], [], [m.span() for m in WORD.finditer(text)]
    for k, (a, b) in enumerate(words):
        current.append((a, b))
        feed = k + 1 < len(words) and "\n" in text[b : words[k + 1][0]]
        if re.search(r"[.!?][\"')\]]?$|[\u3002\uff01\uff1f]$", text[a:b]) or feed or k == len(words) - 1:
            out.append(current)
            current = []
    return out


def brute_dedup(texts):
    """(text, sentences, sentences that lost words) by spans of three sentences and windows of twenty words."""
    spans, cut = defaultdict(list), {i: cut_sentences(t or "") for i, t in texts.items()}
    words = {i: [w for s in found for w in s] for i, found in cut.items()}
    for i in sorted(texts):
        first = np.cumsum([0, *(len(s) for s in cut[i])]).tolist()
        said = [lower(texts[i][a:b]) for a, b in words[i]]
        runs = [(first[k], first[k + 3], "sentences") for k in range(len(cut[i]) - 2)] + [(k, k + 20, "words") for k in range(len(said) - 19)]
        for a, b, kind in sorted(runs):
            spans[kind, tuple(said[a:b])].append((i, a, b))
    dead = defaultdict(set)
    for found in spans.values():
        for i, a, b in found[1:]:
            dead[i].update(range(a, b))
    out = {}
    for i, t in texts.items():
        begins, at, lost = [a for a, _ in words[i]] + [len(t or "")], 0, 0
        for s in cut[i]:
            lost += not dead[i].isdisjoint(range(at, at + len(s)))
            at += len(s)
        kept = t if not dead[i] else t[: begins[0]] + "".join(t[begins[k] : begins[k + 1]] for k in range(len(words[i])) if k not in dead[i])
        out[i] = kept, len(cut[i]), lost
    return out


def test_span_dedup(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rng = random.Random(2)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + rng.choice(["", "", ".", ","]) for _ in range(60))
    texts |= {1000 + i: f"Own start {i} here. {passage} And own end {i}." for i in range(4)} | {2000: None, 2001: "", 2002: "short. short. short.", 2003: (passage + "\n") * 3}
    texts[2004] = " ".join(rng.choice("abcdefgh") * 9 for _ in range(60_000)) + f" {passage}"
    df = spark.createDataFrame([(i, t, 7, 8, 9, 10, 11) for i, t in texts.items()], "doc_id long, text string, extra int, N_Removed int, row int, id int, mark int")
    cut = span_dedup.drop_repeats(df)
    assert cut.columns == ["doc_id", "text", "extra", "row", "id", "mark", "n_sentences", "n_removed"]
    assert span_dedup.drop_repeats(df, added=("_all", "_gone")).columns == [*df.columns, "_all", "_gone"]
    got = {r.doc_id: r for r in cut.collect()}
    want = brute_dedup(texts)
    assert {i: (r.text, r.n_sentences, r.n_removed) for i, r in got.items()} == want
    assert got[1000].text == texts[1000] and all(len(got[1000 + i].text.split()) < 40 for i in (1, 2, 3))
    assert (got[1001].extra, got[1001].row) == (7, 9) and got[2000].text is None and got[2002].n_removed == 0 and passage not in got[2004].text
    assert span_dedup.drop_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("n_words", [6, 13, 40])
def test_runs_of_three_sentences_go_at_any_length(spark, n_words):
    rng = random.Random(n_words)
    new = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    sizes = [n_words // 3, n_words // 3, n_words - 2 * (n_words // 3)]
    ends = [[". ", '!" ', "? "], ["\n", ".\n", "\n\n"], [".) ", "\uff01 ", "... "]]
    texts = {}
    for i in range(60):
        run = "".join(" ".join(new() for _ in range(n)) + e for n, e in zip(sizes, ends[i % 3], strict=True))
        two = " ".join(new() for _ in range(4)) + ". " + " ".join(new() for _ in range(4)) + ". "
        for k in (0, 1000):
            own = [" ".join(new() for _ in range(rng.randint(3, 9))) + rng.choice([". ", "\n"]) for _ in range(6)]
            texts[k + i] = "".join(own[:2]) + run + own[2] + own[3] + two + "".join(own[4:])
    got = {r.doc_id: r for r in span_dedup.drop_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = brute_dedup(texts)
    assert {i: (r.text, r.n_sentences, r.n_removed) for i, r in got.items()} == want
    for i in range(60):
        assert got[i].text == texts[i] and got[1000 + i].n_removed == 3 and got[1000 + i].n_sentences == 11
        assert len(texts[1000 + i].split()) - len(got[1000 + i].text.split()) == n_words  # the two sentences that repeat stay


def test_span_dedup_repeated_ids(spark):
    passage = " ".join(f"word{i}{'.' if i % 7 == 0 else ''}" for i in range(80))
    rows = [(1, passage), (1, passage), (1, "other. " + passage), (None, passage)]
    got = sorted(((r.doc_id, r.n_removed > 0) for r in span_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, True), (1, True), (1, True), (None, False)], key=str)
    many = [(None, f"{i} {passage}") for i in range(200)]  # one of them keeps the passage
    texts = [r.text for r in span_dedup.drop_repeats(spark.createDataFrame(many, "doc_id long, text string")).collect()]
    assert len(texts) == 200 and sum(passage in t for t in texts) == 1 and sorted(t.split()[0] for t in texts) == sorted(str(i) for i in range(200))


def planted(kind, n, seed):
    """Passages of 50 to 60 words without marks, each in an early and a late text, at places of their own."""
    rng = random.Random(seed)
    new = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    make = {
        "words": lambda: " ".join(new() for _ in range(rng.randint(50, 60))),
        "few words": lambda: " ".join([new(), new(), new()][rng.randrange(3)] for _ in range(rng.randint(50, 60))),
        "one word": lambda: " ".join([new()] * rng.randint(50, 60)),
        "han": lambda: "".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(rng.randint(50, 60))),
    }[kind]
    passages = [make() for _ in range(n)]
    around = lambda p: " ".join(new() for _ in range(rng.randint(0, 70))) + f" {p} " + " ".join(new() for _ in range(rng.randint(0, 70)))
    return passages, {i: around(p) for i, p in enumerate(passages)}, {n + i: around(p) for i, p in enumerate(passages)}


@pytest.mark.parametrize("kind", ["words", "few words", "one word", "han"])
def test_span_dedup_finds_every_passage_without_marks(spark, kind):
    passages, early, late = planted(kind, 300, 5)
    got = {r.doc_id: r for r in span_dedup.drop_repeats(spark.createDataFrame(list((early | late).items()), "doc_id long, text string")).collect()}
    for i, p in enumerate(passages):
        assert p in late[300 + i] and p not in got[300 + i].text and got[300 + i].n_removed > 0
        assert len(late[300 + i]) - len(got[300 + i].text) <= len(p) + 1
        assert kind == "one word" or got[i].text == early[i]


# -- embeddings -------------------------------------------------------------------------


def brute_vectors(vectors):
    unit = {}
    for i, v in vectors.items():
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            unit[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    counts = Counter(x for p in links for x in p)
    return counts, union_find(links, vectors)


def test_embedding_dedup(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    vectors = {i: (centres[rng.integers(6)] + rng.normal(size=16) * rng.choice([0.02, 0.2, 0.4])).tolist() for i in range(240)}
    vectors |= {300 + i: vectors[0] for i in range(30)} | {400: [2 * x for x in vectors[0]], 401: None, 402: [0.0] * 16, 403: [float("nan")] * 16, 404: [None] * 16, 405: [], 406: [1.0, 0.0], 407: [1.0, 0.1], 408: [float("inf")] * 16}
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)  # large buckets are cut into blocks
    df = spark.createDataFrame([(i, v, i, "x") for i, v in vectors.items()], "vec_id long, embedding array<double>, label int, kept string")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    counts, components = brute_vectors(vectors)
    assert len(got) == len(vectors)
    assert all(got[i].n_links <= counts[i] for i in vectors)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(counts.values()) and sum(counts.values()) > 1000
    assert np.mean([got[i].component_id == components[i] for i in vectors]) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert [got[i].n_links for i in (401, 402, 403, 404, 405, 408)] == [0] * 6
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_embedding_recall_on_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    extra = df.selectExpr("vec_id + 100000 as vec_id", "transform(embedding, (x, i) -> cast(x + 0.02 * sin(i * vec_id) as float)) as embedding", "label")
    both = df.unionByName(extra)
    counts, _ = brute_vectors({r.vec_id: list(r.embedding) for r in both.collect()})
    got = embedding_dedup.near_vectors(both).collect()
    assert sum(r.n_links for r in got) >= 0.97 * sum(counts.values()) > 0

def test_embedding_plan_bounds_unrelated_pairs():
    """Few unrelated pairs meet, pairs at the threshold nearly always do, by codes alone."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    for n in (1, 50, 2000, 10**7):
        tables, width = embedding_dedup.plan(n)
        met = embedding_dedup.shared_cell(0.9) ** width
        assert (1 - met) ** tables <= 0.05 < (1 - met) ** (tables - 1) and n * embedding_dedup.shared_cell(0) ** width <= 0.25 or width == 8
    x = unit(rng.normal(size=(2000, 48)))
    tables, width = embedding_dedup.plan(100_000)
    codes = embedding_dedup.bucket_codes(x, tables, width)
    pairs = sum(int((np.unique(codes[:, t], return_counts=True)[1] ** 2).sum() - len(x)) // 2 for t in range(tables))
    assert pairs < 0.001 * len(x) * (len(x) - 1) / 2
    other = unit(rng.normal(size=x.shape))
    other = unit(other - (other * x).sum(1, keepdims=True) * x)
    near = 0.9 * x + np.sqrt(1 - 0.81) * other
    assert (codes == embedding_dedup.bucket_codes(near, tables, width)).any(axis=1).mean() > 0.92
    assert np.array_equal(codes[:, 5:9], embedding_dedup.bucket_codes(x, tables, width, first=5, last=9))


def test_embedding_dedup_repeated_rows_and_null_ids(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    rows = [(1, v), (1, v), (None, w), (None, [5.0, 0.0, 0.0]), (4, w), (5, [0.0, 0.0, 1.0])]
    got = sorted((str(r) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).select("vec_id", "n_links", "component_id", "kept").collect()))
    want = [(1, 3, 1, True), (1, 3, 1, True), (None, 3, 1, False), (4, 3, 1, False), (None, 0, None, False), (5, 0, 5, True)]
    assert got == sorted(f"Row(vec_id={a}, n_links={b}, component_id={c}, kept={d})" for a, b, c, d in want)



# -- language model ---------------------------------------------------------------------


class BruteModel:
    """Interpolated modified Kneser-Ney of any order, word by word."""

    def __init__(self, train, order):
        self.order, self.words = order, Counter(w for t in train for w in t)
        raw = {k: Counter() for k in range(2, order + 1)}
        for t in train:
            t = ["<s>", *t]
            for k in raw:
                raw[k].update(tuple(t[i - k + 1 : i + 1]) for i in range(max(1, k - 1), len(t)))
        self.counts = {order: raw[order]}
        for k in range(order - 1, 1, -1):
            places = Counter(g[1:] for g in raw[k + 1])
            self.counts[k] = Counter({g: n if g[0] == "<s>" else places[g] for g, n in raw[k].items()})
        self.counts[1] = Counter(g[1:] for g in raw[2])
        self.d = {k: language_model._discounts(np.array([sum(x == j for x in c.values()) for j in (1, 2, 3, 4)])) for k, c in self.counts.items()}
        self.context = {k: defaultdict(lambda: [0, 0, 0, 0]) for k in self.counts}
        for k, c in self.counts.items():
            for g, n in c.items():
                self.context[k][g[:-1]][0] += n
                self.context[k][g[:-1]][min(n, 3)] += 1

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(self.words) + 1)
        facts, d, n = self.context[k].get(gram[:-1]), self.d[k], self.counts[k][gram]
        if not facts:
            return self.p(gram[1:])
        return max(n - (d[min(n, 3) - 1] if n else 0), 0) / facts[0] + sum(x * y for x, y in zip(d, facts[1:], strict=True)) / facts[0] * self.p(gram[1:])

    def score(self, tokens):
        t = ["<s>", *tokens]
        return sum(math.log10(self.p(tuple(t[max(0, i - self.order + 1) : i + 1]))) for i in range(1, len(t)))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(spark, sf_dir, order):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()} | {5000: None, 5001: "", 5002: "never seen words", 5003: "to be " * 3000}
    rows = [(i, t, 1) for i, t in texts.items()] + [(5003, texts[5003], 1), (None, "no id", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    split = lambda t: WORD.findall(lower(t)) + ["</s>"]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [split(t) for i, t, _ in rows if not out(i)]
    brute = BruteModel(train, order)
    c, n, v = brute.words, sum(brute.words.values()), len(brute.words)
    assert abs(sum(brute.p(("<s>", "the", w)[3 - order :]) for w in c) + brute.p(("<s>", "the", "@")[3 - order :]) - 1) < 1e-9 or order == 4
    got = language_model.train_and_score(df, order=order).collect()
    assert len(got) == len(rows)
    for r in got:
        t = split("no id" if r.doc_id is None else texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(t), sum(w in c for w in t), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-6
        assert abs(r.score - brute.score(t)) < 1e-6
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert language_model.train_and_score(df.limit(0), order=order).count() == 0


def test_language_model_numbers_fit(spark):
    model = language_model.Model(None, 2, 3)
    with pytest.raises(OverflowError):
        model.number(1, {0: 2**31, 1: 2**31})
    model.number(3, {0: 2**40})
    model.base[1] = [0, 3, 3]
    assert model.owners(1, np.array([0, 2, 3])).tolist() == [0, 0, 1] and model.span(1, 1) == (3, 4)


def far_folder(spark, tmp_path, monkeypatch, *modules):
    """The shared folder in a file system that only Spark reads."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.far.link./shared", f"file://{tmp_path}")
    for module in modules:
        monkeypatch.setattr(module, "shared_dir", lambda _: "viewfs://far/shared")


def test_language_model_and_spans_in_a_far_folder(spark, tmp_path, monkeypatch):
    from quillspark.plans import shared

    words = random.Random(5).choices([f"w{i}" for i in range(40)], k=4000)
    texts = [" ".join(words[i : i + 60]) for i in range(0, 4000, 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = sorted(language_model.train_and_score(df, order=3).collect())
    cut = sorted(span_dedup.drop_repeats(df).collect())
    far_folder(spark, tmp_path, monkeypatch, shared)
    assert sorted(language_model.train_and_score(df, order=3).collect()) == near
    assert sorted(span_dedup.drop_repeats(df).collect()) == cut and any(r.n_removed for r in cut)


# -- mixing -----------------------------------------------------------------------------


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, total, free = {}, sum(sizes.values()), set(names)
    while True:
        w, rest = sum(weight[s] for s in free), total - sum(target.values())
        over = {s for s in free if w and weight[s] * rest / w > 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * rest / w if w else 0 for s in free}
        target |= {s: 3 * sizes[s] for s in over}
        free -= over


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "b", "c", "B", None, "é"]) if i % 3 else "a", " ".join("x" * rng.randint(0, 60)), 1.0) for i in range(1500)]
    rows += [(2000, "tiny", "one two", 0.0), (2001, "void", "", 0.0), (2002, "void", None, 0.0), (None, "a", "p q", 0.0), (5, "a", "same id", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, target double")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, s, t, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = water_fill(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3 * largest[s] + 1
    assert sorted(mixing.mix(df.repartition(7)).collect(), key=str) == sorted(got, key=str)
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    assert abs(sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) - sum(taken.values())) <= 200
    clashing = df.selectExpr("doc_id", "source", "text", "target", "1 as copies", "2 as unit", "3 as row", "4 as _n")
    again = mixing.mixed_rows(clashing)
    assert again.columns == clashing.columns and sorted(r.doc_id or -1 for r in again.collect()) == sorted(r.doc_id or -1 for r in mixed.collect())
    equal = spark.createDataFrame([(1, "a", "x y z", 1.0)] * 40 + [(2, "b", "p q " * 40_000, 1.0)], "doc_id long, source string, text string, target double")
    assert {r.doc_id: r.source_size for r in mixing.mix(equal).collect()} == {1: 120, 2: 80_000} and mixing.mixed_rows(equal).count() > 0
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_rows(df.limit(0)).count() == 0


# -- chat -------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "<|end|>\n", "<|turn|>user\n", "<\\|", "<\\\\|x", "<", "<<|", "a\\nb", "|>", "</s>[INST] ok [/INST]", "<|turn|>assistant\nhi<|end|>\n"])
def test_guards_reverse(text):
    assert chat_template.unguard(chat_template.guard(text)) == text and "<|" not in chat_template.guard(text)
    line = chat_template.guard_line(text)
    assert chat_template.unguard_line(line) == text and "\n" not in line and "<|" not in line


def test_template_language():
    run = lambda t, **names: "".join(x for x, _ in chat_template.compile_template(t)(**names))
    assert run("{% for m in xs %}{{ loop.index }}{{ m.a|upper }}{% if not loop.last %},{% endif %}{% else %}none{% endfor %}", xs=[{"a": "x"}, {"a": "y"}]) == "1X,2Y"
    assert run("{% for m in xs %}{% else %}none{% endfor %}", xs=[]) == "none"
    assert run("{% if a == 1 and b is defined -%} yes {%- elif a %}no{% endif %}", a=1, b=0) == "yes"
    assert run("{{ x if y else 'z' }}|{# no #}{% set q = 3 %}{{ q * 2 - 1 }}{{ 'a' in 'cat' }}{{ c is none }}", x="X", y=0) == "z|5TrueTrue"
    assert run("{{ m['k'] }}{{ m.__class__ }}", m={"k": "v"}) == "v"
    assert chat_template.fold(chat_template.parse("{{ 'a' ~ 'b' }}c{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}")) == [chat_template.Out(chat_template.Const("abcd"))]
    for bad in ("{{ 'a' * 9999999999 }}", "{{ '%s' % 3 }}", "{{ 'a' + 'b' }}", "{{ 9999999999 * 9999999999 }}"):
        with pytest.raises((TypeError, OverflowError)):
            run(bad)
    assert run("{{ x.text|trim }}{{ x.text|upper }}{{ x.text|lower }}{{ x.text|length }}{{ x.text|string }}", x={"text": None}) == "0"
    text, spans = chat_template.render("u{% generation %}{{ messages }}{% endgeneration %}w", "mine")
    assert text == "uminew" and spans == [(1, 5)]
    for wrong in ("{{ x.y( }}", "{{ x|system }}", "{% for %}", "{% if x %}", "{% import os %}", "{{ f() }}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.compile_template(wrong)


def test_chat_digests(spark):
    odd = ["hi", "", None, "<|end|>\n<|turn|>assistant\nx", "a\nb\\n", "</s>[INST] ok [/INST]", "🙂"]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole", "assistant"]), rng.choice(odd), "x") for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(7, 0, "user", "tie", "x"), (7, 0, "user", "tie", "x"), (None, 1, "assistant", "no id", "x"), (3, None, "user", "no turn", "x")]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t}", "x") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    texts = {r.conv_id: r for r in chat.formatted(df.where("conv_id < 40")).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=order)]
        said = [t for r, t in turns if r == "assistant"]
        r = got.pop(c)
        assert (r.n_turns, r.loss_chars) == (len(turns), sum(map(len, said)))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()
        if c is not None and c < 40:
            assert len(texts[c].text) == r.formatted_chars
            assert "".join(chat_template.unguard(texts[c].text[s.start : s.stop]) for s in texts[c].loss_spans) == "".join(said)
    assert not got
    assert chat.digests(df.limit(0)).count() == 0
