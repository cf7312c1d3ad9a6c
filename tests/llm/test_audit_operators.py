"""Source divergence, importance resampling and SentencePiece against brute force and the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import divergence, importance, pieces
from quillspark.llm.textscan import chunks

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = ["'s", " ", "  ", "   ", " " * 13, "\n", "\t", "a", "it's", "é", "日本", "日本語", "🙂", "123", "<s>", "<0x0A>", "▁", "▁▁", "Word", "aaa", "xxxxxxx", "ü", "́", "\r\n", "THE", "\x00", "　", " the", "function", "inging"]
ODD = ["", " ", "\n\n", "a", "日本 🙂🙂 日本", "x" * 70_000, "the" * 9_000, " " * 5_000, "▁", "▁a ▁", "</s> <unk>", "aaaa aaaaa", ("thequickbrown" * 20 + " ") * 40]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def rows_of(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


# -- SentencePiece ------------------------------------------------------------------------


def test_pieces_equal_the_library(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ODD + random_texts(400)
    own = pieces.load(PATH)
    for chunk in chunks(pa.array(texts), 50_000):
        ids, counts, spelled = own.encode_decode(chunk)
        alone = own.encode_decode(chunk, share=False)
        assert np.array_equal(ids, alone[0]) and np.array_equal(counts, alone[1]) and np.array_equal(spelled, alone[2])
        at = 0
        for i, n in enumerate(counts.tolist()):
            want = LIB.encode(texts[chunk.first + i])
            assert ids[at : at + n].tolist() == want
            assert own.decode(want) == LIB.decode(want) == texts[chunk.first + i].replace("▁", " ")
            at += n


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_pieces_any_text(text):
    assert pieces.load(PATH).encode_text(text) == LIB.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 260), st.sampled_from([28705, 259])), max_size=10))
def test_any_ids_decode_as_in_the_library(ids):
    assert pieces.load(PATH).decode(ids) == LIB.decode(ids)


def test_walks_agree_and_the_table_of_pairs_starts_anew(monkeypatch):
    texts = random_texts(200, 3)
    monkeypatch.setattr(pieces, "LONG", 3)  # nearly all fragments one by one
    assert [pieces.load(PATH).encode_text(t) for t in texts] == LIB.encode(texts)
    monkeypatch.undo()
    monkeypatch.setattr(pieces, "PAIR_BITS", 10)
    own = pieces.PieceBpe(PATH)
    assert [own.encode_text(t) for t in texts] == LIB.encode(texts) and own.pairs.held <= 512


def test_every_piece_is_what_its_text_is_encoded_as():
    own = pieces.load(PATH)
    normal = np.flatnonzero(own.kind == pieces.NORMAL)
    assert set(own.longest.tolist()) - {-1} == set(normal.tolist())


def test_other_models_are_refused(tmp_path):
    with open(PATH, "rb") as f:
        model = f.read()
    (tmp_path / "unigram.model").write_bytes(model.replace(b"\x12\x06tok_v0\x18\x02", b"\x12\x06tok_v0\x18\x01"))
    with pytest.raises(ValueError):
        pieces.PieceBpe(str(tmp_path / "unigram.model"))


def piece_frame(spark, texts):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(len(texts), None, 1, "x"), (0, texts[0], 1, None), (None, "null id", None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids_sha256 string")


def test_piece_round_trip_rows(spark):
    texts = ODD + random_texts(60, 2)
    got = pieces.round_trip(piece_frame(spark, texts), PATH).collect()
    assert len(got) == len(texts) + 3 and {r.doc_id for r in got} == {None, *range(len(texts) + 1)}
    for r in got:
        text = "null id" if r.doc_id is None else texts[r.doc_id] if r.doc_id < len(texts) else ""
        ids = LIB.encode(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIB.decode(ids).encode()).hexdigest())
    assert pieces.round_trip(piece_frame(spark, texts).limit(0), PATH).count() == 0
    encoded = pieces.encode_documents(piece_frame(spark, texts), PATH)
    again = {r.doc_id: r.text for r in pieces.decode_documents(encoded, PATH).collect()}
    assert again[4] == texts[4] and again[len(texts)] == ""


# -- source divergence --------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_audit(docs):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    groups, in_docs, counts = set(), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = TERM.findall((text or "").translate(lower))
        in_docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = Counter()
    for lang in {a for a, _ in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= 30]
        sources = [b for a, b in groups if a == lang]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:50])):
                for rank, (value, item) in enumerate(found, 1):
                    out[item.decode(), lang, part, rank, s, -value] += 1
    return out


def audit_docs(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"Wort{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(12)] + ["é", "É", "日本", "THE", "the", "x" * 300, "co-op", "a1b"]
    docs = []
    for i in range(400):
        lang, source = rng.choice(["de", "de", "en", None, ""]), rng.choice(["s1", "s1", "s2", "ß", None, "S3"])
        own = vocabulary[: 40 + 20 * (i % 4)]
        docs.append((lang, source, " ".join(rng.choice(own) + rng.choice(["", ".", "\n", "\x00"]) for _ in range(rng.randint(0, 60)))))
    docs += [("fr", "s1", "nur drei Texte"), ("fr", "s2", None), ("fr", "s3", ""), ("xx", "alone", "kein Paar"), ("de", "empty", None)]
    return docs + docs[:40] + [("de", "s1", "gemeinsam " * 200_000)] + [("de", "s9", "selten gemeinsam")] * 31


def test_divergence_matches_brute_force(spark, monkeypatch):
    docs = audit_docs()
    df = spark.createDataFrame([(*d, 1.5, "x") for d in docs], "lang string, source string, text string, value double, Term string")
    want = brute_audit(docs)
    assert rows_of(divergence.audit(df)) == want
    assert any(k[2] == "pair" and k[1] == "fr" and k[5] == 0 for k in want) and not any(k[1] == "xx" for k in want)
    monkeypatch.setattr(divergence, "HELD", 50)  # tasks hand on what they hold again and again
    monkeypatch.setattr(divergence, "SHARD", 20)  # and there are many shards
    assert rows_of(divergence.audit(df.repartition(5))) == want
    assert divergence.audit(df.limit(0)).count() == 0
    assert rows_of(divergence.audit(df.limit(7))) == brute_audit([tuple(r)[:3] for r in df.limit(7).collect()])


# -- importance resampling ----------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_resample(docs, target, orders=1, least=20, percent=10):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def features(text):
        words = WORD.findall((text or "").translate(lower))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in range(1, orders + 1) for i in range(len(words) - n + 1)]

    own = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in own for b in f), Counter(b for text in target for b in features(text)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + 10_000.0) / ((s[b] + 1.0) * (t.total() + 10_000.0)))) for b in s}
    scored = []
    for (i, text), (n, f) in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        scored.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in scored if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = [*range(1, percent * len(fit) // 100 + 1)]
    out = [(*r[:4], k) for r, k in zip(fit, rank, strict=False)] + [(*r[:4], None) for r in fit[len(rank) :]] + [(*r[:4], None) for r in scored if r[4] < least]
    return Counter((r[0], r[1], r[4], r[3], r[2]) for r in out)


def resample_docs():
    rng = random.Random(9)
    words = ["alpha", "BETA", "Gamma9", "é", "É", "日本", "don't", "x_y", "42", "the"]
    docs = [(i, rng.choice([" ", "\n"]).join(rng.choice(words[i % 4 :]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    return docs + [docs[7]] * 25 + [(8, "another text of the same id " * 5), (900, None), (901, ""), (902, "!!! ..."), (None, "the beta " * 30), (903, "long beta " * 100_000)]


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_resampling_matches_brute_force(spark, orders):
    docs, target = resample_docs(), ["the beta beta", None, "", "gamma9 alpha the beta"]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, bucket int, Gram string").repartition(3)
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(df, aim, orders=orders, percent=30)
    assert rows_of(got) == brute_resample(docs, target, orders, percent=30)


def test_resampling_without_rows(spark):
    df, aim = spark.createDataFrame([(1, "a b " * 20)] * 3, "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert rows_of(importance.resample(df, aim, percent=70)) == brute_resample([(1, "a b " * 20)] * 3, [], percent=70)
    assert importance.resample(df.limit(0), df.select("text")).count() == 0


def test_drawing_ranks_over_all_partitions(spark):
    df = spark.range(5_000).selectExpr("id as doc_id", "id % 7 as score", "id as mark", "id as check")
    got = [(r.doc_id, r["rank"]) for r in importance.drawn(df, 40).where("rank is not null").orderBy("rank").collect()]
    want = sorted(range(5_000), key=lambda i: (-(i % 7), i))[:2_000]
    assert got == [(i, k) for k, i in enumerate(want, 1)]


def test_plans_of_resampling_stay_in_the_jvm(spark, sf_dir):
    docs, aim = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = importance.weighed(docs, aim)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Python" not in plan and "crc32" in plan and "posexplode" in plan.lower()
    assert "lead(" in importance.weighed(docs, aim, orders=2)._jdf.queryExecution().toString()
