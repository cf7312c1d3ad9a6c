"""Many terms in one pass, and strings inside texts, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import containment, patterns

TEXTS = [
    (5, "Grace and peace, grace-and peace; graceful GRACE."),
    (1, None),
    (2, ""),
    (9, "peace_x peace2 épeace peace"),
    (3, "and peace" * 3),
    (7, "and peace " * 4000 + "grace and peace"),
    (7, "grace"),  # a key of two rows is one text
    (None, "grace and peace"),
    (4, "GRACE  and\npeace KKelvin"),
    (6, "grace"),
    (8, "İ grace 😀 and peace"),
]
TERMS = ["grace", "peace", "and peace", "Grace and peace", "and", "", None, "kelvin", "ACE"]


def expected(texts, terms, k):
    fold = str.maketrans(patterns.UPPER, patterns.LOWER)
    found = {}
    for term in {t.translate(fold) for t in terms if t}:
        for key, text in texts:
            if key is None or not text:
                continue
            at = [m.start() for m in re.finditer(rf"(?<!\w)(?={re.escape(term)}(?!\w))", text.translate(fold))]
            if at:
                n, place = found.setdefault(term, {}).get(key, (0, 1 << 60))
                found[term][key] = (n + len(at), min(place, at[0]))
    return {(term, key, *of[key]) for term, of in found.items() for key in sorted(of)[:k]}


@pytest.mark.parametrize("shard_chars", [patterns.SHARD_CHARS, 12])
@pytest.mark.parametrize("k", [1, 3])
def test_first_hits(spark, k, shard_chars):
    texts = spark.createDataFrame(TEXTS, "doc long, body string").withColumn("term", F.lit("clash")).repartition(3)
    terms = spark.createDataFrame([(t,) for t in TERMS], "body string")
    got = patterns.first_hits(texts, "doc", "body", terms, "body", k, shard_chars)
    assert {tuple(r[c] for c in ("term", "key", "n", "place")) for r in got.collect()} == expected(TEXTS, TERMS, k)


def test_no_terms_and_no_texts(spark):
    texts = spark.createDataFrame(TEXTS, "doc long, body string")
    none = spark.createDataFrame([], "body string")
    assert patterns.first_hits(texts, "doc", "body", none, "body").count() == 0
    terms = spark.createDataFrame([("grace",)], "body string")
    assert patterns.first_hits(texts.where("false"), "doc", "body", terms, "body").count() == 0


def test_first_contexts_count_every_term_of_a_label(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(200)]
    labels = [(i, " ".join(rng.sample(words, 5))) for i in range(25)] + [(25, None), (26, "nothing"), (None, "w1")]
    got = patterns.first_contexts(
        spark.createDataFrame(texts, "key long, text string").repartition(5), "key", "text",
        spark.createDataFrame(labels, "item long, label string"), "item", F.split("label", " "), 3, 40,
    )
    want = set()
    for item, label in labels:
        if item is None or label is None:
            continue
        terms = set(label.split())
        hits = [(key, shown) for key, text in texts if (shown := [w for w in text.split() if w in terms])]
        for r, (key, shown) in enumerate(hits[:3], 1):
            want.add((item, key, len(set(shown)), len(shown), min(shown), r))
    assert {tuple(r[c] for c in ("item", "key", "n_terms", "n_hits", "first_term", "r")) for r in got.collect()} == want


def test_words_and_pairs(spark):
    row = spark.createDataFrame([("Of Grace, and mercy  of grace und ÄRA",)], "t string").select(patterns.words_and_pairs(F.col("t"), 5).alias("x")).head()
    assert set(row.x) == {"grace", "mercy", "of grace", "and mercy", "grace und", "und Ära"}
    none = spark.createDataFrame([(None,), ("",), ("a",)], "t string").select(patterns.words_and_pairs(F.col("t"), 5).alias("x")).collect()
    assert [r.x for r in none] == [None, [], []]


def test_strings_inside_texts(spark):
    rng = random.Random(5)
    letters = "abcdeé😀 "
    texts = [(i, "".join(rng.choices(letters, k=rng.choice([0, 1, 5, 30, 45, 300])))) for i in range(150)]
    texts += [(900, None), (None, "abc"), (901, "x" * 60_000 + texts[5][1] + "end"), (902, "ab" * 40), (3, texts[4][1])]
    whole = [t for _, t in texts if t]
    strings = [None, "", "x" * 40, "ab" * 20, "ba" * 20, "nowhere in any of these texts, forty long"]
    for n in (1, 2, 3, 5, 8, 9, 10, 16, 17, 18, 25, 39, 40, 41, 90):
        for _ in range(6):
            text = rng.choice([t for t in whole if len(t) >= n])
            at = rng.randint(0, len(text) - n)
            strings.append(text[at : at + n])
    frame = spark.createDataFrame([(s,) for s in strings * 2], "text string")
    got = containment.holders(frame, "text", spark.createDataFrame(texts, "id long, text string").withColumn("string", F.lit(1)).repartition(4), "id", "text")
    rows = [(r["string"], r["key"]) for r in got.collect()]
    want = {(s, key) for s in strings if s for key, text in texts if key is not None and text and s in text}
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_no_strings(spark):
    texts = spark.createDataFrame([(1, "abc")], "id long, text string")
    assert containment.holders(texts.where("false"), "text", texts, "id", "text").count() == 0
    assert containment.holders(texts, "text", texts.where("false"), "id", "text").count() == 0


def test_a_window_of_a_text_has_the_fingerprint_of_its_string():
    rng = random.Random(7)
    text = "".join(rng.choices("abc", k=2000))
    marks = set(containment.prints(text, 40).tolist())
    for at in range(0, 1960, 13):
        assert set(containment.prints(text[at : at + 40], 40).tolist()) <= marks
    other = "".join(rng.choices("abcdefghijklmnop", k=20_000))
    assert len(containment.prints(other, 40)) < len(other) / 9  # about two in twenty-two
