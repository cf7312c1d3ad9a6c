"""Words by letters inside them against a look at all words."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import grams


@pytest.fixture(scope="module")
def words(spark):
    rng = random.Random(4)
    some = {"".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(400)} | {"Abab", "ABAB", "aaaa", "a", "🙂ab🙂", ""}
    return spark.createDataFrame([(w, i) for i, w in enumerate(sorted(some))], "word string, total long").cache()


@pytest.mark.parametrize("needle", ["", "a", "ab", "AB", "aaa", "abab", "bcéa", "cabacé", "🙂a", "zz", "abcabcab"])
def test_needles(spark, words, needle):
    lists = grams.postings(words).cache()
    want = sorted((r.word, r.total) for r in words.collect() if needle.lower() in r.word.lower())
    for got in (grams.holding(needle, words), grams.holding(needle, words, lists, grams.counts(lists))):
        assert sorted((r.word, r.total) for r in got.collect()) == want


def test_the_rarest_list_is_read(spark, words):
    lists = grams.postings(words).cache()
    n = {r.gram: r.n for r in grams.counts(lists).collect()}
    needle = max(("".join(t) for t in itertools.product("abc", repeat=4)), key=lambda t: abs(n.get(t[:3], 0) - n.get(t[1:], 0)))
    rarest = min((needle[:3], needle[1:]), key=lambda g: n.get(g, 0))
    plan = grams.holding(needle, words, lists, grams.counts(lists))._jdf.queryExecution().optimizedPlan().toString()
    assert f"= {rarest})" in plan and n.get(rarest, 0) < words.count() / 4


def test_a_gram_counts_once_for_a_word(spark):
    rows = grams.postings(spark.createDataFrame([("Aaaa", 1)], "word string, total long")).select(F.col("gram")).collect()
    assert sorted(r.gram for r in rows) == ["aa", "aaa"]
