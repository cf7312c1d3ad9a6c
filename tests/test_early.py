"""Retrieval that leaves blocks out against the ranking of all texts."""

import random

import pytest

from quillspark.operators import early, search


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        rare = i // 64 in (3, 40, 41)  # a few blocks have what is asked for often
        for token in ("a", "b", "c", "d"):
            tf = rng.randint(2, 9) if rare and token != "d" else rng.choice([0, 0, 0, 1])
            if tf:
                rows.append((token, i, tf))
        rows.append(("filler", i, rng.randint(5, 60)))
    counts = spark.createDataFrame(rows, "token string, idx long, tf long").cache()
    verses = spark.range(4010).withColumnRenamed("id", "idx")
    lengths, tokens, facts = search.bm25_statistics(counts, verses)
    ranked = early.impacts(counts, lengths).cache()
    return counts, verses, ranked, early.blocks(ranked).cache(), tokens.cache(), facts.cache()


@pytest.mark.parametrize("words", [["a"], ["a", "b", "c"], ["d"], ["a", "d", "filler"], ["none"], ["a", "none"]])
@pytest.mark.parametrize("k", [1, 10, 100, 5000])
def test_the_answer_is_that_of_all_blocks(spark, corpus, words, k):
    counts, verses, ranked, blocks, tokens, facts = corpus
    asked = spark.createDataFrame([(w,) for w in words], "form string")
    want = [(r.idx, round(r.score, 9)) for r in search.top_k(search.bm25(counts, verses, asked), k).collect()]
    got, read, every = early.best(ranked, blocks, search.bm25_terms(tokens, facts, asked), k)
    assert [(r.idx, round(r.score, 9)) for r in search.top_k(got, k).collect()] == want
    assert read <= every
    if words == ["a", "b", "c"] and k <= 100:
        assert read <= 8 < every  # the blocks that have them often, hardly any other


def test_many_blocks_are_joined_and_not_listed(spark, corpus, monkeypatch):
    counts, verses, ranked, blocks, tokens, facts = corpus
    monkeypatch.setattr(early, "LISTED", 2)
    asked = spark.createDataFrame([("a",), ("d",)], "form string")
    got, _, _ = early.best(ranked, blocks, search.bm25_terms(tokens, facts, asked), 50)
    assert sorted(r.idx for r in got.collect()) == sorted(r.idx for r in search.top_k(search.bm25(counts, verses, asked), 50).collect())
