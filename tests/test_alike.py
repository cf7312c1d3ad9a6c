"""Small tests of words alike in form and meaning, against the SQL."""

import math
import random

import duckdb
import pytest

from quillspark.operators import alike
from quillspark.plans import index
from quillspark.queries import AREAS

QUERIES = {n: q for area in AREAS for n, q in area.queries.items()}
ORACLE = {n: q for area in AREAS for n, q in area.oracle.items()}
STEMS = ("thing", "Straß", "éclai", "東京都庁前", "abcde")
TAILS = ("", "s", "er", "ers", "erei", "ereien", "ßen", "ßens", "é", "és", "able", "ably", "xy", "z", "zzzz", "zzzzzz")


def folder(spark, path, shared=False):
    """Documents, some without a vector, and vectors of all kinds."""
    rng = random.Random(5)
    words = [s + t for s in STEMS for t in TAILS] + ["the", "four", "five5five"]
    centres = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(3)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(90)]
    vectors = [(i, [x + rng.gauss(0, 0.3) for x in centres[i % 3]]) for i in range(75)]
    texts += ["null0vector nullvectors", "zerovector, zerovectors", "lonely lonelys", "lonelys lonely", texts[8], texts[9], ""]
    vectors += [(90, None), (91, [0.0] * 4), (92, [1.0, 2.0, 3.0, 4.0]), (93, [1.0, 2.0, 3.0, 4.5]), (94, [None, 1.0, None, 2.0]), (95, [1.0, 2.0, 3.0, None]), (96, [1.0] * 4), (500, [1.0] * 4), (None, [1.0] * 4), (3, [0.5, -1.0, 2.0, 0.0]), (3, None)]
    rows = [(i, t, ("en", "de", "fr", "es")[i % 4], f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    if shared:
        rows += [(i, " ".join(rng.choice(words) for _ in range(5)), "en", "src0", 20) for i in range(0, 60, 7)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(*v, 0) for v in vectors], "vec_id bigint, embedding array<float>, label int").repartition(2).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def rows(found):
    return sorted((a, b, "nan" if math.isnan(c) else f"{c:.6f}") for a, b, c in found)


def wanted(path):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    return rows(con.sql(f"select a, b, cosine from ({ORACLE['vec_pairs']})").fetchall())


def got(spark, path):
    return rows(QUERIES["vec_pairs"](spark, path).select("a", "b", "cosine").collect())


@pytest.mark.parametrize("shared", [False, True])
def test_pairs_match_sql(spark, tmp_path, shared):
    """Vectors of zeros, without some numbers, null and repeated ones are as in the SQL."""
    path = folder(spark, tmp_path, shared)
    want = wanted(path)
    assert len(want) > 100 and ("zerovector", "zerovectors", "nan") in want and ("lonely", "lonelys") in {w[:2] for w in want}
    assert got(spark, path) == want


@pytest.mark.parametrize("sizes", [{"BLOCK": 4 * 8 * 30}, {"PLACES": 1, "ROWS": 3}, {"FEW": 1, "CELLS": 64, "ROWS": 8}])
def test_any_cut_of_stems_and_texts_gives_the_same_pairs(spark, tmp_path, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(alike, name, value)
    monkeypatch.setattr("quillspark.operators.bags.TEXTS", 7)
    path = folder(spark, tmp_path)
    assert got(spark, path) == wanted(path)


def test_pairs_of_postings_of_an_index_match_sql(spark, tmp_path):
    path = folder(spark, tmp_path / "in")
    index.build(spark, path, f"{tmp_path}/index")
    try:
        assert got(spark, path) == wanted(path)
    finally:
        index.forget(spark, path)


def test_vectors_do_not_travel_with_pairs_or_places(spark, tmp_path):
    """Sums of many texts are all that is shuffled: one row for a word, however many texts it has; pairs are made where a stem is."""
    texts = [(i, "stemmed stemming stemmings " * 3, "en", "src0", 80) for i in range(400)]
    spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i % 7)], 0) for i in range(400)], "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = QUERIES["vec_pairs"](spark, str(tmp_path))
    assert rows(df.collect()) == wanted(tmp_path)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "Join" not in plan  # AQE shows the exchange as it began and as it ended
    moved = alike._sums(alike.written(spark.createDataFrame([(["stemmed", "stemming"], [1.0, 2.0])] * 400, "tokens array<string>, embedding array<float>").coalesce(1)), 2, alike.np.float32)
    assert [(r.token, r.n) for r in moved.orderBy("token").collect()] == [("stemmed", 400), ("stemming", 400)]
