"""The index of vectors against a look at every pair."""

import numpy as np
import pytest

from quillspark.plans import vectors

KIND = "vec_id long, embedding array<float>"


def frame(spark, rows):
    return spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], KIND)


def answers(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r.query, []).append((r.key, r.score, r.rank))
    return out


def brute(rows, asked, k):
    out = {}
    for q, a in asked:
        a = np.asarray(a, np.float64)
        scored = []
        for key, b in rows:
            b = np.asarray(b, np.float64)
            scored.append((-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 9), key))
        out[q] = [(key, -s, i + 1) for i, (s, key) in enumerate(sorted(scored)[:k])]
    return out


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(40, 16))
    return [(i, np.float32(middles[i % 40] + 0.3 * rng.normal(size=16))) for i in range(3000)]


def test_exact_search_is_brute_force(spark, cloud):
    rows = frame(spark, cloud)
    asked = [r for r in cloud if r[0] % 300 == 0]
    assert answers(vectors.exact(rows, frame(spark, asked), "vec_id", "embedding", 20)) == brute(cloud, asked, 20)


def test_recall_and_scores_of_clustered_vectors(spark, cloud):
    rows = frame(spark, cloud)
    queries = rows.where("vec_id % 50 = 0")
    index = vectors.build(rows, "vec_id", "embedding")
    want, got = (answers(df) for df in (vectors.exact(rows, queries, "vec_id", "embedding"), index.search(queries, "vec_id", "embedding")))
    assert index.model.probes < len(index.model.centres) / 2  # most lists are left alone
    assert sum(len({k for k, _, _ in want[q]} & {k for k, _, _ in got[q]}) for q in want) >= 0.95 * 100 * len(want)
    scores = {(q, k): s for q in want for k, s, _ in want[q]}
    assert all(abs(scores[q, k] - s) < 2e-9 for q in got for k, s, _ in got[q] if (q, k) in scores)


def test_recall_of_vectors_without_clusters(spark):
    rng = np.random.default_rng(6)
    rows = frame(spark, enumerate(rng.normal(size=(3000, 16))))
    queries = rows.where("vec_id % 50 = 0")
    want, got = (answers(df) for df in (vectors.exact(rows, queries, "vec_id", "embedding"), vectors.build(rows, "vec_id", "embedding").search(queries, "vec_id", "embedding")))
    assert sum(len({k for k, _, _ in want[q]} & {k for k, _, _ in got[q]}) for q in want) >= 0.95 * 100 * len(want)


def test_all_lists_and_all_candidates_give_the_exact_answer(spark, cloud, monkeypatch):
    monkeypatch.setattr(vectors, "SHARDS", 3)
    monkeypatch.setattr(vectors, "BLOCK", 100)
    rows = frame(spark, cloud)
    asked = [r for r in cloud if r[0] % 300 == 0]
    index = vectors.build(rows, "vec_id", "embedding")
    assert index.shards == 3
    got = answers(index.search(frame(spark, asked), "vec_id", "embedding", 20, probes=len(index.model.centres), depth=3000))
    want = brute(cloud, asked, 20)
    assert {q: [k for k, _, _ in a] for q, a in got.items()} == {q: [k for k, _, _ in a] for q, a in want.items()}


def test_a_third_of_all_rows_is_one_vector(spark, cloud):
    rows = cloud + [(5000 + i, cloud[7][1]) for i in range(1500)]
    index = vectors.build(frame(spark, rows), "vec_id", "embedding")
    got = answers(index.search(frame(spark, [(7, cloud[7][1])]), "vec_id", "embedding", 30))
    assert [k for k, _, _ in got[7]] == [7, *range(5000, 5029)]


def test_what_is_no_vector_is_nowhere(spark):
    odd = [(0, None), (1, []), (2, [0, 0]), (3, [1, None]), (4, [1, float("nan")]), (5, [float("inf"), 1]), (6, [1, 2, 3])]
    good = [(10 + i, [1, i]) for i in range(9)]
    rows = frame(spark, odd[:6] + good).selectExpr("*", "1 as list", "2 as key")
    got = answers(vectors.build(rows, "vec_id", "embedding").search(rows.unionByName(frame(spark, odd[6:]), True), "vec_id", "embedding", 3))
    assert set(got) == {k for k, _ in good} and all(len(a) == 3 and {k for k, _, _ in a} <= set(got) for a in got.values())
    assert answers(vectors.exact(rows, frame(spark, odd), "vec_id", "embedding")).keys() == set()


def test_no_vectors(spark):
    none = frame(spark, [])
    assert vectors.build(none, "vec_id", "embedding").search(none, "vec_id", "embedding").count() == 0
    assert vectors.exact(none, none, "vec_id", "embedding").count() == 0
