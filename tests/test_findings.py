"""Small tests of what a review has found."""

import itertools
import operator
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.operators import phrase
from quillspark.plans import index, segments, shared
from quillspark.queries import AREAS

QUERIES = {n: q for area in AREAS for n, q in area.queries.items()}
ORACLE = {n: q for area in AREAS for n, q in area.oracle.items()}


def documents(spark, path, *texts):
    """A folder with documents of these texts."""
    rows = [(i, t, ("en", "de", "fr", "es")[i % 4], f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def both(spark, path, name):
    """Rows of a query and of its SQL."""
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    rel = con.sql(ORACLE[name])
    df = QUERIES[name](spark, path)
    return sorted(tuple(r[c] for c in rel.columns) for r in df.collect()), sorted(rel.fetchall())


def test_score_on_the_threshold_is_kept(spark, tmp_path):
    """Cosines of exactly 0.75, from texts whose scaled counts fall below it."""
    asked = (1, 1, 1, 1, 2, 1)  # of a, i, o, r, t, w
    counts = [c for c in itertools.product(range(4), repeat=6) if 16 * sum(map(operator.mul, c, asked)) ** 2 == 81 * sum(x * x for x in c) > 0]
    texts = [" ".join(letter for letter, n in zip("aiortw", c, strict=True) for _ in range(n)) for c in counts]
    got, want = both(spark, documents(spark, tmp_path, *texts), "dense_text")
    assert len(want) == len(texts)
    assert got == want


WORDS = ("thing", "thinging", "orantion", "of the", "the", "is", "Épée", "nicht", "thinerha, the a", "ſo", "in. the and")


def small(spark, path):
    return documents(spark, path, "", *(" ".join(WORDS[(i * j) % len(WORDS)] for j in range(1, i)) for i in range(2, 40)))


def shuffled_words(df):
    """Does the plan make a row for each word in Spark, as the in-row counts do not?"""
    return "Generate explode" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["bm25", "bm25_topk", "bm25_early", "kw_phrases", "kw_single", "doc_freq", "lex_grams"])
def test_counts_in_rows_match_sql(spark, tmp_path, name):
    path = small(spark, tmp_path)
    got, want = both(spark, path, name)
    assert got == want
    if name in ("bm25", "doc_freq"):
        assert not shuffled_words(QUERIES[name](spark, path))


def test_documents_that_share_an_id_are_counted_as_one(spark, tmp_path):
    path = small(spark, tmp_path / "a")
    rows = spark.read.parquet(f"{path}/documents.parquet")
    rows.unionByName(rows.where("doc_id % 5 = 0")).coalesce(1).write.parquet(f"{tmp_path}/b/documents.parquet")
    got, want = both(spark, f"{tmp_path}/b", "doc_freq")
    assert got == want


ODD = ["", None, "  ", "a, b", ", a  b.", "Épée_1 2x é́t Ⓐb ⅷ x‍y İs ΣΑΣ ſo", "the the, the " * 900, "ႠႡ ⴀbc აბ", "日本 語、 x"]


def odd(spark):
    rows = [(i, t, ("en", "de", "fr", "es")[i % 4], f"src{i % 3}", len(t or "")) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.mark.parametrize("name", ["tokens_by_text", "words_by_text"])
def test_words_by_text_are_counted_in_the_row_of_the_text(spark, monkeypatch, name):
    """The same rows as of words that meet in a shuffle."""
    made = getattr(segments._Given(spark, odd(spark).where("doc_id <> 5")), name)()
    assert not shuffled_words(made)
    monkeypatch.setattr(segments._Given, "distinct_ids", lambda self: False)
    want = getattr(segments._Given(spark, odd(spark).where("doc_id <> 5")), name)()
    assert shuffled_words(want) and sorted(made.select(*want.columns).collect()) == sorted(want.collect())


def test_places_of_words_are_made_in_the_row_of_the_text(spark):
    """The same rows as of words that meet in a shuffle; a row covers 1,024 words."""
    texts = odd(spark).select(F.col("doc_id").alias("idx"), F.lit("new").alias("translation"), "text")
    made = phrase.positions(texts)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    each = texts.select("idx", "translation", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+\W*"), F.lit(0))).alias("pos", "piece"))
    each = each.withColumn("token", F.regexp_extract("piece", r"(?U)\w+", 0)).withColumn("gap", F.expr("substring(piece, char_length(token) + 1)"))
    want = {}
    for r in sorted(each.collect(), key=lambda r: (r.idx, r.pos)):
        want.setdefault((r.token, r.idx, r.translation, r.pos // phrase.BLOCK), []).append((r.pos, r.gap))
    rows = sorted((k[:3] + (v[0][0], [b[0] - a[0] for a, b in itertools.pairwise([(-1,), *v])], [g for _, g in v]) for k, v in want.items()))
    assert sorted((r.token, r.idx, r.translation, r.steps[0] - 1, r.steps, r.gaps) for r in made.collect()) == rows


def test_index_of_token_statistics_holds_no_other_tables(spark, tmp_path):
    path = small(spark, tmp_path / "in")
    held = lambda: {d for top, dirs, _ in os.walk(shared.shared_dir(spark).removeprefix("file://")) if "/segments-" in top and os.path.basename(os.path.dirname(top)) == "segments" for d in [top]}
    before = held()
    got, want = both(spark, path, "index_changes")
    assert got == want
    written = held() - before
    assert len(written) == 2 and all(set(os.listdir(d)) == {"gone", *segments.STATISTICS} for d in written)


def test_index_of_token_statistics_over_shared_ids(spark, tmp_path):
    path = small(spark, tmp_path / "a")
    rows = spark.read.parquet(f"{path}/documents.parquet")
    rows.unionByName(rows.where("doc_id % 5 = 0")).coalesce(1).write.parquet(f"{tmp_path}/b/documents.parquet")
    got, want = both(spark, f"{tmp_path}/b", "index_changes")
    assert got == want


def test_index_without_tables_of_searches_is_not_used_for_them(spark, tmp_path):
    path, out = small(spark, tmp_path / "in"), f"{tmp_path}/index"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    now = segments.Segments(spark, out, holds=segments.STATISTICS).commit(docs, None, index._files(spark, path))
    assert now.table("corpus").first().n == docs.count() and now.table("impacts").count() > 0
    again = segments.Segments(spark, out).commit(docs.where("doc_id = 3"), None)
    assert again.merge(2).table("tokens").count() == now.table("tokens").count()
    for table in ("postings", "positions", "words", "lexicon"):
        with pytest.raises(ValueError, match="without"):
            again.table(table)
    with pytest.raises(ValueError, match="lacks"):
        segments._used(now, path)
    assert index.known(spark, path) is None


@pytest.mark.parametrize("sent", [0, 100])
def test_many_ids_are_sent_to_the_tasks_or_met_in_a_shuffle(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(segments, "LISTED", 3)
    monkeypatch.setattr(segments, "SENT", sent)
    docs = spark.read.parquet(small(spark, tmp_path / "in") + "/documents.parquet")
    now = segments.Segments(spark, f"{tmp_path}/index", holds=segments.STATISTICS).commit(docs, None)
    few = now._of(docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("idx")), "texts")
    assert "ResolvedHint (strategy=broadcast)" in few._jdf.queryExecution().analyzed().toString() or not sent
    assert sorted(r.idx for r in few.collect()) == [r.doc_id for r in docs.where("doc_id % 3 = 0").orderBy("doc_id").collect()]
    less = now.commit(None, docs.where("doc_id % 3 = 0").select("doc_id"))
    assert less.manifest["n"] == docs.where("doc_id % 3 <> 0").count()
