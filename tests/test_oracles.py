"""Every query of the library against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillspark.queries import AREAS

QUERIES = {n: q for area in AREAS for n, q in area.queries.items()}
ORACLE = {n: q for area in AREAS for n, q in area.oracle.items()}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return [plain(v) for v in value]
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(plain(r[i])) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rel = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = table(df.collect(), df.columns), table(rel.fetchall(), rel.columns)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


INDEXED = [
    "postings", "doc_freq", "expand_forms", "word_forms", "ud_groups", "group_exclude", "kw_single", "kw_and", "kw_topk", "kw_filtered", "kw_translation", "kw_facets", "kw_totals", "kw_phrase", "kw_phrases", "set_intersect", "highlight", "bm25", "bm25_topk", "bm25_early", "rrf",
    "exact_tier", "semantic_anti", "hybrid_guard", "rerank_exact", "rerank_sem", "hybrid", "mean_pool", "lexicon", "lex_scopes", "lex_scope_stats", "lex_letters", "lex_meta", "book_stats", "lex_trans_scope", "lex_page", "lex_search", "lex_grams",
    "word_stats", "word_distribution", "word_verses", "verse_words", "word_locations",
]


@pytest.fixture(scope="module")
def indexed(spark, sf_dir, tmp_path_factory):
    from quillspark.plans import index

    index.build(spark, sf_dir, f"file://{tmp_path_factory.mktemp('index')}/1")
    yield
    index.forget(spark, sf_dir)


@pytest.mark.parametrize("name", INDEXED)
def test_query_over_the_stored_index_matches_sql(spark, duck, sf_dir, indexed, name):
    test_query_matches_sql(spark, duck, sf_dir, name)


def test_stored_index_is_refused_for_other_files(spark, sf_dir, tmp_path):
    import shutil

    from quillspark.plans import index

    (tmp_path / "in").mkdir()  # of its own mode: the data folder may be read-only
    shutil.copyfile(f"{sf_dir}/documents.parquet", tmp_path / "in" / "documents.parquet")
    index.build(spark, f"{tmp_path}/in", f"{tmp_path}/index")
    rows = spark.read.parquet(f"{tmp_path}/in/documents.parquet").limit(5).toPandas()
    (tmp_path / "in" / "documents.parquet").unlink()
    rows.to_parquet(tmp_path / "in" / "documents.parquet")
    with pytest.raises(ValueError):
        index.use(spark, f"{tmp_path}/in", f"{tmp_path}/index")
    index.forget(spark, f"{tmp_path}/in")
