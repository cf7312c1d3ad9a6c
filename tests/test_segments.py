"""The index that takes changes, against SQL over the documents as they are then."""

import json
import os

import duckdb
import pytest

from quillspark.plans import index, segments
from quillspark.plans.adapters import Views
from quillspark.queries import AREAS

from .test_oracles import INDEXED, ORACLE, QUERIES, table


def write(rows, folder):
    """Documents as one file of their own, in place of another."""
    rows.toPandas().to_parquet(f"{folder}/new.parquet")
    os.replace(f"{folder}/new.parquet", f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def changed(spark, sf_dir, tmp_path_factory):
    """An index that has seen additions, changes and removals, and its input folder."""
    folder = tmp_path_factory.mktemp("changing")
    for name in ("embeddings", "benchmark"):
        os.symlink(f"{sf_dir}/{name}.parquet", folder / f"{name}.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sf, out = str(folder), str(folder / "index")
    write(docs.where("doc_id % 4 <> 1"), folder)
    segments.build(spark, sf, out)
    longer = "concat(text, ' The thing, the thingness of the oran thing')"
    edited = docs.where("doc_id % 7 <> 3").selectExpr("doc_id", f"if(doc_id % 5 = 2, {longer}, text) as text", "if(doc_id % 11 = 5, 'en', lang) as lang", "source", f"if(doc_id % 5 = 2, length({longer}), n_chars) as n_chars")
    write(edited, folder)
    segments.refresh(spark, sf, out)
    write(edited.where("doc_id <> 2").unionByName(docs.where("doc_id = 3").selectExpr("doc_id + 5000 as doc_id", "text", "lang", "source", "n_chars")), folder)
    now = segments.refresh(spark, sf, out)
    assert len(now.segments) == 3 and now.segments[1]["gone"] > 20 and now.segments[2] | {"name": ""} == {"name": "", "texts": 1, "gone": 1, "level": 0}
    yield sf, out
    index.forget(spark, sf)


def sql(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return con


@pytest.mark.parametrize("name", INDEXED)
def test_query_over_changed_segments_equals_sql(spark, changed, name):
    sf, _ = changed
    df, rel = QUERIES[name](spark, sf), sql(sf).sql(ORACLE[name])
    assert table(df.collect(), df.columns) == table(rel.fetchall(), rel.columns)


def tables(now):
    return {n: sorted(map(str, now.table(n).collect())) for n in ("postings", "positions", "lengths", "texts", "tokens", "words", "lexicon", "word_forms")} | {"corpus": [round(x, 9) for x in now.table("corpus").first()]}


def test_merges_change_no_table_and_a_fresh_build_agrees(spark, changed, tmp_path):
    sf, out = changed
    now = segments.Segments(spark, out)
    want = tables(now)
    two, one = now.merge(2), now
    assert len(two.segments) == 2 and tables(two) == want
    one = two.merge(2)
    assert len(one.segments) == 1 and one.segments[0]["gone"] == 0 and tables(one) == want
    fresh = segments.build(spark, sf, f"{tmp_path}/fresh")
    assert tables(fresh) == want
    segments.use(spark, sf, out)


def test_small_commits_are_merged_in_tiers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FAN_OUT", 2)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    doc = lambda i, text: spark.createDataFrame([(i, text, "en", "s", len(text))], schema)
    now = segments.Segments(spark, f"{tmp_path}/index")
    for i in range(3):
        now = now.commit(doc(i, f"one two word{i} two"), None)
    assert [s["texts"] for s in now.segments] == [2, 1]
    now = now.commit(doc(0, "changed text"), spark.createDataFrame([(2,), (99,)], "doc_id long"))
    got = {r.token: (r.df, r.total) for r in now.table("tokens").collect()}
    assert got == {"one": (1, 1), "two": (1, 2), "word": (1, 1), "change": (1, 1), "d": (1, 1), "text": (1, 1)}
    assert now.manifest["n"] == 2
    emptied = now.commit(None, spark.createDataFrame([(0,), (1,)], "doc_id long"))
    assert emptied.manifest["n"] == 0 and emptied.manifest["length"] == 0 and emptied.table("postings").count() == 0 and emptied.table("tokens").count() == 0 and emptied.table("corpus").first().mean_idf is None


def test_a_commit_reads_and_writes_what_has_changed(spark, changed):
    sf, out = changed
    sizes = lambda s: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{out}/segments/{s['name']}") for f in files if f.endswith(".parquet"))
    first = json.loads(open(f"{out}/manifest/00000003.json").read())["segments"]
    assert sizes(first[2]) < sizes(first[0]) / 5
    with pytest.raises(RuntimeError):  # another writer was first
        segments.Segments(spark, out, 2)._next([], 0, 0, "")
    old = segments.Segments(spark, out, 1)  # earlier versions stay readable
    assert old.manifest["n"] == old.table("texts").count() and len(old.segments) == 1
    plan = segments.Segments(spark, out, 3)._of(spark.createDataFrame([(5,), (6,)], "idx long"), "token_rows")._jdf.queryExecution().toString()
    assert "In(idx, [5,6])" in plan


def test_other_files_are_refused_until_refreshed(spark, changed):
    sf, out = changed
    segments.use(spark, sf, out)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    write(docs.where("doc_id <> 4"), sf)
    with pytest.raises(ValueError):
        segments.use(spark, sf, out)
    now = segments.refresh(spark, sf, out)
    assert now.segments[-1]["gone"] == 1 and now.table("texts").where("idx = 4").count() == 0
    assert segments.refresh(spark, sf, out).version == now.version  # nothing has changed
    assert Views(spark, sf).index is not None and AREAS
