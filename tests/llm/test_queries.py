"""The operators' queries against their SQL twins."""

import duckdb
import pytest

from quillspark.llm import queries

from ..test_oracles import table


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    folder = sf_dir.replace("sf0.001", "sf0.01") if name == "op6_jaccard_join" else sf_dir  # where there are links
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df, rel = queries.queries()[name](spark, folder), con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert table(df.collect(), df.columns) == table(rel.fetchall(), rel.columns)


def test_near_vectors_match_sql_where_there_are_links(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    both = df.unionByName(df.selectExpr("vec_id + 1000 as vec_id", "transform(embedding, (x, i) -> cast(x + 0.01 * sin(i * vec_id) as float)) as embedding", "label").where("vec_id % 3 > 0"))
    both.unionByName(both.where("vec_id < 5").selectExpr("-vec_id - 1 as vec_id", "if(vec_id = 0, null, embedding) as embedding", "label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got, want = queries.op3_embedding_dedup(spark, str(tmp_path)), con.sql(queries.oracle_sql()["op3_embedding_dedup"])
    assert table(got.collect(), got.columns) == table(want.fetchall(), want.columns) and got.where("n_links > 0").count() > 300
