"""Ranked retrieval that leaves out blocks of texts which cannot reach the answer.

Texts lie in blocks of ``BLOCK`` neighbouring ids.  For every token and block the greatest frequency and the least length are
known, so the greatest weight that the token can have there; added up over a query's tokens they bound the scores of a
block's texts.  The blocks with the greatest bounds are scored first, until they have given ``k`` texts: the k-th of
these is a threshold.  Blocks whose bound is below it are not read.  The answer is that of an
exhaustive ranking, ties included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import BM25_B, BM25_K1, top_k

BLOCK, FIRST_BLOCKS, LISTED = 64, 8, 1000


def impacts(token_counts: DataFrame, lengths: DataFrame | None) -> DataFrame:
    """Rows (token, block, idx, tf, dl) from (token, idx, tf) and (idx, dl); ``token_counts`` may have dl itself."""
    return (token_counts if lengths is None else token_counts.join(lengths, "idx")).select("token", F.floor(F.col("idx") / BLOCK).cast("bigint").alias("block"), "idx", "tf", "dl")


def blocks(rows: DataFrame) -> DataFrame:
    """Rows (token, block, most, shortest): what bounds a token's weights in a block."""
    return rows.groupBy("token", "block").agg(F.max("tf").alias("most"), F.min("dl").alias("shortest"))


def _weight(tf: Column, dl: Column) -> Column:
    return F.col("idf") * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / F.col("avgdl")))


def best(rows: DataFrame, of_blocks: DataFrame, terms: DataFrame, k: int = 100) -> tuple[DataFrame, int, int]:
    """The ``k`` best (idx, score) for ``terms`` (token, idf, avgdl: the few words of a query), how many blocks were read for them, and how many have a token of the query."""
    asked = terms.collect()
    if not asked:
        return rows.sparkSession.createDataFrame([], "idx bigint, score double"), 0, 0
    words = [r.token for r in asked]
    known = terms.sparkSession.createDataFrame([(r.token, float(r.idf), float(r.avgdl)) for r in asked], "token string, idf double, avgdl double")
    bound = F.sum(F.greatest(_weight(F.col("most"), F.col("shortest")), F.lit(0.0))).alias("bound")
    bounds = of_blocks.where(F.col("token").isin(words)).join(F.broadcast(known), "token").groupBy("block").agg(bound).cache()
    try:
        every = bounds.count()

        def scored(chosen: DataFrame) -> DataFrame:
            few = [r.block for r in chosen.select("block").limit(LISTED + 1).collect()]
            mine = rows.where(F.col("token").isin(words))
            if len(few) <= LISTED:
                mine = mine.where(F.col("block").isin(few)) if few else mine.limit(0)
            else:
                mine = mine.join(chosen.select("block"), "block", "left_semi")
            return mine.join(F.broadcast(known), "token").groupBy("idx").agg(F.sum(_weight(F.col("tf"), F.col("dl"))).alias("score"))

        first, least = FIRST_BLOCKS, None
        while least is None and first < every:
            found = top_k(scored(bounds.orderBy(F.desc("bound"), "block").limit(first)), k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
            least, first = found.least if found.n >= k else None, first * 4
        left = bounds if least is None else bounds.where(F.col("bound") >= least - 1e-6 * max(1.0, abs(least)))
        read = left.count()
        answer = top_k(scored(left), k).collect()
    finally:
        bounds.unpersist()
    return rows.sparkSession.createDataFrame([(r.idx, r.score) for r in answer], "idx bigint, score double"), read, every

