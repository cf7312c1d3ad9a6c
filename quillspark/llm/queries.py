"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, divergence, embedding_dedup, importance, jaccard_join, language_model, mixing, pieces, quality_model, quality_rules, span_dedup, wordpiece


#: The vocabularies that operator 8 measures with.
FERTILITY = [public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.learn_and_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.drop_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_counts(_table(spark, sf_dir, "documents")).drop("class")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), FERTILITY)


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.train_and_score(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source", "copies")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_quality_model": op2_quality_model,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_wordpiece": op4_wordpiece,
        "op5_span_dedup": op5_span_dedup,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_chat": op7_chat,
        "op8_quality_rules": op8_quality_rules,
        "op9_language_model": op9_language_model,
        "op10_mixing": op10_mixing,
        "op11_divergence": op11_divergence,
        "op12_importance": op12_importance,
        "op13_pieces": op13_pieces,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_embedding_dedup": embedding_dedup.ORACLE,
        "op6_jaccard_join": jaccard_join.ORACLE,
        "op7_chat": chat.ORACLE,
        "op10_mixing": mixing.ORACLE,
        "op11_divergence": divergence.ORACLE,
        "op12_importance": importance.ORACLE,
    }
