"""Corpus pipeline: from raw ``documents`` to token ids, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that the
stage before kept; ``run`` writes its result as Parquet to the shared folder and reads it
again as the input of the next.  All stages but the last return the columns of
``documents``.

Defined results: a null or empty text has no words, so the quality rules reject it; a null language
is a language and a null source a source of its own; a null id is kept and sorts after all others where
one of several documents stays; of repeated rows, as of all copies, one stays; very long texts
are taken whole; further columns pass through the stages unread, whatever their names; an empty table gives
an empty table.  Each function of a stage has these results alone, too.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, jaccard_join, mixing, quality_rules, span_dedup
from quillspark.llm.queries import FERTILITY
from quillspark.plans.shared import unused, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, FERTILITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of near-duplicates the document with the smallest id stays."""
    return jaccard_join.one_of_each(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: repeated passages go; a document of which nothing is left goes too."""
    n_all, n_gone = (unused(c, docs.columns) for c in ("n_sentences", "n_removed"))
    cut = span_dedup.drop_repeats(docs, added=(n_all, n_gone))
    cut = cut.where((F.col(n_gone) == 0) | F.col("text").rlike(r"[^ \t-\r]"))
    return cut.withColumn("n_chars", F.when(F.col(n_gone) > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: every document as often as the mixture takes it."""
    return mixing.mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the token ids of every text, checked by decoding them again."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_spans),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", token_ids),
]

#: The stages on tokenisers and near-duplicates are not expressible in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
