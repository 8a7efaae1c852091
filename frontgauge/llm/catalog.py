"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from frontgauge.llm import (
    language_id,
    lexical_search,
    mixing,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    substring_dedup,
    token_alignment,
    toxicity,
    url_filter,
    vector_join,
)
from frontgauge.llm.common import fold_of, table

QUALITY_FOLDS, QUALITY_CUTOFF = 5, 0.3
TOXIC_FOLDS, TOXIC_CUTOFF = 3, 0.7

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    held_out = fold_of(F.col("doc_id"), QUALITY_FOLDS) == 0
    return quality_classifier.score(
        table(spark, folder, "documents"), table(spark, folder, "labels"), ~held_out
    ).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_CUTOFF).cast("int").alias("predicted"),
    )


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "pages"), table(spark, folder, "documents"))


def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.classes(table(spark, folder, "documents")).drop("k1", "k2")


def op4_vector_join(spark: SparkSession, folder: str) -> DataFrame:
    return vector_join.join(table(spark, folder, "embeddings"))


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(table(spark, folder, "documents"))


def op6_curve_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op7_ring_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(table(spark, folder, "documents"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held_out = fold_of(F.col("doc_id"), TOXIC_FOLDS) == 1
    return toxicity.score(
        table(spark, folder, "documents"), table(spark, folder, "labels"), ~held_out
    ).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_CUTOFF).cast("int").alias("predicted"),
    )


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"))


def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that no earlier document holds in a window of 13, as a digest."""
    return substring_dedup.strip(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment of both tokenizers on every document, judged by the counts of all."""
    return token_alignment.align(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_quality_classifier,
        op2_language_id,
        op3_near_dedup,
        op4_vector_join,
        op5_source_mixing,
        op6_curve_packing,
        op7_ring_sharding,
        op8_quality_rules,
        op9_toxicity,
        op10_url_filter,
        op11_substring_dedup,
        op12_lexical_search,
        op13_token_alignment,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run
SQL: dict[str, str] = {
    "op4_vector_join": vector_join.ORACLE_SQL,
    "op11_substring_dedup": substring_dedup.ORACLE_SQL,
    "op12_lexical_search": lexical_search.ORACLE_SQL,
}
