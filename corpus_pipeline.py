"""The corpus pipeline: rules, classifier, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns a DataFrame; all but the last keep the columns of `documents`. `run` writes each
stage's result as Parquet to the shared folder and reads it again for the next, so a
lost executor costs tasks and never a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frontgauge.llm import mixing, near_dedup, packing, quality_classifier, quality_rules
from frontgauge.llm.common import fold_of, table
from frontgauge.session import settle

# A document goes if it is likelier than this to be junk; clean documents score far above.
CUTOFF = 0.3
FOLDS = 5


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under CUTOFF go. One fold of ids is left for evaluation."""
    learn = fold_of(F.col("doc_id"), FOLDS) != 0
    return quality_classifier.keep(docs, table(spark, sf_dir, "labels"), learn, CUTOFF)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("source_mixing", mixing_stage),
    ("curve_packing", packing_stage),
]

# Hashes, signatures and token ids have no counterpart in SQL; tests/llm compares the
# stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
