"""The corpus pipeline: quality rules, quality classifier, n-gram Jaccard join,
benchmark decontamination, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor
kept and returns a DataFrame; the caller (``run`` or another driver) writes it
as Parquet and reads it again for the next stage. The models of the first two
stages are fitted on the labelled rows of ``documents``, not on what is left of
them: the rules have removed most of the examples that the classifier needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratelens.llm import decontamination, encoding, length_buckets, ngram_join, quality_mil, quality_rules
from ratelens.llm.common import small_batches, table, written

#: Near duplicates of the pipeline: words of a shingle, least share of the union in percent.
NEAR_SIZE, NEAR_PERCENT = 5, 80


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    small_batches(spark)
    field = quality_rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.keep(docs, field)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality."""
    small_batches(spark)
    model = quality_mil.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_mil.keep(docs, model)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, on shingles of
    ``NEAR_SIZE`` words (op8's own query has its own setting)."""
    small_batches(spark)
    return ngram_join.keep(docs, size=NEAR_SIZE, percent=NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item."""
    small_batches(spark)
    return decontamination.keep(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in length buckets and token-budget batches."""
    small_batches(spark)
    return length_buckets.pack(docs, encoding.default_path())


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("ngram_join", ngram_join_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Learned models and a tokenizer: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
