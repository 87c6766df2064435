"""One registered query per operator, bound to the whole tables, and the DuckDB
twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratelens.llm import (
    conversation_trie,
    decontamination,
    encoding,
    extendible_sharding,
    filter_audit,
    length_buckets,
    ngram_join,
    quality_mil,
    quality_rules,
    token_counts,
    token_pack,
    toxicity,
    url_filter,
    warc,
)
from ratelens.llm.common import small_batches, table, written

#: The id appended to each document by the packed output.
END_ID = 2


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op2_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    index = token_pack.write(table(spark, sf_dir, "documents"), encoding.default_path(), END_ID)
    return token_pack.read(index).drop("file")


def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return length_buckets.pack(table(spark, sf_dir, "documents"), encoding.default_path())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_sharding.assign(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return quality_mil.score(docs, quality_mil.fit(docs, table(spark, sf_dir, "labels")))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(url_filter.seed_rows(), "url string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), labelled, threshold=None)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    counted = token_counts.lengths(table(spark, sf_dir, "documents"), encoding.default_path(), extra=1)
    return token_counts.suffix_sums(written(spark, token_counts.histogram(counted), "token-histogram"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    files = warc.write(table(spark, sf_dir, "pages"))
    return warc.pages(warc.read(files, payloads=False))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules,
    op2_bit_packing,
    op3_length_buckets,
    op4_toxicity,
    op5_extendible_hashing,
    op6_decontamination,
    op7_quality_classifier,
    op8_ngram_join,
    op9_url_filter,
    op10_token_counts,
    op11_filter_audit,
    op12_conversation_trie,
    op13_warc,
)}

ORACLE = {
    "op5_extendible_hashing": extendible_sharding.oracle(),
    "op6_decontamination": decontamination.oracle(),
    "op8_ngram_join": ngram_join.oracle(),
    "op11_filter_audit": filter_audit.oracle(),
    "op12_conversation_trie": conversation_trie.oracle(),
    "op13_warc": warc.oracle(),
}
