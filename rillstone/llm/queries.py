"""The queries of this subpackage, each its operator over a whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import decontamination, lm_scoring, ngram_join, packing, quality_classifier, quality_rules, substring_dedup, token_counts, url_filters, warc
from rillstone.llm.oracles import ORACLE
from rillstone.runtime import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones hold."""
    kept = substring_dedup.assess(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages judged by the contract's rules, else by rules mined for low quality."""
    return url_filters.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), F.col("quality") == 0)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the windows of all benchmark items."""
    return decontamination.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets are 0.8 alike."""
    return ngram_join.assess(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a byte-level network."""
    return quality_classifier.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece lengths of all documents."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a hierarchical Pitman-Yor model."""
    return lm_scoring.assess(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics and the verdict on cross-document lines."""
    return quality_rules.assess(table(spark, sf_dir, "documents")).drop("row")


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_url_filters,
        op3_best_fit_packing,
        op4_benchmark_decontamination,
        op5_ngram_jaccard_join,
        op6_quality_classifier,
        op7_token_counts,
        op8_warc,
        op9_lm_scoring,
        op10_quality_rules,
    )
}

__all__ = ["ORACLE", "QUERIES"]
