"""The corpus pipeline: each stage's result is written as Parquet and is the next one's documents.

The first four stages return the columns of documents; the last returns pieces
of the documents that are left, each with its place in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillstone.llm import decontamination, ngram_join, packing, quality_rules, substring_dedup
from rillstone.runtime import remove, table, work_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and lines above the limit from the others."""
    return quality_rules.filter_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents 0.8 alike the one with the smallest id stays."""
    return ngram_join.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document also holds go, and documents that hold nothing else."""
    return substring_dedup.remove(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 1024."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]
#: No SQL expresses connected components over all pairs, or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table documents, each result written beside the checkpoints and read again.

    A stage's files go when the next one's are written; the last one's stay for
    the caller, until `rillstone.runtime.cleanup`.
    """
    docs = table(spark, sf_dir, "documents")
    path = work_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        if k:
            remove(spark, f"{path}/{k - 1}")
    return docs
