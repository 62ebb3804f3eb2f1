"""A corpus from raw documents to packed sequences: each stage takes the documents that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidloom.llm import decontamination, line_dedup, packing, quality_rules, simhash
from evidloom.llm.common import fresh_path, read, scratch


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs, read(spark, sf_dir, "labels"))


def by_line(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand in earlier ones."""
    return line_dedup.dedup(docs)


def by_fingerprint(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return simhash.distinct_documents(docs)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences: a row for each piece."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", by_quality),
    ("line_dedup", by_line),
    ("simhash_near_dedup", by_fingerprint),
    ("benchmark_decontamination", by_benchmark),
    ("packing", packed),
]

#: XXH64 fingerprints and a tokenizer's ids can't be expressed in SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage has stored on its way is deleted when its documents are written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
