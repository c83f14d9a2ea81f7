"""A training corpus from `documents` in five stages: quality rules, near-dedup, secret scan, mixing, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet in the folder that the cluster shares and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factgraph.llm import minhash, mixing, packing, quality_rules, secret_scan
from factgraph.llm._spark import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id."""
    return minhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return secret_scan.redact_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each document and pass."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its place in a sequence."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("secret scan", secrets), ("mixing", mix), ("packing", pack)]

#: Near-dedup, mixing and packing can't be expressed in SQL; tests/llm holds run() against a brute-force version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
