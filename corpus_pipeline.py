"""A corpus in five stages: known languages, one of each near-duplicate, masked, mixed, packed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from arborlog.llm import langid, mixing, packing, pii, simhash
from arborlog.llm.common import pinned, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 5: documents without a recognised language go."""
    return langid.accepted(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 7: of each group of near-duplicates the document with the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 2: plain and disguised personal data is masked."""
    return pii.masked(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 1: each document appears as often as the weighted mix of sources takes it, which may be never or twice."""
    return mixing.mixed(docs)


def packing_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 10: pieces of sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixing", mixing_weights),
    ("packing", packing_windows),
]

#: Trained models, fingerprints and tokenizers can't be told in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. Each result but the last is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        pinned(spark.range(1))  # picks the folder
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
