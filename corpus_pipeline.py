"""A corpus from raw documents to packed pieces, stage by stage.

Every stage reads what the stage before it kept, from Parquet, and returns the
columns of the documents; the last one returns the packed pieces. Null and empty
texts pass every filter; an empty table gives an empty corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import decontaminate, hyperminhash, packing, pii, toxicity
from cohortloom.session import discard, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of these documents, doesn't reject."""
    return toxicity.remove(docs, docs, spark.read.parquet(f"{folder}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return hyperminhash.remove(docs, size=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that aren't contaminated, without the passages of the benchmark."""
    return decontaminate.remove(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]
# Tokenizers and trained models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, step in STAGES[:-1]:
        before = docs
        try:
            docs = stage(step(spark, before, folder), f"corpus-{name}")
        finally:
            # What the stage before kept is read by this one alone.
            discard(before)
    return STAGES[-1][1](spark, docs, folder)
