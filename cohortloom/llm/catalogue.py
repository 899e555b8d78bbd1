"""The operators of this package as queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import decontaminate, hyperminhash, merkle, packing, pii, rotation_codes, separators, suffix_buckets, swap_packing, toxicity, trigram_secrets, wavelet, whitening
from cohortloom.llm.common import table


def op1_hyperminhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), size=4, percent=80)


def op2_weak_supervision_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(pii.find(table(spark, folder, "documents")))


def op3_separator_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return separators.token_counts(docs).select("doc_id", F.col("start").alias("file_start"), "n_tokens")


def op4_rotation_code_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return rotation_codes.near_duplicates(table(spark, folder, "embeddings"))


def op5_suffix_bucket_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_buckets.remove_repeats(table(spark, folder, "documents"))


def op6_order_preserving_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op7_trigram_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return trigram_secrets.report(trigram_secrets.scan(table(spark, folder, "documents")))


def op8_benchmark_windows(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.report(decontaminate.find_hits(docs, table(spark, folder, "benchmark")))


def op9_wavelet_token_index(spark: SparkSession, folder: str) -> DataFrame:
    return wavelet.token_index(table(spark, folder, "documents"))


def op10_convolutional_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )


def op11_bidiagonal_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings").select("vec_id", "embedding"))


def op12_swap_packing(spark: SparkSession, folder: str) -> DataFrame:
    return swap_packing.pack(table(spark, folder, "documents"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hyperminhash_dedup, op2_weak_supervision_pii, op3_separator_token_counts,
        op4_rotation_code_dedup, op5_suffix_bucket_dedup, op6_order_preserving_packing, op7_trigram_secret_scan, op8_benchmark_windows,
        op9_wavelet_token_index, op10_convolutional_toxicity, op11_bidiagonal_whitening, op12_swap_packing, op13_merkle_manifest,
    )
}
ORACLE: dict[str, str] = {
    "op1_hyperminhash_dedup": hyperminhash.OP1_SQL,
    "op4_rotation_code_dedup": rotation_codes.OP4_SQL,
    "op7_trigram_secret_scan": trigram_secrets.OP7_SQL,
    "op8_benchmark_windows": decontaminate.OP8_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
