"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shoptrace.llm import (
    centroid_clustering,
    decontamination,
    fingerprints,
    mixing,
    near_dedup,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    sharding,
    suffix_dedup,
    token_counts,
    vector_codes,
)
from shoptrace.llm.shared import documents, ship


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(documents(spark, folder))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return quality_rules.judge(documents(spark, folder))


def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return near_dedup.near_duplicates(documents(spark, folder))


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_spans(documents(spark, folder))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(packing.token_lengths(documents(spark, folder)))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return mixing.schedule(documents(spark, folder))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return quality_classifier.classify(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return fingerprints.fingerprints(documents(spark, folder))


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return suffix_dedup.repeated_strings(documents(spark, folder))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return token_counts.length_histogram(documents(spark, folder))


def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return centroid_clustering.cluster_report(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return decontamination.contamination_report(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return vector_codes.code_report(spark.read.parquet(f"{folder}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding, op2_quality_rules, op3_near_dedup, op4_pii, op5_packing, op6_mixing, op7_quality_classifier,
        op8_fingerprints, op9_suffix_dedup, op10_token_counts, op11_centroid_clustering, op12_decontamination, op13_vector_codes,
    )
}
ORACLE: dict[str, str] = {
    "op1_sharding": sharding.ORACLE,
    "op11_centroid_clustering": centroid_clustering.ORACLE,
    "op12_decontamination": decontamination.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
