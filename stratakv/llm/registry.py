"""The queries of the ten operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination,
    exact_dedup,
    licenses,
    minhash,
    pii,
    quality,
    secrets,
    sentencepiece_sampling,
    sharding,
    url_filter,
)
from .common import table
from .oracles import ORACLES


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.contract(licenses.scan(table(spark, sf_dir, "documents")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.contract(found)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.contract(pii.find(table(spark, sf_dir, "documents")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_sampling.contract(sentencepiece_sampling.encode(docs, keep=["doc_id"]))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.contract(minhash.classes(table(spark, sf_dir, "documents"), weights="count"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    digest = F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256")
    return found.select("doc_id", "keep_id", "group_size", "kept", digest)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.contract(secrets.scan(table(spark, sf_dir, "documents")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_records(table(spark, sf_dir, "documents"), [1.0] * 8, [1.0] * 9)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.contract(url_filter.judge(table(spark, sf_dir, "pages")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_decontamination,
        op3_pii,
        op4_sentencepiece,
        op5_near_dedup,
        op6_quality,
        op7_exact_dedup,
        op8_secret_scan,
        op9_sharding,
        op10_url_filter,
    )
}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
