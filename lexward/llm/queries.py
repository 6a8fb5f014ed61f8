"""Queries of the corpus operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexward.llm import bpe, chat, exact_dedup, mixing, near_dedup, quality, secret_scan, sharding, topk
from lexward.llm import token_counts as counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, against all."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), queries=F.col("id") % topk.QUERY_EVERY == 0)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids as one text, parted by spaces, so that any two systems can compare them."""
    coded = bpe.bpe_encode(_table(spark, sf_dir, "documents"))
    return coded.withColumn("token_ids", F.array_join(F.col("token_ids").cast("array<string>"), " "))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_report(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_token_counts, op3_quality_classifier, op4_exact_top_k, op5_sharding, op6_mixing, op7_exact_dedup, op8_secret_scan, op9_bpe, op10_chat_formatting)}


def oracle_sql() -> dict[str, str]:
    return {"op2_token_counts": counts.oracle(), "op9_bpe": bpe.oracle(), "op4_exact_top_k": topk.ORACLE, "op5_sharding": sharding.oracle(), "op6_mixing": mixing.oracle(), "op7_exact_dedup": exact_dedup.ORACLE, "op10_chat_formatting": chat.oracle()}
