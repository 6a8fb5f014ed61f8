"""From raw documents to token ids: classify, deduplicate, mix and encode.

Each stage works on all that the one before it kept and is written as Parquet in between. All stages bear nulls in any
column, texts of any length, repeated rows, more columns with any names, and empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexward.llm import bpe, exact_dedup, mixing, near_dedup, quality
from lexward.llm.common import discard, stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on those with labels, calls good. A null text is rejected, an empty one judged
    by the model's bias; repeated rows share one fate."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the least id; null texts all stay, and empty ones are one text."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id; null and wordless texts and null ids all stay."""
    return near_dedup.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics have their target shares of tokens, which are those that the next
    stage makes. Null sources and languages are values of their own; rows of one id, and all with a null id, share one fate."""
    return mixing.sample_mixture(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids: null for a null text, none for an empty one."""
    return bpe.with_token_ids(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicates),
    ("mixing", mixture),
    ("bpe encoding", encoding),
]

#: A trained classifier, SimHash and BPE have no SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, with their token ids. A stage's table goes once the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, now = stored(docs)
            if before:
                discard(spark, before)
            before = now
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
