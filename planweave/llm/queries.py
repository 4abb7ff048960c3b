"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm import secret_scan, sql
from planweave.llm.clusters import cluster
from planweave.llm.common import read
from planweave.llm.decontaminate import contaminated
from planweave.llm.language_id import identify
from planweave.llm.merkle import document_fingerprints
from planweave.llm.negatives import hard_negatives
from planweave.llm.packing import pack
from planweave.llm.pii import digest, personal_data
from planweave.llm.sharding import shard_documents
from planweave.llm.simhash import near_duplicates
from planweave.llm.suffix_dedup import remove_repeats
from planweave.llm.token_counts import token_counts
from planweave.llm.url_filter import judge_urls

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "documents"))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return digest(personal_data(read(spark, folder, "documents")))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(read(spark, folder, "documents"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify(read(spark, folder, "documents"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(read(spark, folder, "documents"))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(read(spark, folder, "documents"))


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return document_fingerprints(read(spark, folder, "documents"))


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(read(spark, folder, "pages"))


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(read(spark, folder, "documents"))


def op11_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return cluster(read(spark, folder, "embeddings"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose id is divisible by 7 get the next label first; ids divisible by 100 are asked."""
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, folder, "embeddings").withColumn("label", turned), F.col("vec_id") % 100 == 0)


def op13_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Sources are the owners, and every document is a repository of its own."""
    return secret_scan.digest(secret_scan.secrets(read(spark, folder, "documents")))


def queries() -> dict[str, Query]:
    named = [f for name, f in globals().items() if name.startswith("op")]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator: the others hash, check or model in ways that it lacks."""
    return {
        "op9_url_filter": sql.URL_FILTER, "op10_suffix_dedup": sql.SUFFIX_DEDUP,
        "op11_centroid_clusters": sql.CLUSTERS, "op12_hard_negatives": sql.HARD_NEGATIVES,
    }
