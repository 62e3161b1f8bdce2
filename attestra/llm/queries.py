"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_snapshots, factor_toxicity, kd_clusters, kernel_language, mil_quality, mixing, ngram_join, pivot_index, range_spelling, secrets, sharding, string_tiling, url_rules
from .oracles import ORACLE_SQL as ORACLE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(_table(spark, sf_dir, "pages"))


def op3_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_tiling.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_table(spark, sf_dir, "documents"))


def op5_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_language.languages(_table(spark, sf_dir, "documents"))


def op6_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleaved(_table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.rendered(_table(spark, sf_dir, "conversations"))


def op10_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op11_kd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_clusters.clusters(_table(spark, sf_dir, "embeddings"))


def op12_factor_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor_toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_range_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_spelling.variants(_table(spark, sf_dir, "documents"))


def written_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2 that SQL can express: host, path and written rule of each page."""
    return url_rules.parsed(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", F.col("verdict").alias("ruled"))


def mixture_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10 that SQL can express: sizes and targets, without the draw."""
    return mixing.Mix(_table(spark, sf_dir, "documents")).streams.select("doc_id", "size", "source_size", "target")


_ALL = (op1_pivot_index, op2_url_rules, op3_string_tiling, op4_secret_owners, op5_kernel_language, op6_interleaved_shards, op7_ngram_join, op8_mil_quality, op9_chat_snapshots, op10_block_mixing, op11_kd_clusters, op12_factor_toxicity, op13_range_spelling, written_url_rules, mixture_targets)
QUERIES = {f.__name__: f for f in _ALL}
