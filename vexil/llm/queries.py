"""The queries of the training-data operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexil.llm import bpe, license_scan, line_dedup, minhash_dedup, mixing, pivot_search, quality_classifier, quality_rules, secret_scan, substring_dedup
from vexil.llm.common import read_table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality_classifier.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "lang", "source", quality_classifier.SCORE)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the vectors whose id is divisible by 100, against all."""
    return pivot_search.nearest_neighbours(read_table(spark, sf_dir, "embeddings"), asked=F.col("vec_id") % 100 == 0)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return mixing.mixing_rates(docs, read_table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.deduplicate(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.withColumn("n_lines", F.size(F.split("text", "\n")).cast("long"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read_table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.kept_rates(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


def op10_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_license_scan, op3_exact_top_k, op4_source_mixing, op5_line_dedup, op6_substring_dedup, op7_minhash_near_dedup, op8_secret_scan, op9_quality_rules, op10_bpe_tokens)}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": license_scan.SQL, "op3_exact_top_k": pivot_search.SQL, "op5_line_dedup": line_dedup.SQL, "op6_substring_dedup": substring_dedup.SQL, "op9_quality_rules": quality_rules.SQL}
