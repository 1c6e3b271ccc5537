"""One query for each operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugewatch.llm import (
    alignment, compression_quality, decontaminate, html_text, jaccard_join, license_scan, packing, sharding, suffix_dedup, token_counts,
    topk_search, toxicity, vector_codes,
)
from gaugewatch.llm.common import table


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.quality_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts.attribute(table(spark, sf_dir, "documents"))


def op4_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each benchmark item that a document contains; clean documents have none."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_toxicity, op3_token_counts, op4_pivot_topk, op5_best_fit_packing, op6_html_extraction, op7_license_scan, op8_decontamination,
        op9_compression_quality, op10_jaccard_join, op11_tokenizer_alignment, op12_sharding, op13_vector_codes,
    )
}

SQL = {
    "op1_suffix_array_dedup": suffix_dedup.SQL,
    "op4_pivot_topk": topk_search.SQL,
    "op7_license_scan": license_scan.SQL,
    "op10_jaccard_join": jaccard_join.SQL,
    "op12_sharding": sharding.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
