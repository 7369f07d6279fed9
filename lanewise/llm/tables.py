"""The queries of this subpackage over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lanewise.llm import (
    exact_dedup,
    html_extraction,
    importance_resampling,
    language_id,
    licenses,
    near_dedup,
    packing,
    piece_codec,
    quality_rules,
    source_divergence,
    token_counts,
    toxicity,
    warc,
)

WORDS = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path(WORDS))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.language_id(table(spark, folder, "documents"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, folder, "documents"), words=3, percent=85)


def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.extract(table(spark, folder, "pages"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(WORDS))


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def op8_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    return piece_codec.code_table(table(spark, folder, "documents"), public_tokenizers.path(PIECES))


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents")).drop("raw_hash")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.divergence(table(spark, folder, "documents"))


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels")).drop("passages")


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance_resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_token_counts,
        op2_language_id,
        op3_warc,
        op4_near_dedup,
        op5_html_extraction,
        op6_packing,
        op7_licenses,
        op8_piece_codec,
        op9_exact_dedup,
        op10_quality_rules,
        op11_source_divergence,
        op12_toxicity,
        op13_importance_resampling,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express; the others are tested against plain versions of them."""
    return {
        "op3_warc": warc.ORACLE_SQL,
        "op4_near_dedup": near_dedup.ORACLE_SQL,
        "op9_exact_dedup": exact_dedup.ORACLE_SQL,
        "op11_source_divergence": source_divergence.ORACLE_SQL,
    }
