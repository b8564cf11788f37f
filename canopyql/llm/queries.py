"""One query for each operator, over its whole table, with production parameters; SQL where SQL can express it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, html_text, jaccard_join, language_id, license_scan, oracles, packing, quality_classifier, quality_rules, sentencepiece_codec, substring_dedup


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; executors have the same installation as the driver."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_read(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(_read(spark, sf_dir, "documents"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(_read(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(_read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.report(_read(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_html_text": op3_html_text,
    "op4_language_id": op4_language_id,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_license_scan": op9_license_scan,
    "op10_sentencepiece": op10_sentencepiece,
}

ORACLES: dict[str, str] = {
    "op1_jaccard_join": oracles.JACCARD,
    "op5_embedding_dedup": oracles.EMBEDDINGS,
    "op6_substring_dedup": oracles.SUBSTRINGS,
    "op7_quality_rules": oracles.quality(quality_rules.METRICS, quality_rules.NOISE, 3.0, 200),
}
