"""A corpus pipeline: quality rules, quality classifier, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns
of documents. ``run`` writes each result to the shared folder and reads it again, so a lost executor repeats one stage at most.

Cases: every stage gives nulls, empty and very long texts, repeated rows, empty tables and extra columns the result its
operator states; a document whose words are all removed stays, with an empty text.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from canopyql.llm import jaccard_join, packing, quality_classifier, quality_rules, substring_dedup
from canopyql.llm.storage import Scratch


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.filter_documents(docs)


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of those at hand, finds good."""
    return quality_classifier.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return jaccard_join.first_of_each(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that an earlier one holds."""
    return substring_dedup.filter_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length."""
    import public_tokenizers

    return packing.pack(docs, os.fspath(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", keep_by_rules),
    ("quality_classifier", keep_by_classifier),
    ("ngram_jaccard_join", first_of_near_duplicates),
    ("substring_dedup", without_repeated_passages),
    ("packing", packed),
]

#: The classifier's scores and the tokenizer's ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
