"""Streaming: documents that arrive as files are shredded and validated one by one; events are counted in windows with a watermark.

Per-document constraints are stateless. Keys across documents need an index that stands still: a stream-static anti-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..sources.files import read_documents


def document_stream(engine: Engine, folder: str, module, root: str, fmt: str | None = None):
    """Documents of a folder of text files, as they arrive."""
    files = engine.spark.readStream.format("text").option("wholetext", True).load(folder)
    return read_documents(engine, files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")), module, root, fmt)


def missing_keys(stream: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """Rows of a stream whose key an index table doesn't hold."""
    return stream.join(index.select(F.col(index.columns[0]).alias(key)).distinct(), key, "left_anti")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Count and sum by type in tumbling windows; rows later than the watermark are dropped by the stream, none in a batch."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def windows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
