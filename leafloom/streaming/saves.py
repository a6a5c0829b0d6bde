"""Saves that keep coming in: the latest state of each key, and windows over event time. One definition for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(saves: DataFrame, key: str, at: str, *values: str) -> DataFrame:
    """The last value of each key; on a stream the state is one row a key (update or complete mode)."""
    order = F.struct(at, *values)
    return saves.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias("last")).select(key, "last.*")


def once(saves: DataFrame, at: str, delay: str, *key: str) -> DataFrame:
    """Repeated deliveries dropped; on a stream, those that are at most delay late."""
    return saves.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(key)) if saves.isStreaming else saves.dropDuplicates(list(key))


def counts(saves: DataFrame, at: str, width: str, delay: str, *by: str) -> DataFrame:
    """Saves by window of event time; on a stream, windows close delay behind the newest event."""
    s = saves.withWatermark(at, delay) if saves.isStreaming else saves
    return s.groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def folder(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).format(kind).load(path)
