"""The change log as a stream: following it from a serial, the live state it leaves, and counts by event time.

State is held by Spark's own stateful aggregates: one row a key, dealt over the shuffle partitions, in whatever state store the
session names (RocksDB where it exceeds memory), and recovered from the query's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def follow(spark: SparkSession, path: str, schema, after: int = 0, files_per_trigger: int = 1000) -> DataFrame:
    """Entries above a serial, from files as they arrive. Where the query has a checkpoint it resumes there."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).filter(F.col("serial_global") > after)


def live_state(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Last serial and operation of each key, for output mode update: a key whose operation is DEL is gone."""
    return stream.groupBy(*keys).agg(F.max("serial_global").alias("serial_global"), F.max_by("operation", "serial_global").alias("operation"))


def counts_by_window(stream: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Entries a source and window of event time; what is later than `lateness` is left out."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", width), "source").agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, gap: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Entries a key and session of changes less than `gap` apart."""
    return stream.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "source", "rpsl_pk").agg(F.count("*").alias("n"))
