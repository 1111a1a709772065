"""The given tables as logical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call log: event_id, key (the caller), tool, at (microseconds), ok, ms."""
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("key"),
        F.col("event_type").alias("tool"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        (F.col("event_type") != "error").alias("ok"),
        F.col("value").alias("ms"),
    )
