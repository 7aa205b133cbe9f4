"""The supplied tables, and the interval view of ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds of interval for each unit of an event's value.
SECONDS_PER_VALUE = 600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as intervals ``[t, t + 600 * value)`` in seconds: recording = user, label = event type."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("track_id"),
        F.col("user_id").alias("rec_id"),
        F.col("event_type").alias("label"),
        "value",
        t.alias("start"),
        (t + F.lit(SECONDS_PER_VALUE) * F.col("value")).alias("end"),
    )
