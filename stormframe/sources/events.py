"""Observation view over the ``events`` test table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def solar_wind(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` in the shape of the observation table, with missing values mixed in."""
    value, event = F.col("value"), F.col("event_id")
    return spark.read.parquet(f"{folder}/events.parquet").select(
        F.col("ts").cast("timestamp_ntz").alias("datetime"),
        "event_id",
        "user_id",
        F.when(F.col("event_type") == "error", None)
        .otherwise(value / F.lit(10.0))
        .alias("bt"),
        F.when((F.col("event_type") == "signup") & (event % 3 == 0), None)
        .otherwise(F.lit(10.0) - value / F.lit(4.0))
        .alias("bz_gsm"),
        (F.lit(300.0) + value * F.lit(4.0)).alias("speed"),
        F.when(event % 7 == 0, None)
        .otherwise(F.lit(0.1) + value / F.lit(3.0))
        .alias("density"),
        (F.lit(20.0) - value * F.lit(1.5)).alias("dst"),
    )
