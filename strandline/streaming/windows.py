"""Event-time windows over streams of observations (ts, key, value). They work on batches alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, key: str, width: str, late: str) -> DataFrame:
    """Count and sum of each key and window; rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("started"), key, "n", "total")


def sliding(events: DataFrame, key: str, width: str, step: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), key, "n")


def sessions(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """Runs of a key's events without a pause of ``gap``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), key, "n")


def best_per_bin(events: DataFrame, key: str, width: str, late: str) -> DataFrame:
    """The row with the largest value of each key and time bin, the smallest id on a tie."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), key)
    return w.agg(F.min(F.struct((-F.col("value")).alias("v"), "id")).alias("b")).select(F.col("w.start").alias("started"), key, F.col("b.id").alias("id"), (-F.col("b.v")).alias("value"))


def first_seen(events: DataFrame, fingerprint: str, late: str) -> DataFrame:
    """One row for each fingerprint within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([fingerprint])
