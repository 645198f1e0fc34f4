"""Gauge records as streams (an addition: event-time windows, late rows, cadence)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cadence(records: DataFrame, every: str, late: str = "10 minutes", time: str = "ts", key: str = "g") -> DataFrame:
    """The first record of each gauge in each interval; rows later than ``late`` are dropped."""
    rest = [c for c in records.columns if c not in (time, key)]
    w = records.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), key)
    return w.agg(F.min_by(F.struct(time, *rest), time).alias("r")).select(key, F.col("w.start").alias("start"), "r.*")


def peaks(records: DataFrame, every: str, slide: str | None = None, late: str = "10 minutes", time: str = "ts", key: str = "g", value: str = "h") -> DataFrame:
    """(key, start, n, peak, mean) in tumbling or sliding windows."""
    w = records.withWatermark(time, late).groupBy(F.window(time, every, slide or every).alias("w"), key)
    return w.agg(F.count("*").alias("n"), F.max(value).alias("peak"), F.avg(value).alias("mean")).select(key, F.col("w.start").alias("start"), "n", "peak", "mean")
