"""Structured Streaming: points as they arrive, joined to intervals that are known. An addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinograph.operators.stabbing import stab


def stab_stream(points: DataFrame, intervals: DataFrame, on: list[str], how: str = "inner", width: float | Column | None = None, **names: str) -> DataFrame:
    """The stabbing join of a stream of points with a table of intervals; it keeps no state."""
    return stab(points, intervals, on, how, width=width, **names)


def windowed_stats(points: DataFrame, by: list[str], value: str, ts: str = "ts", window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Count, mean and standard error for each tumbling window; points later than ``late`` are dropped."""
    grouped = points.withWatermark(ts, late).groupBy(F.window(ts, window), *by)
    stats = grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)))).alias("ste"))
    return stats.select(F.col("window.start").alias("window_start"), *by, "n", "mean", "ste")
