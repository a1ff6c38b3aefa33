"""Grouped statistics of the merged table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def standard_error(x: Column) -> Column:
    """Sample standard deviation over the root of the number of rows, those with NULL among them."""
    return F.stddev_samp(x) / F.sqrt(F.count(F.lit(1)))


def population_standard_error(x: Column) -> Column:
    return F.stddev_pop(x) / F.sqrt(F.count(F.lit(1)))


def mean_and_error(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), standard_error(F.col(value)).alias("ste"))


def confidence_band(stats: DataFrame, z: float = 1.96) -> DataFrame:
    return stats.withColumns({"lower": F.col("mean") - F.lit(z) * F.col("ste"), "upper": F.col("mean") + F.lit(z) * F.col("ste")})


def action_unit_stats(features: DataFrame, names: list[str], take: int = 27) -> DataFrame:
    """(face_label, face_au, mean, ste) of the first ``take`` action units of labelled faces."""
    labels = F.array(*[F.lit(str(n)) for n in names[:take]])
    long = features.where("face_label IS NOT NULL").select("face_label", F.posexplode(F.slice("face_aus", 1, take)).alias("pos", "value"))
    return mean_and_error(long.select("face_label", F.get(labels, F.col("pos")).alias("face_au"), "value"), ["face_label", "face_au"], "value").orderBy("face_au", "face_label")


def pitch_stats(features: DataFrame, value: str = "pitch_f0_hz", speaker: str = "segment_speaker_label") -> DataFrame:
    return mean_and_error(features.where(F.col(speaker).isNotNull()), [speaker], value)


def time_bounds(df: DataFrame, by: list[str], time: str = "time") -> DataFrame:
    return df.groupBy(*by).agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def trailing_values(df: DataFrame, by: list[str], order: list[str], value: str, n: int = 100) -> DataFrame:
    """df with ``trail``: the last n values up to the row, without NULLs."""
    return df.withColumn("trail", F.collect_list(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - n, 0)))


def carry_last(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with ``name``: the last value up to the row that is not NULL."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def unique(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, stddev, min and max of each column, one row for each statistic."""
    return df.describe(*columns)
