"""Linear interpolation of signals to grid times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinograph.operators.stabbing import stab


def interpolate(points: DataFrame, signal: DataFrame, on: list[str], time: str = "time", ts: str = "ts", value: str = "value", width: float | Column | None = None) -> DataFrame:
    """points with ``value`` between the neighbouring samples of signal (on, ts, value); NULL outside of all samples.

    On a sample's time the value is the sample's. A NULL or NaN sample makes the stretches beside it NULL. Samples of one
    key have different times. Pairs of neighbours are intervals, found by the stabbing join; the last sample is one of its
    own, which holds for its own time only.
    """
    w = Window.partitionBy(*on).orderBy(ts)
    clean = signal.withColumn(value, F.when(~F.isnan(value), F.col(value)))
    pairs = clean.select(
        *on,
        F.col(ts).cast("double").alias("from ts"),
        F.col(value).cast("double").alias("from value"),
        F.lead(F.col(ts).cast("double")).over(w).alias("to ts"),
        F.lead(F.col(value).cast("double")).over(w).alias("to value"),
    )
    # the last sample reaches to the next double, so its own time is inside
    pairs = pairs.withColumn("until", F.coalesce("to ts", F.col("from ts") + F.greatest(F.abs("from ts") * 2.220446049250313e-16, F.lit(5e-324))))
    found = stab(points, pairs, on, "left", time, "from ts", "until", width)
    slope = (F.col("to value") - F.col("from value")) / F.nullif(F.col("to ts") - F.col("from ts"), F.lit(0.0))
    at_node = F.col(time) == F.col("from ts")
    lerp = F.when(at_node, F.col("from value")).otherwise(slope * (F.col(time) - F.col("from ts")) + F.col("from value"))
    return found.withColumn(value, lerp).drop("from ts", "from value", "to ts", "to value", "until")


def resample(grid: DataFrame, long: DataFrame, features: list[str], width: float | Column | None = None) -> DataFrame:
    """grid with a column for each feature of long (filename, feature, ts, value): each interpolated, all in one pass."""
    asked = grid.withColumn("feature", F.explode(F.array(*map(F.lit, features))))
    values = interpolate(asked, long, ["filename", "feature"], width=width)
    wide = values.groupBy(*grid.columns).agg(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features])
    return wide.select(*grid.columns, *features)


def add_feature(table: DataFrame, feature: DataFrame, name: str) -> DataFrame:
    """table with the column name of feature (filename, frame, name), NaN being NULL."""
    return table.join(feature.select("filename", "frame", F.when(~F.isnan(name), F.col(name)).alias(name)), ["filename", "frame"], "left")
