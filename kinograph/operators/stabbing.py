"""Interval stabbing joins: for each point in time, the intervals with begin <= t < end.

Spark has no index for intervals, and a range condition alone makes it compare all pairs of a key. So intervals are put into
buckets of time: an interval is in every bucket that it touches, a point in one. Bucket and keys are an equi-join, which
shuffles evenly even if there is one key only, and which AQE may split by skew; the exact condition stays in the join, so
outer rows are right. A point lies in one bucket, so no pair is found twice.

Buckets are as wide as the intervals' mean length. Whatever the lengths, n intervals then touch at most 3 n buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _free(base: str, *frames: DataFrame) -> str:
    taken = {c.lower() for f in frames for c in f.columns}
    while base in taken:
        base = "_" + base
    return base


def mean_length(intervals: DataFrame, begin: str = "begin", end: str = "end") -> Column:
    """The mean length of intervals (1 without any), as a subquery: computed once, when the query that uses it runs."""
    length = F.col(end).cast("double") - F.col(begin).cast("double")
    return F.coalesce(intervals.where(F.col(end) > F.col(begin)).agg(F.avg(length)).scalar(), F.lit(1.0))


def stab(
    points: DataFrame,
    intervals: DataFrame,
    on: list[str],
    how: str = "inner",
    time: str = "time",
    begin: str = "begin",
    end: str = "end",
    width: float | Column | None = None,
    strategy: str | None = None,
) -> DataFrame:
    """points with the columns of the intervals that contain them; how is inner or left.

    Intervals with end <= begin contain nothing. NULL keys meet nothing. width is that of the buckets, by default the mean
    length of the intervals, which takes a pass over them; it changes the speed, never the result. Columns of the two sides
    other than ``on`` must have different names. strategy is a hint for the join, by default that of the session's setting
    spark.kinograph.stab, or "merge": grids are generated, so the planner takes them for far smaller than they are and would
    broadcast them. "shuffle_hash" is faster where a partition's intervals fit in memory.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how is inner or left, not {how!r}")
    w = mean_length(intervals, begin, end) if width is None else width if isinstance(width, Column) else F.lit(float(width))
    bucket, last = _free("bucket", points, intervals), _free("last bucket", points, intervals)
    numbered = intervals.where(F.col(end) > F.col(begin)).withColumns({bucket: F.floor(F.col(begin) / w), last: F.floor(F.col(end) / w)})
    spread = numbered.withColumn(bucket, F.explode(F.sequence(bucket, last))).drop(last)
    right = spread.withColumnsRenamed({k: f"right {k}" for k in [*on, bucket]})
    match = (F.col(begin) <= F.col(time)) & (F.col(time) < F.col(end))
    for k in [*on, bucket]:
        match = match & (F.col(k) == F.col(f"right {k}"))
    left = points.withColumn(bucket, F.floor(F.col(time) / w))
    strategy = strategy or points.sparkSession.conf.get("spark.kinograph.stab", "merge")
    return left.join(right.hint(strategy), match, how).drop(bucket, *(f"right {k}" for k in [*on, bucket]))
