"""Frame and time grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def float32_time(i: Column, step: Column) -> Column:
    """i * step in single precision, as double: the times that recorded features carry."""
    return (i.cast("float") * step.cast("float")).cast("double")


def frame_grid(clips: DataFrame, skip: int = 1, frame_offset: int | Column = 0) -> DataFrame:
    """(filename, frame, time) for every skip-th frame of each clip (filename, duration, fps).

    There is a row for each i with i * skip / fps < duration. time starts at 0; frame_offset, a number or a column of clips,
    is added to frame, for a subclip whose video frames keep their numbers.
    """
    n = F.ceil(F.col("duration") * F.col("fps") / skip).cast("int")
    offset = frame_offset if isinstance(frame_offset, Column) else F.lit(frame_offset)
    rows = clips.where(F.col("duration") > 0).select("filename", "fps", offset.cast("bigint").alias("offset"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return rows.select("filename", (F.col("i").cast("bigint") * skip + F.col("offset")).alias("frame"), float32_time(F.col("i"), F.lit(float(skip)) / F.col("fps")).alias("time"))


def voice_grid(signals: DataFrame, time_step: float, skip: int = 1) -> DataFrame:
    """(filename, frame, time) from begin to end (exclusive) of each signal (filename, begin, end), every time_step seconds."""
    n = F.ceil((F.col("end") - F.col("begin")) / time_step).cast("int")
    rows = signals.where(F.col("end") > F.col("begin")).select("filename", "begin", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    step = F.lit(time_step).cast("float")
    time = F.col("begin").cast("float") + F.col("i").cast("float") * step
    return rows.select("filename", ((time / step).cast("float") * skip).cast("bigint").alias("frame"), time.cast("double").alias("time"))


def video_times(frames: DataFrame) -> DataFrame:
    return frames.withColumn("time", F.col("frame") / F.col("fps"))


def subclip(frames: DataFrame, start: float = 0, end: float | None = None, fps: float = 25.0) -> DataFrame:
    """The frames from int(start * fps) up to int(end * fps)."""
    kept = frames.where(F.col("frame") >= int(start * fps))
    return kept if end is None else kept.where(F.col("frame") < int(end * fps))
