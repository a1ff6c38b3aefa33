"""RTTM files of speech segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("type", "file", "chnl", "tbeg", "tdur", "ortho", "stype", "name", "conf")


def _field(parts: Column, i: int) -> Column:
    x = F.get(parts, i)
    return F.when((x != "<NA>") & (x != ""), x)


def read_rttm(spark: SparkSession, path: str, filename: str | None = None) -> DataFrame:
    """(filename, channel, begin, end, name, conf); empty lines are skipped, <NA> is NULL."""
    parts = F.split(F.col("value"), "[ \\t]")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p"))
    begin = _field(F.col("p"), 3).cast("double")
    return rows.select(
        (F.lit(filename) if filename is not None else _field(F.col("p"), 1)).alias("filename"), _field(F.col("p"), 2).cast("int").alias("channel"),
        begin.alias("begin"), (begin + _field(F.col("p"), 4).cast("double")).alias("end"), _field(F.col("p"), 7).alias("name"), _field(F.col("p"), 8).cast("double").alias("conf"),
    )


def _number(x: Column) -> Column:
    """Two places, half to even, in plain notation; a trailing zero of the second place is not written."""
    return F.regexp_replace(F.bround(x, 2).cast("decimal(38,2)").cast("string"), "0$", "")


def rttm_lines(segments: DataFrame, sep: str = " ") -> DataFrame:
    """(filename, begin, end, value): a line for each segment, with a separator at its end; begin and end give the order."""
    na = lambda x: F.coalesce(x.cast("string"), F.lit("<NA>"))
    cells = [F.lit("SPEAKER"), na(F.col("filename")), na(F.col("channel")), _number(F.col("begin")), _number(F.col("end") - F.col("begin")), F.lit("<NA>"), F.lit("<NA>"), na(F.col("name")), na(_number(F.col("conf")))]
    return segments.select("filename", "begin", "end", F.concat(F.concat_ws(sep, *cells), F.lit(sep)).alias("value"))


def header(sep: str = " ") -> str:
    return sep.join(FIELDS)


def write_rttm(segments: DataFrame, path: str) -> None:
    """A folder of text files, sorted by recording and begin; the rounded begin and duration are all that is kept of end."""
    rttm_lines(segments).repartitionByRange("filename", "begin", "end").sortWithinPartitions("filename", "begin", "end").select("value").write.text(path)


def from_tracks(tracks: DataFrame) -> DataFrame:
    """Segments of channel 1 from tracks (filename, start, end, label)."""
    return tracks.select("filename", F.lit(1).alias("channel"), F.col("start").alias("begin"), "end", F.col("label").cast("string").alias("name"), F.lit(None).cast("double").alias("conf"))
