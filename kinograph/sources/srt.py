"""SRT subtitles whose content is "<speaker> text"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK = r"(?s)\s*(\d+)[ \t]*\r?\n\s*(\d+:\d+:\d+[,.]\d+)\s*-->\s*(\d+:\d+:\d+[,.]\d+)[^\n]*\n(.*)"


def _seconds(stamp: Column) -> Column:
    p = F.split(F.translate(stamp, ",", "."), ":")
    return F.round(F.get(p, 0).cast("int") * 3600 + F.get(p, 1).cast("int") * 60 + F.get(p, 2).cast("double"), 6)


def read_srt(spark: SparkSession, path: str, filename: str | None = None) -> DataFrame:
    """The transcription table, without confidence; what follows a second ">" of a text is lost, the space before a text stays."""
    files = spark.read.text(path, wholetext=True).select(F.lit(filename).alias("filename") if filename is not None else F.input_file_name().alias("filename"), "value")
    blocks = files.select("filename", F.explode(F.split("value", r"\r?\n[ \t]*\r?\n(?=\s*\d+[ \t]*\r?\n)")).alias("b")).where(F.col("b").rlike(_BLOCK))
    part = lambda i: F.regexp_extract("b", _BLOCK, i)
    content = F.split(F.regexp_replace(part(4), r"\s+$", ""), ">")
    return blocks.select(
        "filename", _seconds(part(2)).alias("begin"), _seconds(part(3)).alias("end"), part(1).cast("int").alias("index"),
        F.get(content, 1).alias("text"), F.substring(F.get(content, 0), 2, 1 << 30).alias("speaker"), F.lit(None).cast("double").alias("confidence"),
    )


def stamp(seconds: Column) -> Column:
    """hh:mm:ss,mmm; parts of milliseconds are cut."""
    ms = F.floor(F.round(seconds * 1000, 3)).cast("bigint")
    whole = lambda x, by: F.floor(x / by).cast("bigint")
    return F.format_string("%02d:%02d:%02d,%03d", whole(ms, 3600000), whole(ms % 3600000, 60000), whole(ms % 60000, 1000), ms % 1000)


def srt_blocks(transcription: DataFrame) -> DataFrame:
    """(filename, begin, index, value): one block, without the blank line after it, for each sentence."""
    line = F.concat(F.col("index").cast("string"), F.lit("\n"), stamp(F.col("begin")), F.lit(" --> "), stamp(F.col("end")), F.lit("\n<"), F.coalesce("speaker", F.lit("None")), F.lit("> "), F.col("text"))
    return transcription.select("filename", "begin", "index", line.alias("value"))


def write_srt(transcription: DataFrame, path: str) -> None:
    """A folder of text files, each a piece of the subtitles in the order of begin; confidence is not written."""
    blocks = srt_blocks(transcription).repartitionByRange("filename", "begin").sortWithinPartitions("filename", "begin")
    blocks.select(F.concat("value", F.lit("\n")).alias("value")).write.text(path)
