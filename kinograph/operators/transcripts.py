"""Sentences of transcribed segments and their times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

#: Splits after . ? ! : before white space, but not within abbreviations such as "e.g. " or "Dr. ".
SENTENCE_RULE = r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!|\:)\s"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column, rule: str = SENTENCE_RULE) -> Column:
    return F.split(strip(text), f"(?U){rule}", -1)


def last_word(sentence: Column) -> Column:
    """Number of words less one, words being what single spaces separate."""
    return F.size(F.split(sentence, " ", -1)) - 1


def all_words(parts: Column) -> Column:
    """The words of a segment's parts, each a struct with an array ``words``, one after the other."""
    return F.flatten(F.transform(parts, lambda p: p["words"]))


def samples(signal: Column, begin: Column, end: Column, rate: int = 16000) -> Column:
    """The samples from int(begin * rate) up to int(end * rate)."""
    first, last = (begin * rate).cast("int"), (end * rate).cast("int")
    return F.slice(signal, first + 1, F.greatest(F.lit(0), last - first))


def confidence(words: Column, first: Column, last: Column, mode: str = "reference") -> Column:
    """Average word probability of a sentence.

    "mean" is the mean over its words. "reference" sums the probabilities of words with first <= index < last, last being
    the sentence's number of words less one, and divides by that; NULL for sentences of one word.
    """
    if mode == "mean":
        mine = F.slice(words, first + 1, last + 1)
        return F.try_divide(F.aggregate(mine, F.lit(0.0), lambda s, w: s + w["probability"]), F.size(mine).cast("double"))
    if mode != "reference":
        raise ValueError(f"mode is reference or mean, not {mode!r}")
    mine = F.slice(words, first + 1, F.greatest(F.lit(0), last - first))
    total = F.aggregate(mine, F.lit(0.0), lambda s, w: s + w["probability"])
    return F.try_divide(total, last.cast("double"))


def split_sentences(segments: DataFrame, rule: str = SENTENCE_RULE, text: str = "text") -> DataFrame:
    """One row for each sentence, with its place ``pos``, ``sentence``, ``last_word`` and ``first_word``, its first word's index.

    segments needs a key ``segment`` that is unique, or rows of one segment run together.
    """
    rows = segments.select("*", F.posexplode(sentences(F.col(text), rule)).alias("pos", "sentence")).withColumn("last_word", last_word(F.col("sentence")))
    before = Window.partitionBy("segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("first_word", F.coalesce(F.sum(F.col("last_word") + 1).over(before), F.lit(0)).cast("int"))


def align(segments: DataFrame, rule: str = SENTENCE_RULE, mode: str = "reference") -> DataFrame:
    """The transcription table of segments (filename, segment, begin, speaker, index, text, words).

    A sentence begins with its first word and ends with its last one; a word's index beyond the words is an error, as is
    none at all left out: segments without words give no rows. Sentences without duration are dropped.
    """
    rows = split_sentences(segments.where(F.size("words") > 0), rule)
    at = lambda i, field: F.element_at("words", (i + 1).cast("int"))[field]
    first, last = F.col("first_word"), F.col("last_word")
    start, stop = at(first, "start"), at(first + last, "end")
    timed = rows.withColumns({"from": start, "to": stop}).where(F.col("to") - F.col("from") > 0)
    return timed.select(
        "filename", (F.col("begin") + F.col("from")).alias("begin"), (F.col("begin") + F.col("to")).alias("end"), "index",
        F.col("sentence").alias("text"), "speaker", confidence(F.col("words"), first, last, mode).alias("confidence"),
    )


def number_segments(segments: DataFrame) -> DataFrame:
    """segments with ``index``, counted from 0 in the order of begin, then end, then of the other columns that have an order."""
    rest = [f.name for f in segments.schema if f.name not in ("filename", "begin", "end") and not isinstance(f.dataType, (MapType, VariantType))]
    return segments.withColumn("index", F.row_number().over(Window.partitionBy("filename").orderBy("begin", "end", *rest)) - 1)


def wrapped(text: Column, width: int = 30) -> Column:
    """The lines of a text for display: words are added to a line until it has width characters or more, a space after each."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))
    full = lambda acc: F.length(acc["line"]) >= width
    add = lambda acc, w: F.struct(F.when(full(acc), F.array_append(acc["lines"], acc["line"])).otherwise(acc["lines"]).alias("lines"), F.concat(F.when(full(acc), F.lit("")).otherwise(acc["line"]), w, F.lit(" ")).alias("line"))
    last = lambda acc: F.when(acc["line"] != "", F.array_append(acc["lines"], acc["line"])).otherwise(acc["lines"])
    return F.transform(F.aggregate(words, start, add, last), lambda x: F.substring(x, 1, F.length(x) - 1))
