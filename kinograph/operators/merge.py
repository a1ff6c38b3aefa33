"""The merge of all modalities into one table with a row for each frame (or more, where several faces or segments meet)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from kinograph.operators.grid import frame_grid
from kinograph.operators.stabbing import mean_length, stab
from kinograph.schemas import MERGED

KEYS = ["filename", "frame"]


def stab_segments(grid: DataFrame, segments: DataFrame, width: float | Column | None = None) -> DataFrame:
    """(filename, frame, segment_start, segment_end, segment_speaker_label); a frame without a segment has one row with NULLs."""
    right = segments.selectExpr("filename", "begin AS segment_start", "end AS segment_end", "name AS segment_speaker_label")
    return stab(grid, right, ["filename"], "left", "time", "segment_start", "segment_end", width).drop("time")


def stab_spans(grid: DataFrame, transcription: DataFrame, width: float | Column | None = None) -> DataFrame:
    """Frames of sentences; their speaker is segment_speaker_label."""
    right = transcription.selectExpr("filename", "begin AS span_start", "end AS span_end", "text AS span_text", "speaker AS segment_speaker_label", "confidence AS span_confidence")
    return stab(grid, right, ["filename"], "inner", "time", "span_start", "span_end", width).drop("time")


def stab_sentiment(grid: DataFrame, sentiment: DataFrame, width: float | Column | None = None) -> DataFrame:
    right = sentiment.selectExpr("filename", "begin AS sent_begin", "end AS sent_end", "text AS span_text", "pos AS span_sent_pos", "neg AS span_sent_neg", "neu AS span_sent_neu")
    return stab(grid, right, ["filename"], "inner", "time", "sent_begin", "sent_end", width).drop("time", "sent_begin", "sent_end")


def with_sentiment(spans: DataFrame, scores: DataFrame) -> DataFrame:
    """Left join on frame and text; one text twice in a frame multiplies rows."""
    return spans.join(scores, [*KEYS, "span_text"], "left")


def with_spans(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """Left join on frame and speaker, a NULL speaker meeting NULL; sentences of another speaker than the segment's are dropped."""
    right = spans.withColumnsRenamed({k: f"right {k}" for k in [*KEYS, "segment_speaker_label"]})
    on = (F.col("filename") == F.col("right filename")) & (F.col("frame") == F.col("right frame")) & F.col("segment_speaker_label").eqNullSafe(F.col("right segment_speaker_label"))
    return segments.join(right, on, "left").drop(*(c for c in right.columns if c.startswith("right ")))


def fold_left(inputs: list[DataFrame]) -> DataFrame:
    """Left joins on (filename, frame), the first input being the spine; rows of one frame on both sides multiply."""
    return reduce(lambda a, b: a.join(b, KEYS, "left"), inputs)


def _width(tables: list[DataFrame]) -> Column | None:
    """The mean length of all intervals, so that all stabbing joins share one width of buckets and the shuffle of the grid; None without any."""
    if not tables:
        return None
    return mean_length(reduce(DataFrame.unionAll, [t.select("begin", "end") for t in tables]))


def present(table: DataFrame, keep: tuple[str, ...] = ("filename", "frame")) -> DataFrame:
    """table without the columns that are NULL, or empty lists, in every row; takes a pass over it."""
    def some(f):
        x = F.col(f.name)
        return F.max((x.isNotNull() & (F.size(x) > 0) if isinstance(f.dataType, ArrayType) else x.isNotNull()).cast("int"))

    optional = [f for f in table.schema if f.name not in keep]
    row = table.agg(*[some(f).alias(f"c{i}") for i, f in enumerate(optional)]).first() if optional else []
    return table.drop(*[f.name for f, has in zip(optional, row) if not has])


def merge_features(
    clips: DataFrame,
    video: DataFrame | None = None,
    segments: DataFrame | None = None,
    transcription: DataFrame | None = None,
    sentiment: DataFrame | None = None,
    voice: DataFrame | None = None,
    skip: int = 1,
    width: float | Column | None = None,
    frame_offset: int | Column = 0,
) -> DataFrame:
    """The merged table of all clips (filename, duration, fps).

    Inputs that are absent contribute no columns. Transcripts need segments, sentiment needs a transcript. time is computed
    anew from frame, as frame * (1 / fps). frame_offset, a number or a column of clips, is the first video frame of a
    subclip: it is added to the frames of speech and voice, which start at 0.
    """
    inputs = []
    moved = isinstance(frame_offset, Column) or frame_offset != 0
    if width is None:
        width = _width([x for x in (segments, transcription, sentiment) if x is not None])
    if video is not None:
        inputs.append(video.drop("time", "face_embeddings", "face_average_embeddings"))
    if segments is not None:
        grid = frame_grid(clips, skip, frame_offset)
        speech = stab_segments(grid, segments, width)
        if transcription is not None:
            spans = stab_spans(grid, transcription, width)
            if sentiment is not None:
                spans = with_sentiment(spans, stab_sentiment(grid, sentiment, width))
            speech = with_spans(speech, spans)
        inputs.append(speech)
    if voice is not None:
        voice = voice.drop("time")
        if moved:
            offsets = clips.select(F.col("filename").alias("of clip"), (frame_offset if isinstance(frame_offset, Column) else F.lit(frame_offset)).cast("bigint").alias("frame offset"))
            voice = voice.join(offsets, F.col("filename") == F.col("of clip")).withColumn("frame", F.col("frame") + F.col("frame offset")).drop("of clip", "frame offset")
        inputs.append(voice)
    if not inputs:
        raise ValueError("nothing to merge")
    merged = fold_left(inputs).join(clips.select("filename", "fps"), "filename").withColumn("time", F.col("frame") * (F.lit(1.0) / F.col("fps")))
    first = [c for c in MERGED if c in merged.columns]
    return merged.select(*first, *(c for c in merged.columns if c not in first and c != "fps"))
