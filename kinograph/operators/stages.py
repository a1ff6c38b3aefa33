"""Users' models as operators: a function called for each row in Arrow batches, with the failure semantics of its stage.

A face, a segment or a sentence on which a model fails never ends the job: action units become NULL, a segment is left out,
scores become NULL. Whatever else a model raises (for segments and sentences: all but RuntimeError) is an error.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)


def apply_rows(df: DataFrame, function: Callable[..., dict | None], columns: list[str], schema: str, failed: str = "raise", errors: tuple[type[Exception], ...] = (Exception,)) -> DataFrame:
    """df with the columns of schema, from what function makes of each row's columns (by name): a dict, or None for NULLs.

    failed says what one of errors leads to: "null" (NULLs), "skip" (the row goes) or "raise". Columns of df with names of
    the schema are replaced.
    """
    if failed not in ("null", "skip", "raise"):
        raise ValueError(f"failed is null, skip or raise, not {failed!r}")
    new = StructType.fromDDL(schema)
    kept = [c for c in df.columns if c not in new.names]
    full = StructType([*df.select(kept).schema, *new])
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*[b.column(c).to_pylist() for c in columns]) if columns else ((),) * b.num_rows
            made, use = [], []
            for i, row in enumerate(rows):
                try:
                    made.append(function(**dict(zip(columns, row))) or {})
                except errors as e:
                    if failed == "raise":
                        raise
                    log.exception("a model failed: %s", e)
                    if failed == "skip":
                        continue
                    made.append({})
                use.append(i)
            old = [b.column(c).take(pa.array(use, pa.int64())) for c in kept]
            yield pa.RecordBatch.from_arrays([*old, *[pa.array([_plain(m.get(f.name)) for m in made], f.type) for f in arrow]], names=[*kept, *arrow.names])

    return df.mapInArrow(run, full)


def _plain(x):
    if isinstance(x, np.ndarray):
        return x.tolist()
    if isinstance(x, np.generic):
        return x.item()
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return x


FACES = "array<struct<face_box: array<double>, face_prob: double, face_landmarks: array<array<double>>>>"


def detect_faces(frames: DataFrame, model: Callable[[bytes], list[dict]]) -> DataFrame:
    """frames (filename, frame, image) with pos, face_box, face_prob and face_landmarks of each face; one row of NULLs without faces."""
    found = apply_rows(frames, lambda image: {"faces": model(image) if image is not None else None}, ["image"], f"faces {FACES}")
    rest = [c for c in found.columns if c != "faces"]
    return found.select(*rest, F.posexplode_outer("faces").alias("pos", "face")).select(*rest, F.col("pos").cast("bigint"), "face.*")


def embed_faces(faces: DataFrame, model: Callable[[bytes, list], np.ndarray]) -> DataFrame:
    """faces with ``embedding``; NULL where there is no face."""
    return apply_rows(faces, lambda image, face_box: {"embedding": model(image, face_box)} if face_box is not None else None, ["image", "face_box"], "embedding array<double>")


def action_units(faces: DataFrame, model: Callable[[bytes, list], np.ndarray]) -> DataFrame:
    """faces with ``face_aus``; NULL where there is no face, and where the model fails in any way."""
    return apply_rows(faces, lambda image, face_box: {"face_aus": model(image, face_box)} if face_box is not None else None, ["image", "face_box"], "face_aus array<double>", "null")


def diarize(signals: DataFrame, model: Callable[[list, float], list[tuple[float, float, str]]]) -> DataFrame:
    """Tracks (filename, start, end, label) from signals (filename, rate, samples), labels renumbered."""
    schema = "tracks array<struct<start: double, end: double, label: string>>"
    found = apply_rows(signals, lambda samples, rate: {"tracks": [dict(zip(("start", "end", "label"), t)) for t in model(samples, rate)]}, ["samples", "rate"], schema)
    return renumber(found.select("filename", F.inline("tracks")), "label")


def renumber(tracks: DataFrame, label: str = "name") -> DataFrame:
    """tracks whose labels are "0", "1", ... in the order of the labels of a recording; NULL stays."""
    each = tracks.where(F.col(label).isNotNull()).select("filename", F.col(label).alias("old label")).distinct()
    number = F.row_number().over(Window.partitionBy("filename").orderBy("old label")) - 1
    each = each.select(F.col("filename").alias("of file"), "old label", number.cast("string").alias("new label"))
    on = (F.col("filename") == F.col("of file")) & (F.col(label) == F.col("old label"))
    return tracks.join(each, on, "left").withColumn(label, F.col("new label")).select(tracks.columns)


WORDS = "array<struct<start: double, end: double, probability: double>>"


def recognise(segments: DataFrame, model: Callable[[list], tuple[str, list]]) -> DataFrame:
    """segments (with samples) with ``text`` and ``words``; a segment on which the model raises RuntimeError is left out."""
    def run(samples):
        text, words = model(samples)
        return {"text": text, "words": words}

    return apply_rows(segments, run, ["samples"], f"text string, words {WORDS}", "skip", (RuntimeError,))


def score_sentences(transcription: DataFrame, model: Callable[[str], list[float]]) -> DataFrame:
    """The sentiment table of a transcription; model gives the logits of negative, neutral and positive.

    Where it raises RuntimeError, and for sentences that are NULL, scores are NULL.
    """
    def run(text):
        if text is None:
            return None
        x = np.asarray(model(text), float)
        neg, neu, pos = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        return {"pos": pos, "neg": neg, "neu": neu}

    out = apply_rows(transcription.select("filename", "begin", "end", "text"), run, ["text"], "pos double, neg double, neu double", "null", (RuntimeError,))
    return out
