"""The pipeline from recordings to the merged table.

Its slots take anything with ``transform(inputs) -> DataFrame``; models are the user's, none comes with this library. All
recordings are worked on at once: each stage is one DataFrame keyed by filename, and stages run on the executors.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinograph.operators import merge, postprocess, transcripts, validate
from kinograph.sources import media

log = logging.getLogger(__name__)

class Stage(Protocol):
    def transform(self, **inputs: DataFrame) -> DataFrame: ...

@dataclass
class Function:
    """A stage made of a function of the inputs by name, and the schema it promises."""

    function: Callable[..., DataFrame]
    schema: str | None = None

    def transform(self, **inputs: DataFrame) -> DataFrame:
        out = self.function(**inputs)
        return checked(out, self.schema) if self.schema else out

@dataclass
class Sentences:
    """Transcription from recognised segments (filename, segment, begin, speaker, index, text, words)."""

    recogniser: Stage
    rule: str = transcripts.SENTENCE_RULE
    mode: str = "reference"

    def transform(self, **inputs: DataFrame) -> DataFrame:
        return transcripts.align(self.recogniser.transform(**inputs), self.rule, self.mode)

def checked(df: DataFrame, schema: str) -> DataFrame:
    """df, if it has at least the columns of schema with their types; extra columns pass."""
    have = {f.name: f.dataType for f in df.schema}
    for f in StructType.fromDDL(schema):
        if f.name not in have:
            raise TypeError(f"column {f.name} is missing")
        if have[f.name].simpleString() != f.dataType.simpleString():
            raise TypeError(f"column {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return df

@dataclass
class Result:
    """The clips, each stage's table, and the merged one."""

    clips: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    features: DataFrame | None = None

SCHEMAS = {
    "segments": "filename string, begin double, end double, name string",
    "transcription": "filename string, begin double, end double, text string, speaker string",
    "sentiment": "filename string, begin double, end double, text string, pos double, neg double, neu double",
    "voice": "filename string, frame bigint",
    "video": "filename string, frame bigint",
}

class Pipeline:
    """video, segments, transcription, sentiment and voice are stages or None.

    They run in the order video, segments, transcription, sentiment, voice. Each gets ``clips`` and the tables made so far
    by name. A transcript needs segments, sentiment a transcript.
    """

    ORDER = ("video", "segments", "transcription", "sentiment", "voice")

    def __init__(self, **stages: Stage | None):
        unknown = set(stages) - set(self.ORDER)
        if unknown:
            raise TypeError(f"no such stage: {', '.join(sorted(unknown))}")
        self.stages = {k: v for k in self.ORDER if (v := stages.get(k)) is not None}
        for name, needs in (("transcription", "segments"), ("sentiment", "transcription")):
            if name in self.stages and needs not in self.stages:
                raise ValueError(f"{name} needs {needs}")

    def run(self, clips: DataFrame, skip: int = 1, subclip: tuple[float, float | None] | None = None, merge_tables: bool = True, shift_frames: bool = False) -> Result:
        """The result for all clips (filename, duration, fps); with subclip, of that part of each.

        Stages get clips with the columns start (0 without subclip) and duration, that of the part. Video frames keep their
        numbers, speech and voice count from 0; shift_frames adds the part's first frame to theirs, so that they meet.
        """
        start, end = subclip or (0.0, None)
        stop = F.col("duration") if end is None else F.least(F.col("duration"), F.lit(float(end)))
        clips = clips.withColumns({"start": F.lit(float(start)), "duration": F.greatest(F.lit(0.0), stop - F.lit(float(start)))})
        result = Result(clips)
        for name, stage in self.stages.items():
            log.info("stage %s", name)
            result.tables[name] = checked(stage.transform(clips=clips, **result.tables), SCHEMAS[name])
        if merge_tables and result.tables:
            offset = F.floor(F.col("start") * F.col("fps")) if shift_frames else 0
            result.features = merge.merge_features(clips, **result.tables, skip=skip, frame_offset=offset)
        return result

    def run_files(self, spark: SparkSession, paths: str | Iterable[str], fps: float = 25.0, probe: Callable[[bytes], tuple[float, float]] | None = None, **settings) -> Result:
        """run for one file or several, all at once; FileNotFoundError if one is missing. See sources.media.clips."""
        return self.run(media.clips(spark, paths, fps, probe), **settings)


def postprocess_features(features: DataFrame, au_columns: list = postprocess.ACTION_UNITS, landmark_columns: list = postprocess.LANDMARKS) -> DataFrame:
    """Faces relabelled as the speakers they match, and list columns split: a flat table for CSV."""
    out = postprocess.relabel_faces(features)
    missing = [c for c in ("face_box", "face_aus", "face_landmarks") if c not in out.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return postprocess.split_list_columns(out, au_columns, landmark_columns)

def require_valid(features: DataFrame) -> DataFrame:
    """features, or ValueError with the names of the invariants that fail."""
    row = validate.validate_merged(features).first()
    bad = [k for k, v in row.asDict().items() if v is False]
    if bad:
        raise ValueError(f"invariants fail: {', '.join(bad)}")
    return features

