"""Video frames and audio samples. Decoding video takes a decoder that the user supplies; audio is read from WAV files."""

from __future__ import annotations

import io
import os
import wave
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Decoded frames that a task holds at a time.
FRAMES = 32


def frame_ids(n_frames: Column, fps: Column, skip: int = 1, start: float = 0, end: float | None = None) -> Column:
    """Numbers of the frames from int(start * fps) to int(end * fps), or the last one, every skip-th."""
    first = F.floor(F.lit(float(start)) * fps).cast("int")
    stop = n_frames.cast("int") if end is None else F.floor(F.lit(float(end)) * fps).cast("int")
    return F.when(stop > first, F.sequence(first, stop - 1, F.lit(skip))).otherwise(F.array().cast("array<int>"))


def video_frames(videos: DataFrame, skip: int = 1, start: float = 0, end: float | None = None) -> DataFrame:
    """(filename, frame, time, duration) of videos (filename, n_frames, fps)."""
    rows = videos.select("filename", "fps", "n_frames", F.explode(frame_ids(F.col("n_frames"), F.col("fps"), skip, start, end)).cast("bigint").alias("frame"))
    return rows.select("filename", "frame", (F.col("frame") / F.col("fps")).alias("time"), (F.col("n_frames") / F.col("fps")).alias("duration"))


def decode(spark: SparkSession, folder: str, decoder: Callable[[bytes], Iterable[tuple[int, bytes]]], pattern: str = "*.mp4") -> DataFrame:
    """(filename, frame, image): what decoder makes of each file, frame by frame."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                frames = iter(decoder(content))
                while part := list(islice(frames, FRAMES)):
                    yield pd.DataFrame({"filename": path, "frame": [x[0] for x in part], "image": [x[1] for x in part]})

    return files.mapInPandas(run, "filename string, frame bigint, image binary")


def samples(content: bytes, rate: int = 16000, start: float = 0, end: float | None = None) -> np.ndarray:
    """The samples of a WAV file: channels averaged, between -1 and 1, brought to rate by linear interpolation."""
    with wave.open(io.BytesIO(content)) as w:
        own, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(float) / 128 - 1
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))
    else:
        raise ValueError(f"samples of {width} bytes")
    x = x.reshape(-1, channels).mean(1)
    x = x[int(start * own) : None if end is None else int(end * own)]
    if own == rate or not len(x):
        return x
    return np.interp(np.arange(int(len(x) * rate / own)) / rate, np.arange(len(x)) / own, x)


def read_audio(spark: SparkSession, folder: str, rate: int = 16000, start: float = 0, end: float | None = None) -> DataFrame:
    """(filename, rate, samples) of the WAV files of a folder; samples are single precision, 4 bytes each (230 MB an hour at 16 kHz)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame({"filename": [path], "rate": [float(rate)], "samples": [samples(content, rate, start, end).astype(np.float32)]})

    return files.mapInPandas(run, "filename string, rate double, samples array<float>")


def wav_length(content: bytes) -> float:
    with wave.open(io.BytesIO(content)) as w:
        return w.getnframes() / w.getframerate()


def clips(spark: SparkSession, paths: str | Iterable[str], fps: float = 25.0, probe: Callable[[bytes], tuple[float, float]] | None = None) -> DataFrame:
    """(filename, duration, fps) of one file or several; FileNotFoundError if one is missing.

    probe gives a file's duration and frame rate. Without it, files are WAV, and fps is taken as given.
    """
    paths = [paths] if isinstance(paths, (str, os.PathLike)) else list(paths)
    for p in map(str, paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            raise FileNotFoundError(p)
    files = spark.read.format("binaryFile").load([str(p) for p in paths]).select("path", "content")
    look = probe or (lambda content: (wav_length(content), fps))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [look(c) for c in b["content"]]
            yield pd.DataFrame({"filename": b["path"], "duration": [float(x[0]) for x in found], "fps": [float(x[1]) for x in found]})

    return files.mapInPandas(run, "filename string, duration double, fps double")
