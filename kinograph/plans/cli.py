"""Command lines: python -m kinograph.plans.cli COMMAND ...

Models and decoders are the user's, given as module:function.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import functions as F

from kinograph.functions.scalars import optional_float
from kinograph.operators import faces as face_operators
from kinograph.operators import stages, transcripts
from kinograph.operators.grid import voice_grid
from kinograph.operators.interpolate import resample
from kinograph.operators.merge import merge_features
from kinograph.operators.voice import FEATURES, default_order, extract
from kinograph.plans.pipeline import postprocess_features
from kinograph.session import session
from kinograph.sources import json_files, media, rttm, srt, tables
from kinograph.sources.config import VoiceConfig


def named(path: str) -> Callable:
    """The function that module:function names."""
    module, _, function = path.partition(":")
    if not function:
        raise argparse.ArgumentTypeError(f"{path!r} is not module:function")
    return getattr(import_module(module), function)


def faces(a: argparse.Namespace) -> None:
    spark = session()
    frames = media.decode(spark, a.folder, a.decoder, a.pattern).where(F.col("frame") % a.skip == 0).withColumn("time", F.col("frame") / F.lit(a.fps))
    found = stages.detect_faces(frames, a.model)
    if a.action_units:
        found = stages.action_units(found, a.action_units)
    if a.embedder:
        cluster = face_operators.kmeans if a.clusterer == "kmeans" else face_operators.spectral
        known = face_operators.identify(stages.embed_faces(found, a.embedder), a.num_faces, cluster)
        found = face_operators.cluster_confidence(known, ["filename"]).withColumnsRenamed({"confidence": "face_confidence"}).drop("embedding")
    json_files.write_objects(json_files.feature_objects(found.drop("image"), ["frame", "pos"]), a.out)


def speakers(a: argparse.Namespace) -> None:
    spark = session()
    rows = rttm.from_tracks(stages.diarize(media.read_audio(spark, a.folder, start=a.start, end=a.end), a.model))
    rttm.write_rttm(rows, a.out) if a.format == "rttm" else json_files.write_objects(json_files.annotation_objects(rows, ["channel"]), a.out)


def transcribe(a: argparse.Namespace) -> None:
    spark = session()
    signals = media.read_audio(spark, a.folder)
    spoken = transcripts.number_segments(rttm.read_rttm(spark, a.segments)).join(signals, "filename")
    parts = spoken.withColumns({"samples": transcripts.samples(F.col("samples"), F.col("begin"), F.col("end")), "segment": F.struct("filename", "index"), "speaker": F.col("name")})
    rows = transcripts.align(stages.recognise(parts, a.model), mode=a.confidence)
    srt.write_srt(rows, a.out) if a.format == "srt" else json_files.write_objects(json_files.annotation_objects(rows), a.out)


def sentiment(a: argparse.Namespace) -> None:
    spark = session()
    rows = json_files.read_annotation(spark, a.transcription, "transcription")
    json_files.write_objects(json_files.annotation_objects(stages.score_sentences(rows, a.model)), a.out)


def voice(a: argparse.Namespace) -> None:
    spark = session()
    signals = media.read_audio(spark, a.folder, start=a.start, end=a.end)
    long = extract(signals, FEATURES, VoiceConfig.read_yaml(a.config) if a.config else None)
    bounds = signals.select("filename", F.lit(0.0).alias("begin"), ((F.size("samples") - 1) / F.col("rate")).alias("end"))
    wide = resample(voice_grid(bounds, a.time_step, a.skip), long, default_order(list(FEATURES)))
    json_files.write_objects(json_files.feature_objects(wide, ["frame"]), a.out)


def segments(a: argparse.Namespace) -> None:
    spark = session()
    rows = rttm.read_rttm(spark, a.path)
    rttm.write_rttm(rows, a.out) if a.format == "rttm" else json_files.write_objects(json_files.annotation_objects(rows, ["channel"]), a.out)


def transcript(a: argparse.Namespace) -> None:
    spark = session()
    rows = srt.read_srt(spark, a.path)
    srt.write_srt(rows, a.out) if a.format == "srt" else json_files.write_objects(json_files.annotation_objects(rows), a.out)


def merge(a: argparse.Namespace) -> None:
    spark = session()
    clips = spark.createDataFrame([(a.filename, a.duration, a.fps)], "filename string, duration double, fps double")
    note = lambda path, kind: json_files.read_annotation(spark, path, kind, a.filename) if path else None
    merged = merge_features(
        clips, json_files.read_video(spark, a.video, a.filename) if a.video else None, note(a.segments, "segments"), note(a.transcription, "transcription"),
        note(a.sentiment, "sentiment"), json_files.read_voice(spark, a.voice, a.filename) if a.voice else None, a.skip,
    )
    json_files.write_merged(merged, a.out)


def post(a: argparse.Namespace) -> None:
    spark = session()
    tables.write_csv(postprocess_features(json_files.read_merged(spark, a.path)), a.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinograph", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: tuple[str, dict]) -> None:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for flag, kw in options:
            c.add_argument(flag, **kw)
        c.add_argument("--out", required=True)

    skip = ("--skip", {"type": int, "default": 1})
    model = ("--model", {"required": True, "type": named})
    command("faces", faces, ("--folder", {"required": True}), ("--pattern", {"default": "*.mp4"}), ("--decoder", {"required": True, "type": named}), model, ("--embedder", {"type": named}), ("--action-units", {"type": named}), ("--num-faces", {"type": int, "default": 1}), ("--clusterer", {"choices": ["spectral", "kmeans"], "default": "spectral"}), ("--fps", {"type": float, "default": 25.0}), skip)
    command("speakers", speakers, ("--folder", {"required": True}), model, ("--start", {"type": float, "default": 0.0}), ("--end", {"type": optional_float, "default": None}), ("--format", {"choices": ["json", "rttm"], "default": "json"}))
    command("transcribe", transcribe, ("--folder", {"required": True}), ("--segments", {"required": True}), model, ("--confidence", {"choices": ["reference", "mean"], "default": "reference"}), ("--format", {"choices": ["json", "srt"], "default": "json"}))
    command("sentiment", sentiment, ("--transcription", {"required": True}), model)
    command("voice", voice, ("--folder", {"required": True}), ("--time-step", {"type": float, "required": True}), skip, ("--start", {"type": float, "default": 0.0}), ("--end", {"type": optional_float, "default": None}), ("--config", {}))
    command("segments", segments, ("--path", {"required": True}), ("--format", {"choices": ["json", "rttm"], "default": "json"}))
    command("transcript", transcript, ("--path", {"required": True}), ("--format", {"choices": ["json", "srt"], "default": "json"}))
    command("merge", merge, ("--filename", {"required": True}), ("--duration", {"type": float, "required": True}), ("--fps", {"type": float, "required": True}), skip, *[(f"--{x}", {}) for x in ("video", "segments", "transcription", "sentiment", "voice")])
    command("postprocess", post, ("--path", {"required": True}))
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(a)


if __name__ == "__main__":
    main()
