"""Stages of users' models, the pipeline from files, and the command lines."""

import json
import math
import sys
import wave
from pathlib import Path

import fake_models
import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kinograph.operators import faces, graph, grid, merge, stages, transcripts
from kinograph.plans import cli
from kinograph.plans.pipeline import Function, Pipeline
from kinograph.sources import json_files, media, rttm, tables
from kinograph.sources.config import VoiceConfig

cloudpickle.register_pickle_by_value(fake_models)
FRAMES = "filename string, frame bigint, image binary"


def test_faces_and_failing_action_units(spark):
    frames = spark.createDataFrame([("a", i, bytearray([i])) for i in range(5)], FRAMES)
    found = stages.detect_faces(frames, fake_models.detector)
    assert sorted((r.frame, r.pos) for r in found.collect() if r.pos is not None) == [(1, 0), (2, 0), (2, 1), (4, 0)]
    assert {r.frame for r in found.where("pos IS NULL").collect()} == {0, 3}
    rows = stages.action_units(stages.embed_faces(found, fake_models.embedder), fake_models.units).collect()
    assert {r.frame: None if r.face_aus is None else len(r.face_aus) for r in rows} == {0: None, 1: 41, 2: 41, 3: None, 4: None}
    assert {r.frame: r.embedding for r in rows} == {0: None, 1: [1, 1], 2: [2, 1], 3: None, 4: [4, 1]}
    with pytest.raises(ValueError):
        stages.apply_rows(frames, len, [], "x int", "ignore")
    with pytest.raises(PySparkException):
        stages.apply_rows(frames, lambda image: 1 / 0, ["image"], "x int").collect()


def test_speakers_are_renumbered(spark):
    signals = spark.createDataFrame([("a", 16000.0, [0.0] * 10), ("b", 16000.0, [0.0])], "filename string, rate double, samples array<float>")
    rows = stages.diarize(signals, fake_models.tracks).where("filename = 'a'").orderBy("start").collect()
    assert [(r.start, r.end, r.label) for r in rows] == [(0.0, 0.5, "1"), (0.5, 0.75, "0"), (0.75, 1.0, "1")]
    null = stages.renumber(spark.createDataFrame([("a", None), ("a", "x")], "filename string, name string"))
    assert {r.name for r in null.collect()} == {None, "0"}


def test_failed_segments_are_skipped_and_failed_sentences_have_no_scores(spark):
    segments = spark.createDataFrame([("a", 1, 0.0, "s", [0.0] * 6000, 0), ("a", 2, 1.0, "s", [0.0], 1)], "filename string, segment int, begin double, speaker string, samples array<float>, index int")
    spoken = transcripts.align(stages.recognise(segments, fake_models.recogniser))
    assert sorted(r.text for r in spoken.collect()) == ["All well.", "Fine!"]
    scores = {r.text: r for r in stages.score_sentences(spoken, fake_models.logits).collect()}
    assert scores["Fine!"].pos is None and math.isclose(sum(scores["All well."][c] for c in ("pos", "neg", "neu")), 1)
    assert math.isclose(scores["All well."].pos, math.exp(2) / (1 + math.e + math.exp(2)))
    with pytest.raises(PySparkException):
        stages.score_sentences(spoken, lambda text: 1 / 0).collect()


def wav(path, seconds, rate=16000):
    t = np.arange(int(seconds * rate)) / rate
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((8000 * np.sin(2 * np.pi * 150 * t)).astype("<i2").tobytes())


def test_pipeline_from_files(spark, tmp_path):
    for name in ("a", "b"):
        wav(tmp_path / f"{name}.wav", 2.0)
    spoken = lambda clips: clips.select("filename", F.lit(0.0).alias("begin"), F.lit(1.0).alias("end"), F.lit("0").alias("name"))
    line = Pipeline(segments=Function(spoken))
    one = line.run_files(spark, str(tmp_path / "a.wav"), 10.0)
    assert one.features.count() == 20 and one.clips.first().duration == 2.0
    two = line.run_files(spark, [tmp_path / "a.wav", tmp_path / "b.wav"], 10.0, skip=5)
    assert two.features.count() == 8 and two.features.select("filename").distinct().count() == 2
    with pytest.raises(FileNotFoundError):
        line.run_files(spark, [str(tmp_path / "a.wav"), str(tmp_path / "c.wav")])
    probed = line.run_files(spark, str(tmp_path / "a.wav"), probe=lambda content: (1.0, 5.0))
    assert probed.features.count() == 5


def test_subclip_reaches_stages_and_merge(spark):
    clips = spark.createDataFrame([("a", 10.0, 5.0)], "filename string, duration double, fps double")
    seen = []

    def spoken(clips):
        seen.append(clips.first().asDict())
        return clips.select("filename", F.lit(0.0).alias("begin"), F.lit(9.0).alias("end"), F.lit("0").alias("name"))

    voice = Function(lambda clips, **_: grid.frame_grid(clips).select("filename", "frame", F.lit(1.0).alias("pitch_f0_hz")))
    line = Pipeline(segments=Function(spoken), voice=voice)
    plain = line.run(clips, subclip=(2.0, 4.0)).features
    assert seen[0]["start"] == 2.0 and seen[0]["duration"] == 2.0
    assert [r.frame for r in plain.orderBy("frame").collect()] == list(range(10))
    moved = line.run(clips, subclip=(2.0, 4.0), shift_frames=True).features.orderBy("frame").collect()
    assert [r.frame for r in moved] == list(range(10, 20)) and {r.pitch_f0_hz for r in moved} == {1.0} and moved[0].time == 2.0


def test_absent_columns_go(spark):
    rows = spark.createDataFrame([("a", 0, None, [], 1.0), ("a", 1, None, None, None)], "filename string, frame bigint, face_label string, face_aus array<double>, face_prob double")
    assert merge.present(rows).columns == ["filename", "frame", "face_prob"]


def test_wrapped_lines(spark):
    def greedy(text):
        words, lines = text.split(), []
        while words:
            line = ""
            while len(line) < 30 and words:
                line += words.pop(0) + " "
            lines.append(line[:-1])
        return lines

    texts = ["", "word", "one two three four five six seven eight nine ten eleven", "x" * 40 + " and more of it", "  a  b " * 20]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", transcripts.wrapped(F.col("text")).alias("lines")).collect()
    assert all(r.lines == greedy(r.text) for r in rows)


def test_ties_are_numbered_by_the_other_columns(spark):
    rows = [("a", 0.0, 1.0, str(i)) for i in range(20)]
    df = spark.createDataFrame(rows[::-1], "filename string, begin double, end double, name string").repartition(4)
    assert {r.name: r["index"] for r in transcripts.number_segments(df).collect()} == {n: i for i, n in enumerate(sorted(r[3] for r in rows))}


def test_payloads_are_validated(spark, tmp_path):
    def read(data, kind="segments", **kw):
        (tmp_path / "x.json").write_text(json.dumps({"filename": "a", "segments": [{"begin": 0, "end": 1, "data": data}]}))
        return json_files.read_annotation(spark, str(tmp_path / "x.json"), kind, **kw).collect()

    assert read({"name": "s", "conf": 0.5})[0].name == "s"
    assert read({"name": "s"})[0].conf is None
    for bad in ({"conf": 0.5}, {"name": "s", "conf": 1.5}, {}):
        with pytest.raises(PySparkException, match="not valid"):
            read(bad)
    with pytest.raises(PySparkException, match="not valid"):
        read({"text": "t", "index": "q"}, "transcription")
    assert read({"conf": 0.5}, strict=False)[0].name is None
    assert read({"topic": "t"}, payload="struct<topic: string>")[0].topic == "t"


def test_ranges_alone_may_be_left_unchecked(spark, tmp_path):
    def read(data):
        (tmp_path / "x.json").write_text(json.dumps({"filename": "a", "segments": [{"begin": 0, "end": 1, "data": data}]}))
        return json_files.read_annotation(spark, str(tmp_path / "x.json"), "segments", ranges=False).collect()

    assert read({"name": "s", "conf": 1.5})[0].conf == 1.5
    with pytest.raises(PySparkException, match="not valid"):
        read({"conf": 0.5})


def test_long_recordings_are_written_in_parts(spark, tmp_path, monkeypatch):
    """In order, each with the header of the recording, a few to a file; and read back as they were."""
    monkeypatch.setattr(json_files, "PART", 4)
    monkeypatch.setattr(json_files, "OBJECTS", 2)
    rows = [(f, 1 if i == 9 else None, float(i), i + 0.5, f"s{i}", None) for f in ("a", "b") for i in range(10)]
    table = spark.createDataFrame(rows, "filename string, channel int, begin double, end double, name string, conf double")
    json_files.write_objects(json_files.annotation_objects(table, ["channel"]), str(tmp_path / "j"))
    files = [[json.loads(x) for x in p.read_text().splitlines()] for p in (tmp_path / "j").glob("*.txt")]
    assert max(map(len, files)) <= 2
    found = sorted((x["filename"], [s["begin"] for s in x["segments"]]) for f in files for x in f)
    assert found == [(f, [float(i) for i in r]) for f in ("a", "b") for r in (range(4), range(4, 8), range(8, 10))]
    assert {x["channel"] for f in files for x in f} == {1}
    back = json_files.read_annotation(spark, str(tmp_path / "j"), "segments")
    assert sorted(map(str, back.collect())) == sorted(map(str, table.withColumn("channel", F.lit(1)).select(back.columns).collect()))


def test_objects_are_written_compressed(spark, tmp_path):
    """And read back as they were; not compressed unless said."""
    rows = [("a", float(i), i + 0.5, i, f"text {i}", "s", 0.5) for i in range(2000)]
    table = spark.createDataFrame(rows, "filename string, begin double, end double, index int, text string, speaker string, confidence double")
    size = {}
    for kind in (None, "gzip"):
        json_files.write_objects(json_files.annotation_objects(table), str(tmp_path / f"{kind}"), kind)
        files = [p for p in (tmp_path / f"{kind}").iterdir() if p.name.startswith("part-")]
        assert all(p.name.endswith(".txt.gz" if kind else ".txt") for p in files)
        size[kind] = sum(p.stat().st_size for p in files)
        assert sorted(map(tuple, json_files.read_annotation(spark, str(tmp_path / f"{kind}"), "transcription").collect())) == rows
    assert size["gzip"] < size[None] / 2


def test_identify_is_spectral_by_default(spark):
    rng = np.random.default_rng(3)
    angle = rng.uniform(0, 2 * np.pi, 120)
    ring = np.c_[np.cos(angle), np.sin(angle)] * np.where(np.arange(120) < 60, 1, 6)[:, None]  # two rings: no k-means tells them apart
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(ring)] + [("a", 120, [math.nan, 0.0])], "filename string, id int, embedding array<double>")
    found = {r.id: r.face_label for r in faces.identify(df, 2).collect()}
    assert len({found[i] for i in range(60)}) == 1 and len({found[i] for i in range(60, 120)}) == 1 and found[0] != found[60] and found[120] is None
    assert len({r.face_label for r in faces.identify(df, 2, faces.kmeans).collect() if 60 <= r.id < 120}) == 2


def test_rttm_of_large_times(spark):
    rows = spark.createDataFrame([("a", 1, 12345678.125, 12345679.5, "0", None)], "filename string, channel int, begin double, end double, name string, conf double")
    assert rttm.rttm_lines(rows).first().value == "SPEAKER a 1 12345678.12 1.38 <NA> <NA> 0 <NA> "


def test_yaml_settings(tmp_path):
    path = str(tmp_path / "c.yaml")
    VoiceConfig(frame_len=512, spectral_slopes_bands=((0.0, 400.0), (400.0, 900.0))).write_yaml(path)
    back = VoiceConfig.read_yaml(path)
    assert back.frame_len == 512 and back.spectral_slopes_bands == ((0.0, 400.0), (400.0, 900.0))
    with pytest.raises(ValueError):
        VoiceConfig(frame_len=0)


def test_decoded_frames(spark, tmp_path):
    (tmp_path / "v.mp4").write_bytes(bytes(70))
    rows = media.decode(spark, str(tmp_path), fake_models.decoder)
    assert rows.count() == 70 and rows.agg(F.max("frame")).first()[0] == 69


def test_command_lines(spark, tmp_path):
    sys.path.insert(0, str(Path(__file__).parent))
    wav(tmp_path / "a.wav", 1.0)
    (tmp_path / "v.mp4").write_bytes(bytes(6))
    out = lambda name: str(tmp_path / name)
    cli.main(["speakers", "--folder", out(""), "--model", "fake_models:tracks", "--format", "rttm", "--out", out("speakers")])
    assert rttm.read_rttm(spark, out("speakers")).count() == 3
    cli.main(["segments", "--path", out("speakers"), "--out", out("segments")])
    assert json_files.read_annotation(spark, out("segments"), "segments").count() == 3
    cli.main(["transcribe", "--folder", out(""), "--segments", out("speakers"), "--model", "fake_models:recogniser", "--out", out("spoken")])
    spoken = json_files.read_annotation(spark, out("spoken"), "transcription")
    assert sorted(r.text for r in spoken.collect()) == ["All well.", "Fine!"]
    cli.main(["sentiment", "--transcription", out("spoken"), "--model", "fake_models:logits", "--out", out("scores")])
    assert json_files.read_annotation(spark, out("scores"), "sentiment").where("pos IS NOT NULL").count() == 1
    cli.main(["voice", "--folder", out(""), "--time-step", "0.2", "--out", out("voice")])
    heard = json_files.read_voice(spark, out("voice"))
    assert heard.count() == 5 and len(heard.columns) == 28
    cli.main(["faces", "--folder", out(""), "--decoder", "fake_models:decoder", "--model", "fake_models:detector", "--embedder", "fake_models:embedder", "--action-units", "fake_models:units", "--num-faces", "1", "--out", out("faces")])
    assert json_files.read_video(spark, out("faces")).count() == 8  # two frames without a face, six faces
    cli.main(["merge", "--filename", "x", "--duration", "1.0", "--fps", "5", "--segments", out("segments"), "--transcription", out("spoken"), "--sentiment", out("scores"), "--voice", out("voice"), "--out", out("merged.parquet")])
    assert spark.read.parquet(out("merged.parquet")).count() >= 5
    with pytest.raises(SystemExit):
        cli.main(["sentiment", "--transcription", "x", "--model", "nothing", "--out", "y"])


def test_graph_arithmetic_by_loops():
    r = np.random.default_rng(5)
    x, main, side = r.normal(size=(2, 27, 4)), r.normal(size=(27, 4)), r.normal(size=(14, 4))
    cosine = lambda a, b: sum(a * np.maximum(b, 0)) / math.sqrt(sum(a * a)) / max(math.sqrt(sum(np.maximum(b, 0) ** 2)), 1e-12)
    out = graph.unit_activations(x, main, side)
    for i in range(2):
        assert np.allclose(out[i, :27], [cosine(x[i, j], main[j]) for j in range(27)])
        assert np.allclose(out[i, 27:], [cosine(x[i, graph.SIDED[j // 2]], side[j]) for j in range(14)])
    y, q, k, v = r.normal(size=(2, 3, 4)), *(r.normal(size=(4, 5)) for _ in range(3))
    out = graph.cross_attention(y, x, q, k, v)
    for i in range(2):
        for j in range(3):
            logits = [(y[i, j] @ q) @ (z @ k) / math.sqrt(5) for z in x[i]]
            weights = np.exp(logits) / np.exp(logits).sum()
            assert np.allclose(out[i, j], sum(w * (z @ v) for w, z in zip(weights, x[i])))
    edge, source, target = (r.normal(size=(1, 3, 3, 2)) for _ in range(3))
    new, gate = graph.gated_edges(edge, source, target)
    assert np.allclose(new, edge + source + target)
    for a in range(3):
        g = 1 / (1 + np.exp(-new[0, a]))
        assert np.allclose(gate[0, a], g / (g.sum(0) + 1e-6))


def test_sentence_rule_listing_and_no_merge(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a;b. c;d")], "segment int, text string")
    assert [r.sentence for r in transcripts.split_sentences(rows, ";").orderBy("pos").collect()] == ["a", "b. c", "d"]
    for name, n in (("b.mp4", 3), ("a.mp4", 2), ("c.txt", 1)):
        (tmp_path / name).write_bytes(bytes(n))
    assert [(r.path.rpartition("/")[2], r.length) for r in tables.list_files(spark, str(tmp_path)).collect()] == [("a.mp4", 2), ("b.mp4", 3)]
    clips = spark.createDataFrame([("a", 10.0, 5.0)], "filename string, duration double, fps double")
    voice = Function(lambda clips, **_: grid.frame_grid(clips).select("filename", "frame"))
    made = Pipeline(voice=voice).run(clips, merge_tables=False)
    assert made.features is None and made.tables["voice"].count() == 50
    embedded = json.dumps({"filename": "a", "face_embeddings": [[1, 2], [3, 4]], "face_average_embeddings": {"0": [2, 3]}})
    (tmp_path / "e.json").write_text(embedded)
    each, average = json_files.read_video_embeddings(spark, str(tmp_path / "e.json"))
    assert sorted(map(tuple, each.collect())) == [("a", 0, [1, 2]), ("a", 1, [3, 4])] and average.first()[:] == ("a", "0", [2, 3])


def test_lists_of_different_lengths(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"filename": "a", "frame": [0, 1], "time": [0.0]}))
    with pytest.raises(PySparkException, match="different lengths"):
        json_files.read_voice(spark, str(tmp_path / "v.json")).collect()
    two = "\n".join(json.dumps({"filename": n, "frame": [0, 1], "time": [0.0, 0.2], "pitch_f0_hz": [1.5, None]}, indent=2) for n in "ab")
    (tmp_path / "w.json").write_text(two)
    assert sorted(map(tuple, json_files.read_voice(spark, str(tmp_path / "w.json")).collect()))[:2] == [("a", 0, 0.0, 1.5), ("a", 1, 0.2, None)]
