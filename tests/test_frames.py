"""Worked values of the frame table: grids, stabbing, merge, formats, voice, streaming."""

import itertools
import math
import wave

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kinograph.functions import scalars
from kinograph.operators import faces, graph, grid, interpolate, merge, postprocess, stabbing, transcripts, validate, voice
from kinograph.plans.pipeline import Function, Pipeline, postprocess_features, require_valid
from kinograph.sources import json_files, media, rttm, srt, tables
from kinograph.streaming.stabbing import stab_stream


@pytest.fixture
def clips(spark):
    return spark.createDataFrame([("a", 5.0, 25.0)], "filename string, duration double, fps double")


@pytest.fixture
def segments(spark):
    return spark.createDataFrame([("a", 1, 1.92, 2.92, "1", None), ("a", 1, 3.86, 4.87, "1", None)], "filename string, channel int, begin double, end double, name string, conf double")


@pytest.fixture
def spoken(spark):
    return spark.createDataFrame([("a", 2.00, 2.41, 0, "Thank you, honey.", "1", 0.89898), ("a", 4.47, 4.67, 1, "I, uh...", "1", 0.89898)], "filename string, begin double, end double, index int, text string, speaker string, confidence double")


@pytest.fixture
def scores(spark):
    return spark.createDataFrame([("a", 2.00, 2.41, "Thank you, honey.", 0.88, 0.02, 0.1), ("a", 4.47, 4.67, "I, uh...", 0.1, 0.37, 0.53)], "filename string, begin double, end double, text string, pos double, neg double, neu double")


def test_grid_and_stabbing(clips, segments):
    rows = merge.stab_segments(grid.frame_grid(clips, 5), segments).collect()
    assert len(rows) == 25
    assert sorted(r.frame for r in rows if r.segment_start is not None) == [50, 55, 60, 65, 70, 100, 105, 110, 115, 120]
    assert grid.frame_grid(clips, 5, 10).agg(F.min("frame")).first()[0] == 10
    assert grid.frame_grid(clips.withColumn("duration", F.lit(0.0))).count() == 0


def test_stabbing_is_half_open_and_free_of_width(spark):
    points = spark.createDataFrame([("a", float(t)) for t in range(10)] + [(None, 1.0)], "k string, time double")
    spans = spark.createDataFrame([("a", 0.0, 3.0, 1), ("a", 2.0, 9.0, 2), ("a", 5.0, 5.0, 3), (None, 0.0, 9.0, 4)], "k string, begin double, end double, n int")
    want = sorted([(float(t), 1) for t in range(3)] + [(float(t), 2) for t in range(2, 9)])
    for width in (None, 0.1, 100):
        assert sorted((r.time, r.n) for r in stabbing.stab(points, spans, ["k"], width=width).collect()) == want
    assert stabbing.stab(points, spans, ["k"], "left").where("n IS NULL").count() == 2
    with pytest.raises(ValueError, match="how"):
        stabbing.stab(points, spans, ["k"], "outer")


def test_merge(clips, segments, spoken, scores, spark):
    video = spark.createDataFrame([("a", i * 5, [0.0, 1.0, 2.0, 3.0], 0.5, "0") for i in range(25)], "filename string, frame bigint, face_box array<double>, face_prob double, face_label string")
    out = merge.merge_features(clips, video, segments, spoken, scores, skip=5)
    assert out.columns[:4] == ["filename", "time", "frame", "face_box"] and out.count() == 25
    assert [r.frame for r in out.where("span_text IS NOT NULL").orderBy("frame").collect()] == [50, 55, 60, 115]
    assert require_valid(out) is out
    assert postprocess.relabel_faces(out).where("face_label <> '1'").count() == 0
    with pytest.raises(ValueError, match="face_prob_in_range"):
        require_valid(out.withColumn("face_prob", F.lit(2.0)))
    with pytest.raises(ValueError, match="nothing"):
        merge.merge_features(clips)
    aus = F.array(*[F.lit(0.1)] * 41)
    flat = postprocess_features(out.withColumns({"face_aus": aus, "face_landmarks": F.array(*[F.array(F.lit(0.0), F.lit(1.0))] * 5)}))
    assert {"face_box_x1", "face_au_1", "face_au_R14", "face_landmarks_y5"} <= set(flat.columns)


def test_null_speakers_meet(clips, segments, spoken):
    null = F.lit(None).cast("string")
    g = grid.frame_grid(clips, 5)
    out = merge.with_spans(merge.stab_segments(g, segments.withColumn("name", null)), merge.stab_spans(g, spoken.withColumn("speaker", null)))
    assert out.where("span_text IS NOT NULL").count() == 4


def test_pipeline_of_stages(clips, segments, spoken):
    made = Pipeline(segments=Function(lambda clips: segments), transcription=Function(lambda clips, segments: spoken)).run(clips, 5)
    assert made.features.count() == 25 and set(made.tables) == {"segments", "transcription"}
    with pytest.raises(ValueError, match="needs"):
        Pipeline(transcription=Function(lambda clips: spoken))
    with pytest.raises(TypeError, match="missing"):
        Pipeline(segments=Function(lambda clips: clips)).run(clips)


def test_formats(spark, segments, spoken, tmp_path):
    rttm.write_rttm(segments, str(tmp_path / "r"))
    back = rttm.read_rttm(spark, str(tmp_path / "r")).orderBy("begin").collect()
    assert [(r.channel, r.begin, round(r.end, 2), r.name, r.conf) for r in back] == [(1, 1.92, 2.92, "1", None), (1, 3.86, 4.87, "1", None)]
    srt.write_srt(spoken, str(tmp_path / "s"))
    back = srt.read_srt(spark, str(tmp_path / "s"), "a").orderBy("begin").collect()
    assert [(r.begin, r.end, r["index"], r.text, r.speaker) for r in back] == [(2.0, 2.41, 0, " Thank you, honey.", "1"), (4.47, 4.67, 1, " I, uh...", "1")]
    json_files.write_objects(json_files.annotation_objects(segments, ["channel"]), str(tmp_path / "j"))
    assert sorted(map(tuple, json_files.read_annotation(spark, str(tmp_path / "j"), "segments").collect())) == sorted(map(tuple, segments.collect()))
    json_files.write_objects(json_files.annotation_objects(spoken), str(tmp_path / "t"))
    assert json_files.read_annotation(spark, str(tmp_path / "t"), "transcription").select(spoken.columns).exceptAll(spoken).count() == 0
    tables.write_csv(segments, str(tmp_path / "c"))
    scanned = tables.scan_csv(spark, str(tmp_path / "c"), {"begin": "double", "name": "int"}, tolerant=True)
    assert scanned.agg(F.sum("name"), F.min("begin")).first()[:] == (2, 1.92)
    with pytest.raises(ValueError, match="split"):
        tables.write_csv(segments.withColumn("x", F.array(F.lit(1))), str(tmp_path / "d"))
    merged = merge.merge_features(spark.createDataFrame([("a", 5.0, 25.0)], "filename string, duration double, fps double"), segments=segments, skip=5)
    json_files.write_merged(merged, str(tmp_path / "m.json"))
    assert json_files.read_merged(spark, str(tmp_path / "m.json")).count() == 25


def test_video_json(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"filename": "a", "frame": [0, 1, 2], "time": [0.2, 0.4, 0.6], "face_box": [[0, 1, 2, 3], [0, 1, 2, 3], null], "face_label": [3.0, "4", null], "face_embeddings": [[1, 2]], "face_average_embeddings": {"3": [1, 2]}}')
    rows = json_files.read_video(spark, str(tmp_path / "v.json")).orderBy("frame").collect()
    assert [r.face_label for r in rows] == ["3", "4", None] and rows[2].face_box is None
    each, average = json_files.read_video_embeddings(spark, str(tmp_path / "v.json"))
    assert each.count() == average.count() == 1
    (tmp_path / "bad.json").write_text('{"filename": "a", "frame": [0, 1, 2], "time": [0.2]}')
    with pytest.raises(PySparkException):
        json_files.read_video(spark, str(tmp_path / "bad.json")).collect()


def test_faces(spark):
    rows = spark.createDataFrame([("a", 0, [1.0, 0.0], "0"), ("a", 1, [1.0, 0.0], "0"), ("a", 2, [0.0, 1.0], "1"), ("a", 3, [0.0, 2.0], "1"), ("a", 4, [1.0, 1.0], None)], "filename string, pos int, embedding array<double>, face_label string")
    means = {r.face_label: r.embedding for r in faces.centroids(rows, ["filename"]).collect()}
    assert means == {"0": [1.0, 0.0], "1": [0.0, 1.5]}
    got = {r.pos: r.confidence for r in faces.cluster_confidence(rows, ["filename"]).collect()}
    assert got[0] == got[2] == 1 and got[4] is None
    label = {r.pos: r.face_label for r in faces.identify(rows.where("pos < 4").drop("face_label"), 2).collect()}
    assert label[0] == label[1] != label[2] == label[3]
    box = spark.createDataFrame([([20.0, 60.0, 80.0, 120.0],)], "face_box array<double>")
    assert box.select(*faces.face_size(F.col("face_box"))).first()[:] == (60, 60)
    with pytest.raises(PySparkException):
        box.select(*faces.face_size(F.reverse("face_box"))).collect()


def test_assignment_is_optimal():
    r = np.random.default_rng(1)
    for n, m in itertools.product(range(1, 5), range(1, 6)):
        cost = r.integers(-9, 9, (n, m)).astype(float)
        rows, cols = postprocess.assign(cost)
        small, large = (cost, cost.T)[n > m], max(n, m)
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(large), min(n, m)))
        assert len(set(rows)) == len(set(cols)) == min(n, m) and math.isclose(cost[rows, cols].sum(), best)


def test_rounding_keeps_signs(spark):
    values = [-4e-7, -0.0, 0.0, 4e-7, -5e-7, 1e305, -math.inf, 1.2345675, -2.5]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").orderBy("i").select(scalars.round_signed(F.col("x"), 6).alias("x")).collect()
    assert [str(r.x) for r in rows] == ["-0.0", "-0.0", "0.0", "0.0", "-1e-06", "1e+305", "-inf", str(math.floor(1.2345675 * 1e6 + 0.5) / 1e6), "-2.5"]
    assert spark.range(1).select(scalars.round_signed(F.lit(None).cast("double"), 6)).first()[0] is None


def test_nearest_nodes_by_blocks(spark, monkeypatch):
    """Against all pairs in plain Python: graphs of several blocks, ties, vectors that are NULL, with holes, NaNs or of other lengths."""
    monkeypatch.setattr(graph, "BLOCK", 7)
    r = np.random.default_rng(3)
    rows = [("a", i, r.normal(size=4).round(1).tolist()) for i in range(40)] + [("b", i, [float(i % 2), 1.0, 0.0, 0.0]) for i in range(9)]
    rows += [("c", 0, None), ("c", 1, [1.0, None]), ("c", 2, [1.0]), ("c", 3, [2.0]), ("c", 4, [float("nan")]), ("c", 5, [1.0, 2.0]), ("c", 6, []), (None, 7, [1.0])]
    want = []
    for g in "abc":
        mine = [(i, v) for h, i, v in rows if h == g]
        for i, v in mine:
            sims = []
            for j, w in mine:
                fine = v is not None and w is not None and len(v) == len(w) and None not in v + w
                x = round(sum(p * q for p, q in zip(v, w)), 9) + 0.0 if fine else None
                sims.append((-math.inf if x is None else math.inf if math.isnan(x) else x, j))
            want += [(g, i, j) for x, j in sims if sum(y > x for y, _ in sims) < 3]
    nodes = spark.createDataFrame(rows, "graph string, node int, vector array<double>")
    found = graph.knn_adjacency(nodes, 3)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    # pairs are compared in Python by blocks; no join of nodes makes them
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()


def test_digraph_is_made_once(spark):
    """Weights by hand, with an edge twice, a node without edges, NULLs; the plan of the edges is there once."""
    rows = [("a", 1, 2), ("a", 1, 3), ("a", 2, 1), ("a", 2, 1), ("a", 2, 2), ("b", 1, 1), ("b", None, 1), ("b", 1, None), (None, 1, 1)]
    edges = spark.createDataFrame(rows, "graph string, src int, dst int")
    found = sorted((*r[:3], round(r[3], 9)) for r in graph.normalise_digraph(edges).collect())
    assert found == [("a", 1, 2, round(6**-0.5, 9)), *[("a", 2, 1, round(6**-0.5, 9))] * 2, ("a", 2, 2, round(1 / 3, 9)), ("b", 1, 1, 0.5)]
    nodes = spark.createDataFrame([("a", i, [float(i)]) for i in range(5)], "graph string, node int, vector array<double>")
    plan = graph.normalise_digraph(graph.knn_adjacency(nodes, 2))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1


def test_graph_arithmetic():
    r = np.random.default_rng(2)
    x = r.normal(size=(3, 27, 8))
    out = graph.unit_activations(x, r.normal(size=(27, 8)), r.normal(size=(14, 8)))
    assert out.shape == (3, 41) and np.abs(out).max() <= 1 + 1e-9
    w = [r.normal(size=(8, 4)) for _ in range(3)]
    assert graph.cross_attention(x, x, *w).shape == (3, 27, 4)
    _, gate = graph.gated_edges(r.normal(size=(2, 5, 5, 3)), np.zeros(3), np.zeros(3))
    assert np.allclose(gate.sum(-2), 1, atol=1e-4)


def test_sentences(spark):
    rows = spark.createDataFrame([(1, " He met Dr. Who. It is e.g. fine? Yes! ")], "segment int, text string")
    assert [r.sentence for r in transcripts.split_sentences(rows).orderBy("pos").collect()] == ["He met Dr. Who.", "It is e.g. fine?", "Yes!"]
    w = spark.sql("SELECT array(named_struct('probability', 0.75D), named_struct('probability', 0.25D)) AS w")
    both = [transcripts.confidence(F.col("w"), F.lit(0), F.lit(n), m) for n, m in ((1, "mean"), (2, "reference"), (0, "reference"))]
    assert w.select(*both).first()[:] == (0.5, 0.5, None)


def test_interpolation_at_edges(spark):
    signal = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 3.0), ("a", 2.0, float("nan")), ("a", 3.0, 5.0)], "k string, ts double, value double")
    points = spark.createDataFrame([("a", t) for t in (-0.5, 0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 3.5)], "k string, time double")
    got = [r.value for r in interpolate.interpolate(points, signal, ["k"]).orderBy("time").collect()]
    assert got == [None, 1.0, 2.0, 3.0, None, None, 5.0, None]


def test_voice(spark, tmp_path):
    rate = 16000
    x = (np.sin(2 * np.pi * 220 * np.arange(rate) / rate) * 12000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(x.tobytes())
    long = voice.extract(media.read_audio(spark, str(tmp_path)), voice.FEATURES)
    by = {r.feature: r.v for r in long.groupBy("feature").agg(F.percentile_approx("value", 0.5).alias("v")).collect()}
    assert abs(by["pitch_f0_hz"] - 220) < 3 and by["rms_db"] > -30
    with pytest.raises(TypeError):
        voice.check_features({"x": 1})


def test_validators(spark):
    bad = spark.createDataFrame([(1, [0.0, 1.0, 2.0], 0.5), (0, None, 0.5)], "frame int, face_box array<double>, face_prob double").withColumns({"face_landmarks": F.array(F.array(F.lit(1))), "face_aus": F.lit(None), "place": F.when(F.col("frame") == 1, 0).otherwise(1)})
    assert validate.bad_boxes(bad).count() == 1 and validate.half_empty_faces(bad).count() == 1 and validate.bad_landmarks(bad).count() == 2
    assert validate.not_ascending(bad, [], "place", "frame").count() == 1


def test_face_ranges(spark):
    nan, none = float("nan"), None
    faces_ = [(1, [0.0, 1.0, 2.0, 3.0], [[0.0, 1.0]], [0.0, 1.0]), (2, [0.0, -1.0, 2.0, 3.0], [[0.0, -0.1]], [1.1]), (3, [nan] * 4, [[nan, 1.0]], [nan]), (4, none, none, none), (5, [none] * 4, [[1.0, none]], [-0.1])]
    rows = spark.createDataFrame(faces_, "id int, face_box array<double>, face_landmarks array<array<double>>, face_aus array<double>")
    for f in (validate.negative_boxes, validate.negative_landmarks, validate.action_units_outside):
        assert sorted(r.id for r in f(rows).collect()) == [2, 3, 5]


def test_coercers(spark):
    assert scalars.str2bool("True") and scalars.optional_int("None") is None and scalars.bool_or_str("x") == "x"
    with pytest.raises(ValueError):
        scalars.str2bool("yes")
    row = spark.sql("SELECT 3.0D AS a, 0.1D AS b, double('NaN') AS c").select(*[scalars.float_to_label(F.col(c), "double") for c in "abc"]).first()
    assert row[:] == ("3", "0", None)


def test_stream(spark, segments, tmp_path):
    path = str(tmp_path / "points")
    spark.createDataFrame([("a", 2.0), ("a", 3.0)], "filename string, time double").write.parquet(path)
    points = spark.readStream.schema("filename string, time double").parquet(path)
    q = stab_stream(points, segments, ["filename"], "left").writeStream.format("memory").queryName("stabbed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.time, r.name) for r in spark.table("stabbed").collect()) == [(2.0, "1"), (3.0, None)]
