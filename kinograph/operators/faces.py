"""Faces of frames and the clusters of their embeddings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kinograph.functions.scalars import cosine_distance


def face_size(box: Column) -> tuple[Column, Column]:
    """Width and height of (x1, y1, x2, y2); an error where either is not positive."""
    w, h = F.get(box, 2) - F.get(box, 0), F.get(box, 3) - F.get(box, 1)
    check = lambda x: F.when((w > 0) & (h > 0), x).when(box.isNotNull(), F.raise_error(F.lit("face box without area")))
    return check(w), check(h)


def large_faces(faces: DataFrame, min_width: float = 45, min_height: float = 45, box: str = "face_box") -> DataFrame:
    """Faces that are wide or high enough."""
    w, h = face_size(F.col(box))
    return faces.where((w >= min_width) | (h >= min_height))


def keep_frames(frames: DataFrame, faces: DataFrame) -> DataFrame:
    """The frames with their faces; a frame without one has one row with NULLs."""
    return frames.join(faces, ["filename", "frame"], "left")


def first_faces(faces: DataFrame, k: int, order: str = "pos") -> DataFrame:
    """The first k faces of each frame in the detector's order."""
    w = Window.partitionBy("filename", "frame").orderBy(order)
    return faces.withColumn("face rank", F.row_number().over(w)).where(F.col("face rank") <= k).drop("face rank")


def explode_faces(frames: DataFrame, lists: list[str]) -> DataFrame:
    """One row for each face of per-frame lists of equal length, with its place ``pos``; frames without faces have NULLs."""
    rest = [c for c in frames.columns if c not in lists]
    rows = frames.select(*rest, F.posexplode_outer(F.arrays_zip(*lists)).alias("pos", "face"))
    return rows.select(*rest, "pos", *[F.col(f"face.{c}").alias(c) for c in lists])


def _mean_vectors(embeddings: DataFrame, by: list[str], skip_nan: bool, vector: str) -> DataFrame:
    x = F.col("x").cast("double")
    rows = embeddings.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.when(~F.isnan(x), x) if skip_nan else x).alias("x"))
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("embedding"))


def _labelled(embeddings: DataFrame, label: str) -> DataFrame:
    return embeddings.where(F.col(label).isNotNull() & (F.col(label).cast("string") != "NaN"))


def average_embeddings(embeddings: DataFrame, by: list[str], label: str = "face_label", vector: str = "embedding") -> DataFrame:
    """The mean vector of each label; a NaN makes the mean of its dimension NaN. Rows without label are left out."""
    return _mean_vectors(_labelled(embeddings, label), [*by, label], False, vector)


def centroids(embeddings: DataFrame, by: list[str], label: str = "face_label", vector: str = "embedding", skip_nan: bool = True, unlabelled: bool = False) -> DataFrame:
    """As average_embeddings, but NaNs are left out of the means; ``number`` counts the labels of a recording in order.

    Without skip_nan, a NaN makes the mean of its dimension NaN; unlabelled: the rows without label have a centroid too, the last.
    """
    means = _mean_vectors(embeddings if unlabelled else _labelled(embeddings, label), [*by, label], skip_nan, vector)
    number = F.row_number().over((Window.partitionBy(*by) if by else Window).orderBy(F.col(label).asc_nulls_last()))
    return means.withColumn("number", number - 1)


def cluster_confidence(embeddings: DataFrame, by: list[str], label: str = "face_label", vector: str = "embedding") -> DataFrame:
    """embeddings with ``confidence``: how much nearer, by cosine distance, the own centroid is than the nearest other one.

    max((d2 - d1) / d2, 0); NULL for rows without label and where there is one cluster only. The centroids of a recording,
    a few rows, meet its faces in an equi-join, or, without ``by``, as a broadcast of one row for each label.
    """
    means = centroids(embeddings, by, label, vector).select(*by, F.struct(F.col(label).alias("l"), F.col("embedding").alias("c")).alias("m"))
    packed = means.groupBy(*by).agg(F.collect_list("m").alias("cluster centroids")) if by else means.agg(F.collect_list("m").alias("cluster centroids"))
    joined = embeddings.join(packed, by, "left") if by else embeddings.crossJoin(F.broadcast(packed))
    distances = F.transform("cluster centroids", lambda m: F.struct(m["l"].alias("l"), cosine_distance(F.col(vector), m["c"]).alias("d")))
    rows = joined.withColumn("centroid distances", distances)
    own = F.array_min(F.transform(F.filter("centroid distances", lambda x: x["l"] == F.col(label)), lambda x: x["d"]))
    other = F.array_min(F.transform(F.filter("centroid distances", lambda x: x["l"] != F.col(label)), lambda x: x["d"]))
    score = F.try_divide(other - own, other)
    return rows.withColumn("confidence", F.when(score.isNotNull(), F.greatest(score, F.lit(0.0)))).drop("cluster centroids", "centroid distances")


class NotEnoughFacesError(ValueError):
    """There are fewer faces than clusters."""


def spectral(x: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Spectral clustering with an RBF affinity of width 1: k-means, from farthest points, on the first eigenvectors."""
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    a = np.exp(-d)
    s = 1 / np.sqrt(a.sum(1))
    _, v = np.linalg.eigh(a * s[:, None] * s[None])
    z = v[:, -k:]
    z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    return kmeans(z, k, rounds)


def kmeans(x: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    at = [0]
    near = ((x - x[0]) ** 2).sum(1)
    for _ in range(1, k):
        at.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
    c = x[at].copy()
    for _ in range(rounds):
        label = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return label


def identify(embeddings: DataFrame, num_faces: int, clusterer: Callable[[np.ndarray, int], np.ndarray] = spectral, by: str = "filename", vector: str = "embedding") -> DataFrame:
    """embeddings with ``face_label``: the cluster of each face among those of its recording.

    Vectors that are not finite have no label. A recording with fewer finite vectors than num_faces, but some, is an error.
    clusterer takes vectors and their number of clusters; labels have no meaning across recordings. The default compares all
    pairs of a recording's faces, in one task; kmeans takes as long as there are faces, for long recordings.
    """
    out = StructType([*embeddings.schema, StructField("face_label", StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [np.asarray(v if v is not None else [np.nan], float) for v in pdf[vector]]
        size = max(map(len, rows))
        x = np.array([r if len(r) == size else np.full(size, np.nan) for r in rows])
        fine = np.isfinite(x).all(1)
        labels = np.full(len(x), None, object)
        if fine.any():
            if fine.sum() < num_faces:
                raise NotEnoughFacesError(f"{fine.sum()} faces for {num_faces} clusters")
            labels[fine] = [str(int(i)) for i in clusterer(x[fine], num_faces)]
        return pdf.assign(face_label=labels)

    return embeddings.groupBy(by).applyInPandas(run, out)
