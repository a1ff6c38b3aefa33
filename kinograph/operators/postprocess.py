"""Post-processing of the merged table: columns of lists, labels of faces and speakers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAIN_UNITS = (1, 2, 4, 5, 6, 7, *range(9, 21), *range(22, 28), 32, 38, 39)
SIDE_UNITS = tuple(f"{side}{n}" for n in (1, 2, 4, 6, 10, 12, 14) for side in "LR")
ACTION_UNITS = MAIN_UNITS + SIDE_UNITS
LANDMARKS = (1, 2, 3, 4, 5)
NO_LABEL = "-1"


def split_list_columns(df: DataFrame, au_columns: list = ACTION_UNITS, landmark_columns: list = LANDMARKS) -> DataFrame:
    """df with single columns in place of face_box, face_aus and face_landmarks; names beyond a list's end are NULL."""
    out = []
    for c in df.columns:
        if c == "face_box":
            out += [F.get(c, i).alias(f"face_box_{n}") for i, n in enumerate(("x1", "y1", "x2", "y2"))]
        elif c == "face_aus":
            out += [F.get(c, i).alias(f"face_au_{n}") for i, n in enumerate(au_columns)]
        elif c == "face_landmarks":
            out += [F.get(F.get(c, i), j).alias(f"face_landmarks_{x}{n}") for i, n in enumerate(landmark_columns) for j, x in enumerate("xy")]
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def sub_labels(df: DataFrame, mapping: dict[str, str] | DataFrame, column: str) -> DataFrame:
    """df with the labels of column replaced; those without a replacement, NULL among them, become "-1".

    mapping is a dict, or for large ones a DataFrame (label, replacement) with one row for each label.
    """
    if isinstance(mapping, dict):
        pairs = [F.lit(x) for kv in mapping.items() for x in kv]
        new = F.try_element_at(F.create_map(*pairs), F.col(column)) if pairs else F.lit(None)
        return df.withColumn(column, F.coalesce(new, F.lit(NO_LABEL)))
    right = mapping.select(F.col("label").alias("old label"), F.col("replacement").alias("new label"))
    joined = df.join(right, F.col(column) == F.col("old label"), "left")
    return joined.withColumn(column, F.coalesce("new label", F.lit(NO_LABEL))).drop("old label", "new label")


def contingency(df: DataFrame, face: str = "face_label", speaker: str = "segment_speaker_label", by: list[str] | None = None) -> DataFrame:
    """How many rows have both a face and a speaker label, for each pair of them."""
    return df.dropna(subset=[face, speaker]).groupBy(*(by or []), face, speaker).agg(F.count(F.lit(1)).alias("n"))


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a matching of least cost in a rectangular matrix, by shortest augmenting paths."""
    if cost.shape[0] > cost.shape[1]:
        cols, rows = assign(cost.T)
        order = np.argsort(rows)
        return rows[order], cols[order]
    n, m = cost.shape
    u, v, row_of = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        least, prev, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col = i, -1
        while True:
            slack = cost[row] - u[row] - v + (least[col] if col >= 0 else 0)
            better = ~done & (slack < least)
            least[better], prev[better] = slack[better], col
            open_ = np.where(done, np.inf, least)
            col = int(open_.argmin())
            done[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
        reach = least[col]
        seen = done & (row_of >= 0)
        u[row_of[seen]] += reach - least[seen]
        u[i] += reach
        v[done] -= reach - least[done]
        while col >= 0:
            before = prev[col]
            row_of[col] = i if before < 0 else row_of[before]
            col = before
    cols = np.flatnonzero(row_of >= 0)
    order = np.argsort(row_of[cols])
    return row_of[cols][order], cols[order]


def face_speaker_mapping(df: DataFrame, face: str = "face_label", speaker: str = "segment_speaker_label", by: str | None = "filename") -> DataFrame:
    """(by, label, replacement): for each recording, faces matched to speakers so that as many rows as possible agree.

    Each face has at most one speaker and the reverse; of equally good matchings the one found by ascending labels counts.
    The work for a recording depends on its numbers of labels, not of rows.
    """
    key = by or "all"
    counts = contingency(df if by else df.withColumn(key, F.lit(0)), face, speaker, [key])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.pivot(index=face, columns=speaker, values="n").fillna(0).sort_index().sort_index(axis=1)
        r, c = assign(-t.to_numpy(float))
        return pd.DataFrame({key: pdf[key].iloc[0], "label": [str(t.index[i]) for i in r], "replacement": [str(t.columns[j]) for j in c]})

    kind = counts.schema[key].dataType.simpleString()
    out = counts.groupBy(key).applyInPandas(run, f"{key} {kind}, label string, replacement string")
    return out if by else out.drop(key)


def relabel_faces(df: DataFrame, by: str = "filename") -> DataFrame:
    """df whose face labels are those of the matched speakers."""
    mapping = face_speaker_mapping(df, by=by)
    joined = df.join(mapping.withColumnRenamed("label", "face_label"), [by, "face_label"], "left")
    return joined.withColumn("face_label", F.coalesce("replacement", F.lit(NO_LABEL))).select(df.columns)
