"""Validators: each returns the rows that offend, so an empty result is a pass; bool_and-style checks return one row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_ascending(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value is less than that of the row before; equal ones are in order."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("value before", before).where(F.col("value before") > F.col(value)).drop("value before")


def uneven_lists(df: DataFrame, lists: list[str], reference: str = "frame") -> DataFrame:
    """Rows of which a list is neither empty nor as long as the reference list."""
    bad = [(F.size(c) > 0) & (F.size(c) != F.size(reference)) for c in lists]
    return df.where(reduce(Column.__or__, bad, F.lit(False)))


def outside(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    return df.where((F.col(column) < low) | (F.col(column) > high) | F.isnan(column))


def bad_boxes(df: DataFrame, box: str = "face_box") -> DataFrame:
    return df.where(F.col(box).isNotNull() & (F.size(box) != 4))


def bad_landmarks(df: DataFrame, landmarks: str = "face_landmarks") -> DataFrame:
    return df.where(F.exists(landmarks, lambda p: F.size(p) != 2))


def _offends(low_only: bool) -> Callable[[Column], Column]:
    return lambda x: x.isNull() | F.isnan(x) | (x < 0) | (F.lit(False) if low_only else x > 1)


def negative_boxes(df: DataFrame, box: str = "face_box") -> DataFrame:
    """Rows whose box has a coordinate that is negative, NaN or NULL."""
    return df.where(F.exists(box, _offends(True)))


def negative_landmarks(df: DataFrame, landmarks: str = "face_landmarks") -> DataFrame:
    return df.where(F.exists(landmarks, lambda p: F.exists(p, _offends(True))))


def action_units_outside(df: DataFrame, aus: str = "face_aus") -> DataFrame:
    """Rows with an action unit that is not within 0 to 1."""
    return df.where(F.exists(aus, _offends(False)))


def half_empty_faces(df: DataFrame) -> DataFrame:
    """Rows without face_box that have a probability, landmarks or action units."""
    return df.where(F.col("face_box").isNull() & (F.col("face_prob").isNotNull() | F.col("face_landmarks").isNotNull() | F.col("face_aus").isNotNull()))


def unknown_labels(df: DataFrame, averages: DataFrame, on: list[str], label: str = "face_label") -> DataFrame:
    """Labelled rows whose label has no average embedding; a recording without any of them is not checked."""
    known = averages.select(*on, label).distinct()
    covered = df.where(F.col(label).isNotNull()).join(known.select(*on).distinct(), on, "left_semi") if on else df.where(F.col(label).isNotNull())
    return covered.join(known, [*on, label], "left_anti")


def not_contained(merged: DataFrame, source: DataFrame, on: list[str], columns: dict[str, str]) -> DataFrame:
    """Values of source columns that do not occur in the merged column they go to, one row (on, column, value) each."""
    parts = []
    for mine, theirs in columns.items():
        want = source.where(F.col(mine).isNotNull()).select(*on, F.col(mine).cast("string").alias("value")).distinct()
        have = merged.select(*on, F.col(theirs).cast("string").alias("value")).distinct()
        parts.append(want.join(have, [*on, "value"], "left_anti").select(*on, F.lit(mine).alias("column"), "value"))
    return reduce(DataFrame.unionByName, parts)


def outside_domain(merged: DataFrame, source: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Merged values, without NULL, that the source does not have."""
    return not_contained(source, merged, on, {c: c for c in columns})


def all_true(df: DataFrame, checks: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Whether each check holds for all rows, NULLs not counting."""
    return df.groupBy(*(by or [])).agg(*[F.bool_and(c).alias(name) for name, c in checks.items()])


def merged_checks(merged: DataFrame) -> dict[str, Column]:
    """The invariants of the merged table, for the inputs that it has."""
    have, checks = set(merged.columns), {}
    col = F.col
    checks["time_not_negative"] = (col("time") >= 0) & (col("frame") >= 0)
    if "face_box" in have:
        checks["face_box_of_four"] = F.size("face_box") == 4
        checks["face_nulls_together"] = col("face_box").isNull() == col("face_prob").isNull()
        checks["face_prob_in_range"] = col("face_prob").between(0, 1)
        if "face_landmarks" in have:
            checks["landmarks_of_five"] = (F.size("face_landmarks") == 5) & F.forall("face_landmarks", lambda p: F.size(p) == 2)
        if "face_aus" in have:
            checks["action_units"] = (F.size("face_aus") == 41) & F.forall("face_aus", lambda p: p.between(0, 1))
        if "face_confidence" in have:
            checks["face_confidence_in_range"] = col("face_confidence").between(0, 1)
    if "segment_start" in have:
        checks["segment_around_time"] = (col("segment_start") <= col("time")) & (col("time") <= col("segment_end"))
        checks["segment_nulls_together"] = (col("segment_start").isNull() == col("segment_end").isNull()) & (col("segment_start").isNotNull() | col("segment_speaker_label").isNull())
    if "span_start" in have:
        checks["span_around_time"] = (col("span_start") <= col("time")) & (col("time") <= col("span_end"))
        checks["span_nulls_together"] = (col("span_start").isNull() == col("span_end").isNull()) & (col("span_start").isNull() == col("span_text").isNull())
    if "span_sent_pos" in have:
        checks["scores_in_range"] = col("span_sent_pos").between(0, 1) & col("span_sent_neg").between(0, 1) & col("span_sent_neu").between(0, 1)
        checks["scores_sum_to_one"] = F.abs(col("span_sent_pos") + col("span_sent_neg") + col("span_sent_neu") - 1) < 1e-2
    return checks


def validate_merged(merged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (for each ``by``) with a boolean for every invariant."""
    return all_true(merged, merged_checks(merged), by)
