"""Column functions: coercions, vectors, decibels, paths; and the coercers of command-line values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def float_to_label(x: Column, kind: str) -> Column:
    """Labels of numbers are their integral part as text; text passes; NaN is NULL. kind is the column's type."""
    if kind == "string":
        return x
    if kind in ("float", "double"):
        x = F.when(~F.isnan(x), x)
    elif not (kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal")):
        return F.lit(None).cast("string")
    return x.cast("bigint").cast("string")


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def finite_or_null(x: Column) -> Column:
    """NaN becomes NULL; infinities are errors."""
    return F.when(F.abs(x) == float("inf"), F.raise_error(F.lit("infinite value"))).otherwise(nan_to_null(x))


def round_half_even(x: Column, places: int = 2) -> Column:
    return F.bround(x, places)


def round_signed(x: Column, places: int) -> Column:
    """Rounds doubles half away from zero, as SQL engines do in binary: scaled, rounded and scaled back; what is negative stays so, as -0.0.

    What is infinite when scaled, and NaN, is returned as it is.
    """
    unit = F.lit(10.0**places)
    scaled = F.abs(x) * unit
    return F.when((x == 0) | ~(scaled < float("inf")), x).otherwise(F.signum(x) * F.round(scaled, 0) / unit)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity; NULL where a vector has no length."""
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def sentiment_scores(logits: Column) -> list[Column]:
    """neg, neu and pos from three logits; NULLs where there are none."""
    p = softmax(logits)
    return [F.get(p, i).alias(name) for i, name in enumerate(("neg", "neu", "pos"))]


def decibels(amplitude: Column) -> Column:
    """20 log10; NULL for amplitudes of 0 and less."""
    return F.lit(20.0) * F.log10(F.when(amplitude > 0, amplitude))


def harmonic_difference(x: Column, y: Column) -> Column:
    """Level of harmonic x over harmonic y, in dB."""
    return decibels(x) - decibels(y)


def harmonic_formant_difference(h: Column, formant: Column, f0: Column | None = None) -> Column:
    """Level of a harmonic over a formant; with f0, the formant's amplitude is relative to that of f0."""
    level = decibels(formant)
    return decibels(h) - (level if f0 is None else level + decibels(f0))


def dominant_topic(topics: Column) -> Column:
    """The key of a map's greatest value (of equals, the least key); NULL for an empty map."""
    entries = F.map_entries(topics)
    best = F.array_max(F.transform(entries, lambda e: e["value"]))
    return F.array_min(F.transform(F.filter(entries, lambda e: e["value"] == best), lambda e: e["key"]))


def str2bool(s: str) -> bool:
    try:
        return {"True": True, "False": False}[s]
    except KeyError:
        raise ValueError(f"neither True nor False: {s!r}") from None


def optional_int(s: str) -> int | None:
    return None if s == "None" else int(s)


def optional_float(s: str) -> float | None:
    return None if s == "None" else float(s)


def optional_str(s: str) -> str | None:
    return None if s == "None" else s


def bool_or_str(s: str) -> bool | str:
    return {"True": True, "False": False}.get(s, s)
