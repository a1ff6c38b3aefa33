"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size grows with the document, sketches
of parts merge by union, and the containment of a small document in a far larger one is estimated as well as that of equals.
All of it is built-in SQL; a sketch is made where its text is read, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, FRACTION = 5, 16
#: Hashes are the first 60 bits of md5.
RANGE = 1 << 60
_SPLIT = "[ \\t\\n\\r\\f\\x0B]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")



def sketches(docs: DataFrame, shingle: int = SHINGLE, fraction: int = FRACTION) -> DataFrame:
    """(doc_id, n_shingles, sketch) for every row: the sorted distinct hashes under 1/fraction of the range.

    Shingles are ``shingle`` consecutive lower-cased words; a text with fewer words, but at least one, is one shingle.
    n_shingles counts them with repeats. NULL, empty and blank texts have 0 shingles and an empty sketch. Every row gives
    one row: repeated rows give equal rows. A NULL doc_id stays NULL. Other columns are not looked at.
    """
    first = "0" * (len(f"{fraction - 1:b}") // 4)
    limit = RANGE // fraction
    w = docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("w"))
    n = F.when(F.size("w") == 0, 0).otherwise(F.greatest(F.lit(1), F.size("w") - (shingle - 1)))
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    md5s = F.transform(at, lambda i: F.md5(F.array_join(F.slice(F.col("w"), i, shingle), " ")))
    # only the few hashes that may pass are made into numbers
    few = F.filter(md5s, lambda h: h.startswith(first)) if first else md5s
    hashes = F.transform(few, lambda h: F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint"))
    return w.select("doc_id", n.alias("n_shingles"), F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < limit))).alias("sketch"))


def merge(sketched: DataFrame, *keys: str) -> DataFrame:
    """One sketch for each combination of keys: the union of its documents' sketches. n_shingles is their sum."""
    return sketched.groupBy(*keys).agg(F.sum("n_shingles").alias("n_shingles"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))).alias("sketch"))


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's distinct shingles that b has; NULL where a's sketch is empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a).cast("double"))


SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, len(w) - {SHINGLE - 1}) END AS n FROM w),
h AS (SELECT *, list_transform(range(1, n + 1), lambda i: ('0x' || substr(md5(array_to_string(w[i : i + {SHINGLE - 1}], ' ')), 1, 15))::BIGINT) AS h FROM n)
SELECT doc_id, n::INTEGER AS n_shingles, list_sort(list_distinct(list_filter(h, lambda x: x < {RANGE // FRACTION}))) AS sketch FROM h
"""
