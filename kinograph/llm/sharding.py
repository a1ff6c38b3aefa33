"""Sharding by extendible hashing.

A document's hash is the first 60 bits of md5(doc_id). The directory is a binary trie over hash prefixes; a bucket over
the byte limit is split on its next bit, all others stay as they are. The sums of ``step`` levels of the trie are made in
one aggregation; only the rows of buckets that are still too large after them enter the next round. Documents find their
buckets by one look-up in the directory, and those behind its last bit by a second one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinograph.llm._common import cut

BITS = 60


def hash_bits(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("bigint")


def prefix(h: Column, depth: Column | int, bits: int = BITS) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", h, (F.lit(bits) - depth).cast("int"))


def directory(sized: DataFrame, limit: int, step: int = 12) -> DataFrame:
    """(depth, prefix, bytes) of every bucket, from rows (h, bytes)."""
    leaves, depth, rows = [], 0, sized
    while True:
        deep = min(BITS, depth + step)
        fine = rows.groupBy(prefix(F.col("h"), deep).alias("p")).agg(F.sum("bytes").alias("bytes"))
        nodes = cut(
            fine.select(F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("depth"), "p", "bytes")
            .select("depth", prefix(F.col("p"), F.col("depth"), deep).alias("prefix"), "bytes")
            .groupBy("depth", "prefix")
            .agg(F.sum("bytes").alias("bytes"))
        )
        large = nodes.where(F.col("bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fits = nodes.where((F.col("bytes") <= limit) | (F.col("depth") == BITS))
        if depth == 0:
            leaves.append(fits.where("depth = 0"))
        under = fits.withColumn("parent", F.call_function("shiftright", "prefix", F.lit(1))).where(F.col("depth") > depth)
        leaves.append(under.join(large, ["depth", "parent"], "left_semi").select("depth", "prefix", "bytes"))
        if deep == BITS:
            break
        open_ = large.where(F.col("depth") == deep + 1).select(F.col("parent").alias("p"))
        if open_.isEmpty():
            break
        rows = rows.withColumn("p", prefix(F.col("h"), deep)).join(open_, "p", "left_semi").drop("p")
        depth = deep
    return reduce(DataFrame.unionByName, leaves)


def shard(docs: DataFrame, limit: int = 32 << 20, step: int = 12) -> DataFrame:
    """One row (doc_id, shard_depth, shard_prefix, shard_bytes) for each row of docs: its bucket and that bucket's size.

    A row's size is the UTF-8 length of its text; a NULL text has 0 bytes. Rows with equal doc_ids share a bucket, a NULL
    doc_id counts as an empty string. Every bucket has at most ``limit`` bytes, except one whose rows agree in all 60 bits
    (one very long text, or one doc_id repeated), which cannot be split and keeps depth 60. An empty table gives no rows.
    Other columns are not looked at.
    """
    sized = docs.select("doc_id", hash_bits(F.col("doc_id")).alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"))
    buckets = cut(directory(sized.select("h", "bytes"), limit, step).select(F.col("depth").alias("shard_depth"), F.col("prefix").alias("shard_prefix"), F.col("bytes").alias("shard_bytes")))
    # at most BITS + 1 rows
    found = {r[0]: r[1] for r in buckets.groupBy("shard_depth").count().collect()}
    ids = sized.select("doc_id", "h")
    if not found:
        return ids.select("doc_id", F.lit(0).alias("shard_depth"), F.lit(0).cast("bigint").alias("shard_prefix"), F.lit(0).cast("bigint").alias("shard_bytes")).where("false")
    depth = directory_depth(found)
    columns = ["doc_id", F.col("shard_depth").cast("int").alias("shard_depth"), "shard_prefix", "shard_bytes"]
    # one entry of the directory for each prefix of its depth; a bucket that is less deep has several
    first = F.call_function("shiftleft", "shard_prefix", (F.lit(depth) - F.col("shard_depth")).cast("int"))
    last = F.call_function("shiftleft", F.col("shard_prefix") + 1, (F.lit(depth) - F.col("shard_depth")).cast("int")) - 1
    entries = buckets.where(F.col("shard_depth") <= depth).select("*", F.explode(F.sequence(first, last)).alias("entry"))
    at = ids.withColumn("entry", prefix(F.col("h"), depth))
    out = at.join(entries, "entry").select(columns)
    deeper = sorted(d for d in found if d > depth)
    if not deeper:
        return out
    deep = buckets.where(F.col("shard_depth") > depth)
    behind = deep.select(F.call_function("shiftright", "shard_prefix", (F.col("shard_depth") - F.lit(depth)).cast("int")).alias("entry")).distinct()
    few = at.join(behind, "entry", "left_semi").select("doc_id", "h", F.explode(F.array(*[F.lit(d) for d in deeper])).alias("shard_depth"))
    return out.unionByName(few.withColumn("shard_prefix", prefix(F.col("h"), F.col("shard_depth"))).join(deep, ["shard_depth", "shard_prefix"]).select(columns))


def directory_depth(found: dict[int, int]) -> int:
    """The depth of the directory, from the number of buckets of each depth: the greatest at which it has at most eight entries for each bucket.

    Buckets below it are looked up by their own depths. It is at most 12 more than the least depth, so a bucket has at most
    4096 entries.
    """
    least = min(found)
    fits = lambda depth: sum(n << (depth - d) for d, n in found.items() if d <= depth) <= 8 * sum(found.values())
    return max(d for d in range(least, min(max(found), least + 12) + 1) if d == least or fits(d))


def sql(limit: int) -> str:
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(strlen(text), 0) AS bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {BITS // 4}))::BIGINT AS h
  FROM documents),
s AS (
  SELECT r, doc_id, depth, h >> ({BITS} - depth) AS prefix,
         sum(bytes) OVER (PARTITION BY depth, h >> ({BITS} - depth)) AS total
  FROM d, range(0, {BITS + 1}) t(depth))
SELECT doc_id, depth::INTEGER AS shard_depth, prefix AS shard_prefix, total::BIGINT AS shard_bytes FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY depth) AS k FROM s WHERE total <= {limit} OR depth = {BITS})
WHERE k = 1
"""
