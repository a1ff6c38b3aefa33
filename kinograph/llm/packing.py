"""Best-fit packing in bulk-synchronous rounds.

Texts are measured in words; longer ones than ``capacity`` are cut into full pieces and a rest. Pieces over half the
capacity open a bin each. Then, round by round:

* every gap offers its room, as one slot, or as several equal ones where each can take any piece that is left;
* slots and pieces are range-sorted together from large to small, slots before pieces of their size. A sweep gives each
  piece the least free slot that can hold it, the larger piece first: with slots as opening and pieces as closing brackets,
  that is the bracket matching, found within each partition, then for what is left over across partitions by the brackets'
  depth, a running sum;
* gaps shrink by what they took; pieces without a slot wait for the next round, and the largest of them open as many
  bins as the rest needs beyond the room that can still be used.

What the driver sees of a round is the count of waiting pieces of each size and of gaps of each room, at most twice
``capacity`` numbers, whatever the number of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinograph.llm._common import cut, text_key

CAPACITY = 2048
ID = "struct<absent: boolean, doc_id: bigint, th: bigint, piece: int, copy: int>"
_WORD = "[^ \\t\\n\\r\\f\\x0B]++"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD))


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """(size, id) of every piece; copy numbers rows that are equal in doc_id and text."""
    rows = docs.select(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("th"), n_words(F.col("text")).alias("n")).where("n > 0")
    cuts = rows.select("absent", "doc_id", "th", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))).alias("piece"))
    cuts = cuts.selectExpr("absent", "doc_id", "th", "piece", f"cast(least({capacity}, n - piece * {capacity}) AS int) AS size", "row_number() OVER (PARTITION BY doc_id, absent, th, piece ORDER BY n) AS copy")
    return cuts.select("size", F.struct("absent", "doc_id", "th", "piece", "copy").cast(ID).alias("id"))


def _match(kind: np.ndarray, level: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and their slots: on one level, a piece (1) that follows a slot (0)."""
    k, v = kind[order], level[order]
    hit = np.flatnonzero((k[1:] == 1) & (k[:-1] == 0) & (v[1:] == v[:-1])) + 1
    return order[hit], order[hit - 1]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    kind = np.asarray(t.column("kind"))
    run = np.cumsum(1 - 2 * kind.astype(np.int64))
    level = np.where(kind == 0, run - 1, run)
    piece, slot = _match(kind, level, np.lexsort((np.arange(len(kind)), level)))
    bin_at = np.full(len(kind), -1)
    bin_at[piece] = slot
    left = np.ones(len(kind), bool)
    left[slot] = False
    ids = t.column("id").combine_chunks()
    rows = np.flatnonzero(left)
    at = bin_at[rows]
    yield pa.RecordBatch.from_pydict({
        "kind": pa.array(kind[rows]), "size": t.column("size").combine_chunks().take(rows), "id": ids.take(rows), "bin": ids.take(pa.array(at, mask=at < 0)),
        "part": pa.array(np.full(len(rows), TaskContext.get().partitionId(), np.int32)), "seq": pa.array(rows.astype(np.int64)), "level": pa.array(level[rows]), "total": pa.array(np.full(len(rows), run[-1])),
    })


def sweep(slots: DataFrame, waiting: DataFrame) -> DataFrame:
    """(size, id, bin) of every waiting piece; bin is NULL where no slot was left for it."""
    both = slots.selectExpr("0 AS kind", "size", "id", "slot").unionByName(waiting.selectExpr("1 AS kind", "size", "id", "0 AS slot"))
    order = [F.col("size").desc(), F.col("kind"), F.col("id"), F.col("slot")]
    ranged = both.repartitionByRange(*order).sortWithinPartitions(*order)
    swept = cut(ranged.mapInArrow(_sweep, f"kind int, size int, id {ID}, bin {ID}, part int, seq bigint, level bigint, total bigint"))
    # one row for each partition; a running sum over them
    totals = swept.groupBy("part").agg(F.first("total").alias("total"))
    offsets = totals.selectExpr("part", "coalesce(sum(total) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base")
    open_ = swept.where("bin IS NULL").join(offsets, "part").withColumn("level", F.col("level") + F.col("base"))
    near = "PARTITION BY level ORDER BY part, seq"
    far = open_.selectExpr("kind", "size", "id", f"lag(kind) OVER ({near}) AS before", f"lag(id) OVER ({near}) AS slot").selectExpr("kind", "size", "id", "CASE WHEN before = 0 THEN slot END AS bin")
    return swept.where("bin IS NOT NULL").select("size", "id", "bin").union(far.where("kind = 1").select("size", "id", "bin"))


def _opened(left: DataFrame, counts: dict[int, int], k: int) -> tuple[DataFrame, dict[int, int]]:
    """left with ``opens``, true for its k largest pieces, by size, then by id; the counts of the others."""
    rest = dict(counts)
    for size in sorted(counts, reverse=True):
        if k < counts[size]:
            break
        k -= rest.pop(size)
    if not k:
        return left.withColumn("opens", F.col("size") > (max(rest) if rest else 0)), rest
    rest[size] -= k
    edge = left.where(F.col("size") == size).selectExpr("id", "row_number() OVER (PARTITION BY size ORDER BY id) AS r").where(F.col("r") <= k).select(F.col("id").alias("edge id"))
    flagged = left.join(edge, F.col("id") == F.col("edge id"), "left")
    return flagged.select("size", "id", ((F.col("size") > size) | F.col("edge id").isNotNull()).alias("opens")), rest


def place(items: DataFrame, capacity: int) -> DataFrame:
    """(size, id, bin, round) of every piece; a bin is named by the piece that opened it."""
    items = cut(items)
    big = F.col("size") * 2 > capacity
    opened = items.where(big)
    waiting = items.where(~big)
    placed = [opened.selectExpr("size", "id", "id AS bin", "0 AS round")]
    gaps = opened.selectExpr("id", f"{capacity} - size AS room").where("room > 0")
    counts = dict(waiting.groupBy("size").count().collect())
    step = 0
    while counts:
        step += 1
        most, n = max(counts), sum(counts.values())
        slots = gaps.selectExpr("id", "room", f"cast(least(greatest(1, room div {most}), {n}) AS int) AS q").selectExpr("id", "cast(room div q AS int) AS size", "explode(sequence(1, q)) AS slot")
        met = cut(sweep(slots, waiting))
        hit, left = met.where("bin IS NOT NULL"), met.where("bin IS NULL").select("size", "id")
        took = hit.groupBy("bin").agg(F.sum("size").alias("took"))
        gaps = cut(gaps.join(took, F.col("id") == F.col("bin"), "left").selectExpr("id", "cast(room - coalesce(took, 0) AS int) AS room").where("room > 0"))
        placed.append(hit.selectExpr("size", "id", "bin", f"{2 * step - 1} AS round"))
        # how many pieces of each size wait, and how many gaps of each room there are: at most twice capacity rows
        sizes = left.selectExpr("0 AS kind", "size AS x").union(gaps.selectExpr("1 AS kind", "room AS x")).groupBy("kind", "x").count().collect()
        counts = {r["x"]: r["count"] for r in sizes if not r["kind"]}
        if not counts:
            break
        need, least = sum(s * c for s, c in counts.items()), min(counts)
        usable = 0 if sum(counts.values()) == n else sum(r["x"] * r["count"] for r in sizes if r["kind"] and r["x"] >= least)
        k = min(sum(counts.values()), max(0, math.ceil((need - usable) / capacity)))
        waiting = left
        if k:
            flagged, counts = _opened(left, counts, k)
            flagged = cut(flagged)
            new, waiting = flagged.where("opens").select("size", "id"), flagged.where("NOT opens").select("size", "id")
            placed.append(new.selectExpr("size", "id", "id AS bin", f"{2 * step} AS round"))
            gaps = gaps.union(new.selectExpr("id", f"{capacity} - size AS room"))
    return reduce(DataFrame.unionByName, placed)


def _numbered(bins: DataFrame) -> DataFrame:
    """(bin, bin_id): numbers from 0 in the order of the bins' names."""
    spark = bins.sparkSession
    parts = cut(bins.repartitionByRange("bin").sortWithinPartitions("bin").select("bin", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("k")))
    base, n = [], 0
    for part, count in sorted(parts.groupBy("part").count().collect()):
        base.append((part, n))
        n += count
    return parts.join(F.broadcast(spark.createDataFrame(base, "part int, base bigint")), "part").select("bin", (F.col("base") + F.col("k")).alias("bin_id"))


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(bin_id, doc_id, piece, first_word, n_words, bin_offset): where each piece of each document lies.

    A bin holds at most ``capacity`` words. A document of more words is cut into pieces of capacity words and one of the
    rest, numbered from 0; all others have piece 0 alone. Within a bin, pieces follow each other in the order in which they
    came. Of pieces of one size the first by doc_id (NULL last), text hash and piece goes first. Repeated rows are packed
    each. NULL, empty and blank texts have no words and give no row; so does an empty table. Other columns are not looked
    at.
    """
    placed = place(pieces(docs, capacity), capacity)
    numbers = _numbered(placed.where("bin = id").select("bin"))
    ordered = placed.withColumn("bin_offset", F.expr("cast(sum(size) OVER (PARTITION BY bin ORDER BY round, size DESC, id) - size AS int)"))
    return ordered.join(numbers, "bin").select("bin_id", "id.doc_id", "id.piece", (F.col("id.piece") * capacity).alias("first_word"), F.col("size").alias("n_words"), "bin_offset")
