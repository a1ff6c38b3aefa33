"""Line dedup with levelled sorted runs.

The lines that have been seen are kept as runs: tables of (line hash, first place), bucketed and sorted by hash in the
shared folder, with one file for each bucket, so neither a merge anti-join against them nor a compaction shuffles them again,
and a join does not sort them either. Documents come in batches, in the order of doc_id. Each batch finds the first place of
each of its lines, drops the hashes that a run has by a merge anti-join, and writes the others as a run of level 0. When a
level has ``fanout`` runs, they are merged into one run of the next level, bucket by bucket, two at a time. At the end the runs hold exactly
the lines to keep.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.llm._common import cut, new_path, partitions, remove_path, text_key

BATCHES, FANOUT = 4, 2
#: What a line has that is not blank.
REAL = "[^ \\t\\n\\r\\f\\x0B]"
HASH = ["h1", "h2"]
#: Buckets of one file count as sorted.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
LINE = "absent boolean, doc_id bigint, th bigint, line int, h1 bigint, h2 bigint, batch int"


class Runs:
    """The levels of sorted runs. A run is a bucketed table whose files are in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int):
        self.spark, self.fanout, self.levels, self.paths = spark, fanout, [], {}

    def write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, "run")
        n = partitions(self.spark)
        rows.write.bucketBy(n, *HASH).sortBy(*HASH).option("path", self.paths[name]).saveAsTable(name)
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove_path(self.spark, self.paths.pop(name))

    def tables(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def add(self, rows: DataFrame) -> None:
        for name in self.tables():
            rows = rows.join(self.spark.table(name).select(*HASH).hint("merge"), HASH, "left_anti")
        new, level = self.write(rows), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                return
            old, self.levels[level] = self.levels[level], []
            new = old[0]
            for name in old[1:]:
                both = self.write(self.merged(new, name))
                self.drop(new)
                self.drop(name)
                new = both
            level += 1

    def rows(self, names: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, map(self.spark.table, names))

    def merged(self, a: str, b: str) -> DataFrame:
        """All rows of two runs, by a merge join of their buckets; no hash is in both. (A union would not bring the buckets together.)"""
        sides = []
        for name, side in ((a, "x"), (b, "y")):
            rest = [c for c in self.spark.table(name).columns if c not in HASH]
            sides.append(self.spark.table(name).select(*HASH, F.struct(*rest).alias(side)))
        return sides[0].join(sides[1].hint("merge"), HASH, "full").select(*HASH, F.coalesce("x", "y").alias("rest")).select(*HASH, "rest.*")


def first_places(docs: DataFrame, batches: int, fanout: int) -> DataFrame:
    """(absent, doc_id, th, line) of the first occurrence of each line that is not blank."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("th"), "text").where("text IS NOT NULL")
    edges = rows.select("doc_id").approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.001) if batches > 1 else []
    number = sum((F.coalesce((F.col("doc_id") > int(e)).cast("int"), F.lit(1)) for e in edges), F.lit(0))
    lines = rows.select("absent", "doc_id", "th", number.alias("batch"), F.posexplode(F.split("text", "\n")).alias("line", "s")).where(F.col("s").rlike(REAL))
    path = new_path(spark, "lines")
    lines.select("absent", "doc_id", "th", "line", "batch", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), "s").alias("h2")).write.partitionBy("batch").parquet(path)
    runs = Runs(spark, fanout)
    before = spark.conf.get(ORDERED)
    spark.conf.set(ORDERED, "true")
    try:
        hashed = spark.read.schema(LINE).parquet(path)
        for i in range(len(edges) + 1):
            first = hashed.where(F.col("batch") == i).groupBy(*HASH).agg(F.min(F.struct("absent", "doc_id", "th", "line")).alias("at"))
            runs.add(first.select(*HASH, "at.*"))
        return cut(runs.rows(runs.tables()).select("absent", "doc_id", "th", "line"))
    finally:
        spark.conf.set(ORDERED, before)
        for name in runs.tables():
            runs.drop(name)
        remove_path(spark, path)


def kept_text(text: Column, parts: Column, lines: Column) -> Column:
    """text, of which parts are the lines, without those that are neither blank nor numbered in lines."""
    blank = F.filter(F.transform(parts, lambda s, i: F.when(~s.rlike(REAL), i)), lambda i: i.isNotNull())
    places = F.array_sort(F.array_union(lines, blank))
    return F.when(F.size(places) == F.size(parts), text).otherwise(F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n"))


def line_dedup(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs, with all its columns, each line of whose texts occurs once in the whole corpus.

    Lines end at "\\n" and are compared as they are, by two 64-bit hashes. Lines of ASCII white space are always kept. Of
    equal lines the one in the first document stays, in the order of doc_id (NULL last), then of the text's hash, then of
    the lines. A document all of whose lines that are not blank were removed goes; NULL, empty and blank texts stay. Rows
    equal in doc_id and text are one document: they keep the same lines. n_chars, where there is such a column, follows
    the text. An empty table gives no rows.
    """
    names = docs.columns
    lowered = [c.lower() for c in names]
    places = first_places(docs.select(docs[names[lowered.index("doc_id")]].alias("doc_id"), docs[names[lowered.index("text")]].alias("text")), batches, fanout)
    kept = places.groupBy("doc_id", "th").agg(F.collect_list("line").alias("lines"))
    left = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, doc = f"c{lowered.index('text')}", f"c{lowered.index('doc_id')}"
    joined = left.join(kept, (F.col(doc).cast("bigint").eqNullSafe(F.col("doc_id"))) & (text_key(F.col(text)) == F.col("th")), "left").select(*left.columns, "lines")
    # a document without lines to keep stays only if it had none
    stays = joined.where(F.col("lines").isNotNull() | F.col(text).isNull() | ~F.col(text).rlike(REAL))
    # a column of its own, or each line would split the text again
    split = stays.withColumn("parts", F.when(F.col("lines").isNotNull(), F.split(text, "\n")))
    out = split.withColumn(text, F.when(F.col("lines").isNotNull(), kept_text(F.col(text), F.col("parts"), F.col("lines"))).otherwise(F.col(text)))
    if "n_chars" in lowered:
        chars = f"c{lowered.index('n_chars')}"
        out = out.withColumn(chars, F.when(F.col("lines").isNotNull(), F.length(text).cast(left.schema[chars].dataType)).otherwise(F.col(chars)))
    return out.select(*left.columns).toDF(*names)


def lines_sql(table: str = "documents", columns: str = "doc_id, text") -> str:
    """DuckDB SQL for line_dedup of a table whose doc_ids are unique."""
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {table} WHERE text IS NOT NULL),
k AS (SELECT doc_id, s, i, NOT regexp_matches(s, '[^ \\t\\n\\r\\f\\v]') AS blank, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS LAST, i) = 1 AS is_first FROM l),
d AS (SELECT doc_id, coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE blank OR is_first), '') AS kept, bool_and(blank) AS blank, bool_or(is_first AND NOT blank) AS stays FROM k GROUP BY doc_id)
SELECT {columns.replace('text', 'kept AS text')} FROM d WHERE blank OR stays
"""


SQL = lines_sql()
