"""Exact dedup by skew-safe combining.

Texts are grouped by digest *and* full text, so a digest collision never merges two texts; the salt is a hash of doc_id:

1. digests are counted, salted and then globally; only rows whose digest occurs again go on with their texts;
2. salted: equal rows are counted, and each (digest, salt, text) has its least id, the winner, so a text with millions of
   copies is spread over ``salts`` reducers;
3. global: the at most ``salts`` winners of a text are combined, and the least goes back to each of its salts, where the
   other rows are. The ids of a text never meet in one row or one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinograph.llm._common import cut


def _rows(docs: DataFrame, salts: int) -> DataFrame:
    id_ = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id"))
    return docs.select(id_.alias("id"), "text").where("text IS NOT NULL").withColumns({"digest": F.xxhash64("text"), "salt": F.pmod(F.xxhash64("id.doc_id"), F.lit(salts)).cast("int")})


def _counted(rows: DataFrame) -> DataFrame:
    """(digest, salt, text, id, n, kept): each different row of texts whose digest occurs again, how often, and its text's winner."""
    salted = rows.groupBy("digest", "salt").agg(F.count("*").alias("n"))
    many = salted.groupBy("digest").agg(F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).where("n > 1").select("digest", F.explode("salts").alias("salt"))
    counted = cut(rows.join(many, ["digest", "salt"], "left_semi").groupBy("digest", "salt", "text", "id").agg(F.count("*").alias("n")))
    winners = counted.groupBy("digest", "salt", "text").agg(F.min("id").alias("least"))
    kept = winners.groupBy("digest", "text").agg(F.min("least").alias("kept"), F.collect_list("salt").alias("salts")).select("digest", "text", "kept", F.explode("salts").alias("salt"))
    return counted.join(kept, ["digest", "salt", "text"])


def exact_dedup(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row (doc_id, kept_doc_id) for every removed copy; kept is the least doc_id among equal texts.

    NULL texts are no copies of anything and are kept. Empty texts are equal to each other. Repeated rows: all but one
    are removed, with kept_doc_id = doc_id where the one kept has the same doc_id. A NULL doc_id sorts after all
    others. An empty table gives no rows; columns other than doc_id and text are not looked at.
    """
    copies = _counted(_rows(docs, salts)).withColumn("n", F.col("n") - (F.col("id") == F.col("kept")).cast("int")).where("n > 0")
    return copies.select(F.col("id.doc_id").alias("doc_id"), F.col("kept.doc_id").alias("kept_doc_id"), F.explode(F.sequence(F.lit(1), F.col("n")))).drop("col")


def drop_exact_copies(docs: DataFrame, salts: int = 16) -> DataFrame:
    """docs, with all its columns, with one row of each text: that of the least doc_id (NULL last).

    Of rows that are equal in doc_id and text, the one with the least hash of all columns stays. Rows with a NULL text all
    stay. An empty table gives no rows.
    """
    names = [c.lower() for c in docs.columns]
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    judged = _counted(_rows(own.select(doc.alias("doc_id"), text.alias("text")), salts)).select("digest", "salt", F.col("text").alias("t"), "id", "n", (F.col("id") == F.col("kept")).alias("stays"))
    keys = {"digest": F.xxhash64(text), "salt": F.pmod(F.xxhash64(doc), F.lit(salts)).cast("int"), "id": F.struct(doc.isNull().alias("absent"), doc.alias("doc_id"))}
    rows = own.select("*", *[v.alias(k) for k, v in keys.items()]).alias("r")
    on = (F.col("r.digest") == F.col("j.digest")) & (F.col("r.salt") == F.col("j.salt")) & (F.col("r.id") == F.col("j.id")) & (text == F.col("t"))
    found = rows.join(judged.alias("j"), on, "left").where("stays IS NULL OR stays").select(*own.columns, "n")
    # NULLs of n are rows that are alone in doc_id and text
    place = F.row_number().over(Window.partitionBy(doc, F.xxhash64(text), text).orderBy(F.xxhash64(*own.columns)))
    once = found.where("n > 1").withColumn("place", place).where("place = 1").select(*own.columns)
    return found.where("n IS NULL OR n = 1").select(*own.columns).unionByName(once).toDF(*docs.columns)


SQL = """
SELECT doc_id, kept_doc_id FROM (
  SELECT doc_id, first_value(doc_id) OVER w AS kept_doc_id, row_number() OVER w AS r
  FROM documents WHERE text IS NOT NULL
  WINDOW w AS (PARTITION BY text ORDER BY doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
WHERE r > 1
"""
