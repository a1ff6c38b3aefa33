"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinograph.llm._common import new_path, remove_path
from kinograph.llm.language_id import keep_identified
from kinograph.llm.line_dedup import line_dedup
from kinograph.llm.packing import best_fit_packing
from kinograph.llm.simhash_dedup import simhash_dedup
from kinograph.llm.suffix_dedup import suffix_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Only the last one's rows have other columns than documents.
STAGES: list[tuple[str, Stage]] = [
    ("language_id", lambda spark, docs, sf_dir: keep_identified(docs)),
    ("line_dedup", lambda spark, docs, sf_dir: line_dedup(docs)),
    ("simhash_near_dedup", lambda spark, docs, sf_dir: simhash_dedup(docs)),
    ("suffix_array_dedup", lambda spark, docs, sf_dir: suffix_dedup(docs)),
    ("best_fit_packing", lambda spark, docs, sf_dir: best_fit_packing(docs)),
]

#: Language ID and SimHash have no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents; between stages, rows go through Parquet in the folder that all executors share.

    Each file set is removed when the next stage is done. The last stage has read its documents when it returns, since it
    cuts its lineage behind them, so nothing stays but checkpoints, which Spark removes.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_path(spark, before)
        docs, before = spark.read.parquet(path), path
    out = STAGES[-1][1](spark, docs, sf_dir)
    if before:
        remove_path(spark, before)
    return out
