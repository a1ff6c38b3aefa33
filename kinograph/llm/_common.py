"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters outside this set.
SPACES = " \t\n\r\f\v"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a new one where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    # else checkpoints' files stay for ever
    context.conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    current = context.getCheckpointDir()
    if current.isDefined():
        return folder or current.get()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="kinograph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder; Spark removes the files when nothing refers to them any more."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, base: str) -> str:
    """base, or base with underscores before it, so that no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def text_key(text: Column) -> Column:
    """Tells apart rows that share a doc_id; rows equal in doc_id and text are one document."""
    return F.xxhash64(F.lit(7), text)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
