"""Session settings and time helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "kinograph", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def seconds_since(ts: Column, origin: str) -> Column:
    """Seconds as double from origin ("2024-01-01 00:00:00", UTC) to a timestamp with or without zone; the session is in UTC."""
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    return (micros(ts) - micros(F.lit(origin))) / F.lit(1e6)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, in local mode where that is unset, a new one that goes at exit."""
    context = spark.sparkContext._jsc.sc()
    context.conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    folder = spark.conf.get("spark.checkpoint.dir", None)
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


def there_and_back(spark: SparkSession, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    """What read makes of the files of write, which are removed again: the rows are kept as a checkpoint."""
    path = f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        write(path)
        return read(path).checkpoint()
    finally:
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
