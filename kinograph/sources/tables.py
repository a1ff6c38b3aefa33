"""CSV tables and listings of folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers; columns are flat."""
    nested = [n for n, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    if nested:
        raise ValueError(f"split these columns first: {', '.join(nested)}")
    df.write.csv(path, header=True)


def scan_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None, tolerant: bool = False) -> DataFrame:
    """A CSV table with some columns cast; text that does not fit its type is an error, or, if tolerant, NULL."""
    df = spark.read.csv(path, header=True)
    cast = (lambda c, t: F.col(c).try_cast(t)) if tolerant else (lambda c, t: F.col(c).cast(t))
    return df.withColumns({c: cast(c, t) for c, t in (types or {}).items()})


def list_files(spark: SparkSession, folder: str, pattern: str = "*.mp4") -> DataFrame:
    """(path, length), sorted by path; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length").orderBy("path")
