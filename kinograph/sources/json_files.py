"""JSON files of features (an object of parallel lists) and of annotations (an object with segments)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

_VIDEO_LISTS = {
    "frame": "array<bigint>", "time": "array<double>", "face_box": "array<array<double>>", "face_prob": "array<double>",
    "face_landmarks": "array<array<array<double>>>", "face_aus": "array<array<double>>", "face_label": "array<string>", "face_confidence": "array<double>",
}
PAYLOADS = {
    "segments": "struct<name: string, conf: double>",
    "transcription": "struct<index: int, text: string, speaker: string, confidence: double>",
    "sentiment": "struct<text: string, pos: double, neg: double, neu: double>",
}

#: Segments of an object, and objects of a file: files are read as wholes, so neither may grow with the recording.
PART, OBJECTS = 16384, 8

#: Fields that a payload has to have.
REQUIRED = {"segments": ("name",), "transcription": ("index", "text"), "sentiment": ("text",)}  # scores are NULL where a model failed
#: Fields that are probabilities.
PROBABILITIES = {"segments": ("conf",), "transcription": ("confidence",), "sentiment": ("pos", "neg", "neu")}


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the objects of the files of path, on one line each or over several; an object may end where the next line begins one."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.explode(F.split("value", r"(?<=\})\s*\n\s*(?=\{)")).alias("value")).where(F.trim("value") != "")


def _objects(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return _contents(spark, path).select("file", F.from_json("value", schema).alias("object")).select("file", "object.*")


def _named(df: DataFrame, filename: str | None, by_file: bool = True) -> DataFrame:
    """With filename in place of the one in the file, or, where that is missing, the file's own name, or NULL unless by_file."""
    own = F.lit(filename) if filename is not None else F.coalesce("filename", "file") if by_file else F.col("filename")
    return df.withColumn("filename", own).drop("file")


def _check_lengths(df: DataFrame, lists: list[str]) -> DataFrame:
    """df, failing where a list that is not empty is not as long as frame."""
    ok = F.lit(True)
    for c in lists:
        ok = ok & (F.coalesce(F.size(c), F.lit(0)).isin(0, -1) | (F.size(c) == F.size("frame")))
    return df.withColumn("frame", F.when(ok, F.col("frame")).otherwise(F.raise_error(F.lit("lists of different lengths"))))


def _zip(df: DataFrame, lists: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    whole = _check_lengths(df, lists).withColumns({c: F.coalesce(c, F.array().cast(kinds[c])) for c in lists})  # a list may be missing
    rows = whole.select("filename", F.explode(F.arrays_zip(*lists)).alias("row"))
    return rows.select("filename", *[F.col(f"row.{c}").alias(c) for c in lists])


def read_video(spark: SparkSession, path: str, filename: str | None = None) -> DataFrame:
    """Video annotations, a row for each place of the lists; numeric labels become their integral part as text."""
    schema = StructType.fromDDL("filename string, " + ", ".join(f"{k} {v}" for k, v in _VIDEO_LISTS.items()))
    rows = _zip(_named(_objects(spark, path, schema), filename), list(_VIDEO_LISTS))
    label = F.col("face_label")
    number = F.when(label.rlike(r"^-?\d+(\.\d*)?([eE][+-]?\d+)?$"), label.try_cast("double").cast("bigint").cast("string"))
    return rows.withColumn("face_label", F.coalesce(number, F.when(label != "NaN", label)))


def read_video_embeddings(spark: SparkSession, path: str, filename: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The two side tables: embeddings of each place, average embeddings of each label."""
    schema = "filename string, face_embeddings array<array<double>>, face_average_embeddings map<string, array<double>>"
    df = _named(_objects(spark, path, schema), filename)
    each = df.select("filename", F.posexplode("face_embeddings").alias("pos", "embedding")).withColumn("pos", F.col("pos").cast("bigint"))
    return each, df.select("filename", F.explode("face_average_embeddings").alias("face_label", "embedding"))


def read_voice(spark: SparkSession, path: str, filename: str | None = None) -> DataFrame:
    """Voice features; every list in the files becomes a column, NaN NULL. Column names come from a pass over the files."""
    values = _contents(spark, path)
    keys = sorted(r[0] for r in values.select(F.explode(F.json_object_keys("value"))).distinct().collect())
    is_list = [F.max(F.get_json_object("value", f"$['{k}']").startswith("[").cast("int")).alias(f"k{i}") for i, k in enumerate(keys)]
    lists = [k for k, has in zip(keys, values.agg(*is_list).first()) if has] if keys else []
    lists += [c for c in ("frame", "time") if c not in lists]
    schema = StructType([StructField("filename", StringType()), *[StructField(c, ArrayType(LongType() if c == "frame" else DoubleType())) for c in lists]])
    df = _named(_objects(spark, path, schema), filename)
    rest = [c for c in lists if c not in ("frame", "time")]
    rows = _zip(df, ["frame", "time", *rest])
    number = lambda c: F.col(c).cast("double")
    return rows.select("filename", F.col("frame").cast("bigint").alias("frame"), number("time").alias("time"), *[F.when(~F.isnan(number(c)), number(c)).alias(c) for c in rest])


def read_annotation(spark: SparkSession, path: str, kind: str, filename: str | None = None, payload: str | None = None, strict: bool = True, ranges: bool = True, by_file: bool = True) -> DataFrame:
    """(filename, begin, end, fields of the payload), and channel for segments; kind is a key of PAYLOADS unless payload is given.

    strict: a payload of one of PAYLOADS that lacks a required field, or has one of a wrong type or, unless ranges is False, a
    probability that is not within 0 to 1, is an error when the row is read. by_file: an object without filename has the name
    of its file, else NULL.
    """
    own, payload = payload is None, payload or PAYLOADS[kind]
    schema = f"filename string, channel int, segments array<struct<begin: double, end: double, data: {payload}>>"
    df = _named(_objects(spark, path, schema), filename, by_file)
    rows = df.select("filename", "channel", F.inline("segments")).select("filename", "channel", "begin", "end", "data.*")
    if strict and own:
        ok = F.col("begin").isNotNull() & F.col("end").isNotNull()
        for c in REQUIRED[kind]:
            ok = ok & F.col(c).isNotNull()
        for c in PROBABILITIES[kind] if ranges else ():
            ok = ok & F.coalesce(F.col(c).between(0, 1), F.lit(True))
        rows = rows.withColumn("begin", F.when(ok, F.col("begin")).otherwise(F.raise_error(F.concat(F.lit(f"a payload of {kind} is not valid in "), F.coalesce("filename", F.lit("?"))))))
    return rows if kind == "segments" else rows.drop("channel")


def feature_objects(table: DataFrame, order: list[str]) -> DataFrame:
    """(filename, value): one JSON object of lists for each recording, rows in the given order."""
    names = [c for c in table.columns if c != "filename"]
    rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), F.struct(*names).alias("row"))))
    packed = table.groupBy("filename").agg(F.transform(rows, lambda x: x["row"]).alias("r"))
    return packed.select("filename", F.to_json(F.struct("filename", *map(_pick, names)), {"ignoreNullFields": "false"}).alias("value"))


def _pick(name: str):
    return F.transform("r", lambda row: row[name]).alias(name)


def annotation_objects(table: DataFrame, header: list[str] | None = None) -> DataFrame:
    """(filename, value): one JSON object with segments, in the order of begin and end, for each recording.

    A recording of more than PART segments has several objects, one after the other in time, each with filename and header.
    """
    header = header or []
    data = [c for c in table.columns if c not in ("filename", "begin", "end", *header)]
    item = F.struct("begin", "end", F.struct(*data).alias("data"))
    rows = table.select("filename", *header, item.alias("item"))
    whole = Window.partitionBy("filename").orderBy("item")
    place = F.floor((F.row_number().over(whole) - 1) / PART).alias("part")
    heads = [F.first(c, ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(c) for c in header]
    # parts are gathered apart, so no task holds more than some of them
    parts = rows.select("filename", place, *heads, "item").repartition("filename", "part")
    packed = parts.groupBy("filename", "part").agg(*[F.first(c, ignorenulls=True).alias(c) for c in header], F.array_sort(F.collect_list("item")).alias("segments"))
    return packed.select("filename", F.to_json(F.struct("filename", *header, "segments"), {"ignoreNullFields": "false"}).alias("value"))


def write_objects(objects: DataFrame, path: str, compression: str | None = None) -> None:
    """A folder of text files, one object on each line, OBJECTS a file at most; compression is one of Spark's for text."""
    objects.select("value").write.option("maxRecordsPerFile", OBJECTS).text(path, compression=compression)


def read_merged(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A merged table written as JSON lines or, better, as Parquet, which keeps types."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.json(path, schema=schema)


def write_merged(merged: DataFrame, path: str) -> None:
    if path.rstrip("/").endswith(".parquet"):
        merged.write.partitionBy("filename").parquet(path)
    else:
        merged.write.option("ignoreNullFields", False).json(path)
