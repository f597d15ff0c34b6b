"""File sources: recursive binary scans, batch and streaming."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BINARY_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

EVAL_ROW = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("request", T.StringType(), False),
    T.StructField("response", T.StringType()),
    T.StructField("expected_response", T.StringType()),
    T.StructField("expected_retrieved_context", T.ArrayType(T.StructType([
        T.StructField("doc_uri", T.StringType()),
        T.StructField("content", T.StringType()),
    ]))),
])


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def load_files(spark: SparkSession, path: str, file_format: str | None = None) -> DataFrame:
    """All files below ``path`` as ``path, modificationTime, length, content``.

    Raises when the folder is missing or holds no matching file.
    """
    if not _path_exists(spark, path):
        raise FileNotFoundError(f"{path} does not exist")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if file_format:
        reader = reader.option("pathGlobFilter", f"*.{file_format.lstrip('.')}")
    files = reader.load(path)
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"{path} holds no {file_format or ''} files")
    return files


def stream_files(spark: SparkSession, path: str, file_format: str | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """The same rows as a stream; each file is delivered once per checkpoint."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True)
    if file_format:
        reader = reader.option("pathGlobFilter", f"*.{file_format.lstrip('.')}")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def eval_rows(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """Hand-written evaluation rows; only ``request`` is required."""
    names = EVAL_ROW.fieldNames()
    known = set(names)
    data = []
    for row in rows:
        unknown = set(row) - known
        if unknown:
            raise ValueError(f"unknown evaluation columns: {sorted(unknown)}")
        if not row.get("request"):
            raise ValueError("an evaluation row needs a request")
        data.append(tuple(row.get(n) for n in names))
    return spark.createDataFrame(data, EVAL_ROW)
