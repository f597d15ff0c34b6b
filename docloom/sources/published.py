"""Tables written batch by batch, each batch published once.

A batch is stored in a folder of its own below the table. A small file named
after the batch then publishes that folder: from then on it is a partition of
the table, and it is never written again. A repeated batch finds the file and
changes nothing, so a reader that follows the published batches meets every
row once, whether or not the writer had to repeat itself.

One writer per table is assumed, as one streaming query per checkpoint is.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Published batches that one micro-batch of a reader takes.
PER_TRIGGER = 64


def location(spark: SparkSession, table: str) -> str:
    details = spark.sql(f"DESCRIBE FORMATTED {table}")
    return details.filter(F.col("col_name") == "Location").first()["data_type"].rstrip("/")


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def create_published(rows: DataFrame, table: str) -> None:
    """An empty table for the columns of ``rows``, if there is none yet."""
    spark = rows.sparkSession
    if spark.catalog.tableExists(table):
        return
    empty = rows.limit(0).withColumn("batch_id", F.lit(0).cast("long"))
    empty.write.mode("ignore").partitionBy("batch_id").saveAsTable(table)
    system, marks = _files(spark, f"{location(spark, table)}/_published")
    system.mkdirs(marks)


def publish_batch(rows: DataFrame, table: str, batch_id: int) -> DataFrame:
    """Store a micro-batch under its number unless it is there, and return its rows as stored.

    A run that stops before the mark is written leaves a folder nobody reads;
    one that stops before the partition is added is finished by the repetition.
    """
    spark = rows.sparkSession
    create_published(rows, table)
    root = location(spark, table)
    system, mark = _files(spark, f"{root}/_published/{batch_id}.json")
    if not system.exists(mark):
        path = f"{root}/_batches/{batch_id}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        _, draft = _files(spark, f"{root}/_published/_{uuid.uuid4().hex}")
        out = system.create(draft)
        out.write(bytearray(json.dumps({"batch_id": batch_id, "path": path}), "utf-8"))
        out.close()
        if not system.rename(draft, mark):
            raise RuntimeError(f"batch {batch_id} of {table} is being published by another writer")
    path = spark.read.schema("batch_id long, path string").json(mark.toString()).first()["path"]
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION (batch_id = {batch_id}) LOCATION '{path}'")
    return spark.read.schema(rows.schema).parquet(path)


def stream_published(spark: SparkSession, table: str, per_trigger: int = PER_TRIGGER) -> DataFrame:
    """The published batches of a table as a stream of ``batch_id, path``; ``published_rows`` reads them."""
    marks = f"{location(spark, table)}/_published"
    return (spark.readStream.schema("batch_id long, path string").option("maxFilesPerTrigger", per_trigger)
            .json(marks))


def published_rows(listed: DataFrame, table: str) -> DataFrame:
    """The rows of listed batches. Their paths, at most ``per_trigger``, pass through the driver."""
    spark = listed.sparkSession
    schema = spark.read.table(table).drop("batch_id").schema
    paths = [r["path"] for r in listed.select("path").collect()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
