"""Table sources and sinks, their tags, lineage and reset."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class Layout:
    """Table names and checkpoint folders of one document run."""

    schema: str
    checkpoint_root: str
    prefix: str = "docs"

    def table(self, stage: str) -> str:
        return f"{self.schema}.{self.prefix}_{stage}"

    @property
    def raw(self) -> str:
        return self.table("bronze_raw")

    @property
    def parsed(self) -> str:
        return self.table("silver_parsed")

    @property
    def chunked(self) -> str:
        return self.table("gold_chunked")

    @property
    def staging(self) -> str:
        return f"{self.parsed}_all"

    def quarantine(self, table: str) -> str:
        return f"{table}_quarantine"

    def checkpoint(self, table: str) -> str:
        return f"{self.checkpoint_root}/{table}"

    def tables(self) -> list[str]:
        main = [self.raw, self.parsed, self.chunked]
        return main + [self.staging, self.table("index"), self.table("index_stream"), self.quarantine(self.parsed), self.quarantine(self.chunked)]


def layout_for(strategy: str, schema: str, checkpoint_root: str) -> Layout:
    """Names derived from a strategy; characters a table name cannot hold become ``_``."""
    safe = "".join(ch if ch.isalnum() else "_" for ch in strategy.lower())
    return Layout(schema, checkpoint_root, safe)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.table(name)


def stream_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.readStream.table(name)


def write_table(df: DataFrame, name: str, partition_by: list[str] | None = None,
                fmt: str = "parquet") -> None:
    """Replace the table, schema included."""
    writer = df.write.format(fmt).mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def append_table(df: DataFrame, name: str, checkpoint: str, continuous: str | None = None,
                 fmt: str = "parquet") -> StreamingQuery:
    """Append a stream to a table: everything available now, or every ``continuous`` interval."""
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).toTable(name)


def delete_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def index_versions(spark: SparkSession, index_table: str, kind: str) -> list[int]:
    """Numbers of the ``base`` or ``delta`` tables behind an index view, oldest first."""
    schema, _, name = index_table.lower().rpartition(".")
    shown = spark.sql(f"SHOW TABLES IN {schema}" if schema else "SHOW TABLES").select("tableName").collect()
    found = (re.fullmatch(rf"{re.escape(name)}_{kind}_v(\d+)", r["tableName"].lower()) for r in shown)
    return sorted(int(m.group(1)) for m in found if m)


def drop_index(spark: SparkSession, index_table: str) -> None:
    """Drop an index view and the tables behind it."""
    spark.sql(f"DROP VIEW IF EXISTS {index_table}")
    for kind in ("base", "delta"):
        for version in index_versions(spark, index_table, kind):
            spark.sql(f"DROP TABLE IF EXISTS {index_table}_{kind}_v{version}")


def reset(spark: SparkSession, layout: Layout) -> None:
    """Drop the run's tables and checkpoints, so that every file is read again."""
    drop_index(spark, layout.table("index"))
    for table in layout.tables():
        if table != layout.table("index"):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete_folder(spark, layout.checkpoint(table))


def flatten(config: dict, separator: str = "/", _path: str = "") -> dict[str, object]:
    """Nested settings as ``{key path: leaf}``."""
    out: dict[str, object] = {}
    for key, value in config.items():
        path = f"{_path}{separator}{key}" if _path else str(key)
        if isinstance(value, dict) and value:
            out.update(flatten(value, separator, path))
        else:
            out[path] = value
    return out


def tag_table(spark: SparkSession, table: str, config: dict) -> dict[str, str]:
    """Store the flattened config as table properties, key paths joined by ``__``."""
    tags = {k: str(v) for k, v in flatten(config, "__").items()}
    if tags:
        def quoted(s: str) -> str:
            return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

        pairs = ", ".join(f"{quoted(k)} = {quoted(v)}" for k, v in tags.items())
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({pairs})")
    return tags


def log_lineage(spark: SparkSession, table: str, run: str, stage: str, produced: str,
                rows: int, config: dict | None = None) -> None:
    """Append one row about a produced table."""
    entry = spark.range(1).select(
        F.lit(run).alias("run"),
        F.lit(stage).alias("stage"),
        F.lit(produced).alias("produced"),
        F.lit(rows).cast("long").alias("rows"),
        F.create_map(*[F.lit(str(x)) for kv in flatten(config or {}).items() for x in kv])
        .cast("map<string,string>").alias("config"),
        F.current_timestamp().alias("logged_at"),
    )
    entry.write.mode("append").saveAsTable(table)
