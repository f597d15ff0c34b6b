"""Keeping the index in step with the chunks, merged when it is read.

A stored index is a view over two tables: the base, bucketed by chunk id, and
the delta, one published batch of upserts and tombstones per sync. A sync
writes what has changed and nothing else; reading takes the newest delta row
of a chunk before its base row. Once the delta has grown to a share of the
base, both are written anew as one base. ``origin`` tells the sync that a row
comes from, 0 being the first build.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.encoding import Encoder, HashingEncoder, embed
from docloom.operators.scaling import stored
from docloom.sources.published import create_published, location, publish_batch
from docloom.sources.tables import index_versions

# Bytes of text that one bucket of a base holds about, and the share of the base at which a delta is merged into it.
BUCKET_BYTES = 128 << 20
COMPACT_SHARE = 0.1

_MERGED = """
SELECT {columns} FROM {base} LEFT ANTI JOIN (SELECT chunk_id AS changed FROM {delta}) ON chunk_id = changed
UNION ALL
SELECT {newest} FROM (SELECT max_by(struct({columns}, deleted), origin) AS row FROM {delta} GROUP BY chunk_id) WHERE NOT row.deleted
"""


def _merge_sql(columns: list[str]) -> str:
    quoted = [f"`{c}`" for c in columns]
    return _MERGED.replace("{columns}", ", ".join(quoted)).replace("{newest}", ", ".join(f"row.{c} AS {c}" for c in quoted))


def index_changes(old: DataFrame, new: DataFrame, text: str = "chunked_text") -> DataFrame:
    """``chunk_id, change`` between two chunk snapshots: insert, update, delete or same.

    Chunk ids are unique on both sides; texts are compared by digest, so the
    texts themselves are not shuffled.
    """
    before = old.select("chunk_id", F.lit(True).alias("_was"), F.md5(text).alias("_old"))
    after = new.select("chunk_id", F.lit(True).alias("_is"), F.md5(text).alias("_new"))
    change = (
        F.when(F.col("_was").isNull(), "insert").when(F.col("_is").isNull(), "delete")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "update").otherwise("same"))
    return before.join(after, "chunk_id", "full_outer").select("chunk_id", change.alias("change"))


def delta_rows(changes: DataFrame, chunks: DataFrame, origin: int, text: str = "chunked_text",
               factory: Callable[[], Encoder] | None = None) -> DataFrame:
    """Upserts and tombstones of a sync: the columns of ``chunks``, ``origin`` and ``deleted``.

    With a ``factory``, inserted and updated texts are encoded; the others are not looked at.
    """
    fresh = chunks.join(changes.filter(F.col("change").isin("insert", "update")), "chunk_id", "left_semi")
    upserts = embed(fresh, text, "embedding", factory) if factory else fresh
    gone = changes.filter(F.col("change") == "delete").select("chunk_id", F.lit(True).alias("deleted"))
    return upserts.withColumn("deleted", F.lit(False)).unionByName(gone, allowMissingColumns=True).withColumn(
        "origin", F.lit(origin).cast("long"))


def merged(base: DataFrame, delta: DataFrame) -> DataFrame:
    """The rows a reader sees: the newest delta row of a chunk, or else its base row."""
    return base.sparkSession.sql(_merge_sql(base.columns), base=base, delta=delta)


def apply_changes(index: DataFrame, chunks: DataFrame, origin: int = 1, text: str = "chunked_text",
                  factory: Callable[[], Encoder] | None = None) -> DataFrame:
    """The index after a sync: unchanged rows as they are, ``origin`` included, changed ones from ``chunks``.

    ``index`` has the columns of ``chunks``, ``origin``, and with a ``factory`` also ``embedding`` and ``embedding_status``.
    """
    return merged(index, delta_rows(index_changes(index, chunks, text), chunks, origin, text, factory))


def _buckets(rows: DataFrame, text: str, bucket_bytes: int) -> int:
    size = rows.select(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(1, -(-size // bucket_bytes))


def _start(index_table: str, rows: DataFrame, version: int, text: str, bucket_bytes: int) -> None:
    """A new base out of ``rows`` with an empty delta; the view turns to them once both are stored."""
    spark = rows.sparkSession
    base, delta = f"{index_table}_base_v{version}", f"{index_table}_delta_v{version}"
    n = _buckets(rows, text, bucket_bytes)
    rows.repartition(n, "chunk_id").write.mode("overwrite").bucketBy(n, "chunk_id").saveAsTable(base)
    create_published(spark.read.table(base).withColumn("deleted", F.lit(False)), delta)
    spark.sql(f"CREATE OR REPLACE VIEW {index_table} AS " + _merge_sql(rows.columns).format(base=base, delta=delta))


def _stored_bytes(spark: SparkSession, table: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(location(spark, table))
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def compact_index(spark: SparkSession, index_table: str, text: str = "chunked_text", bucket_bytes: int = BUCKET_BYTES) -> None:
    """Merge base and delta into a new base.

    The tables replaced stay until the next compaction, for readers that have begun.
    """
    versions = index_versions(spark, index_table, "base")
    _start(index_table, spark.read.table(index_table), versions[-1] + 1, text, bucket_bytes)
    for old in versions[:-1]:
        for kind in ("base", "delta"):
            spark.sql(f"DROP TABLE IF EXISTS {index_table}_{kind}_v{old}")


def sync_index(index_table: str, chunks: DataFrame, text: str = "chunked_text",
               factory: Callable[[], Encoder] = HashingEncoder, compact_share: float = COMPACT_SHARE,
               bucket_bytes: int = BUCKET_BYTES) -> dict[str, int]:
    """Bring a stored index up to date with ``chunks (chunk_id, text, ...)``; returns the number of rows per change.

    Only inserted and updated chunks are encoded, and only changed rows are
    written. Ids are unique in ``chunks`` and none is null. One sync runs at a time.
    """
    spark = chunks.sparkSession
    counts = {"insert": 0, "update": 0, "delete": 0, "same": 0}
    if not spark.catalog.tableExists(index_table):
        built = stored(embed(chunks, text, "embedding", factory).withColumn("origin", F.lit(0).cast("long")), "index")
        _start(index_table, built, 0, text, bucket_bytes)
        return counts | {"insert": built.count()}
    version = index_versions(spark, index_table, "base")[-1]
    base, delta = f"{index_table}_base_v{version}", f"{index_table}_delta_v{version}"
    changes = stored(index_changes(spark.read.table(index_table), chunks, text), "changes")
    counts.update({r["change"]: r["count"] for r in changes.groupBy("change").count().collect()})
    if counts["same"] == sum(counts.values()):
        return counts
    newest = [spark.read.table(t).agg(F.max("origin")).first()[0] or 0 for t in (base, delta)]
    origin = max(newest) + 1
    publish_batch(delta_rows(changes, chunks, origin, text, factory).select(*spark.read.table(delta).drop("batch_id").columns), delta, origin)
    if _stored_bytes(spark, delta) > compact_share * _stored_bytes(spark, base):
        compact_index(spark, index_table, text, bucket_bytes)
    return counts


def index_coverage(docs: DataFrame, indexed: DataFrame, key: str, by: str) -> DataFrame:
    """Per group: documents, and those without any chunk in the index."""
    covered = indexed.select(key).distinct().withColumn("_covered", F.lit(1))
    joined = docs.select(key, by).join(covered, key, "left")
    return joined.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("_covered").isNull()).alias("n_missing"))
