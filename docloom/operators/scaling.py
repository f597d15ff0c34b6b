"""Plan pieces shared by the operators: stored tables, skew-safe joins,
running sums and exact percentiles that hold when one key owns most rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def left_join_skewed(left: DataFrame, right: DataFrame, on: str | Sequence[str],
                     right_keys: DataFrame | None = None) -> DataFrame:
    """Left join whose right side may hold most of its rows under one key.

    A left outer join cannot split a skewed right partition. An inner join can
    be split on both sides, and the unmatched left rows come from an anti join
    against the keys alone: ``right_keys`` where the caller has them for less.
    """
    keys = [on] if isinstance(on, str) else list(on)
    matched = left.join(right, keys, "inner")
    present = right.select(*keys).distinct() if right_keys is None else right_keys.select(*keys)
    return matched.unionByName(left.join(present, keys, "left_anti"), allowMissingColumns=True)


def running_total(df: DataFrame, key: str, position: str, value: str, name: str,
                  descending: bool = False, page: int = 4096) -> DataFrame:
    """Running sum of ``value`` per ``key`` in ``position`` order (a unique integer per key).

    Rows are summed in pages of consecutive positions first, so no task sorts
    more than a page of one key plus one row per page.
    """
    order = F.col(position).desc() if descending else F.col(position).asc()
    paged = df.withColumn("_page", F.floor(F.col(position) / page))
    page_order = F.col("_page").desc() if descending else F.col("_page").asc()
    before = Window.partitionBy(key).orderBy(page_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        paged.groupBy(key, "_page").agg(F.sum(value).alias("_sum"))
        .select(key, "_page", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy(key, "_page").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        paged.withColumn("_within", F.sum(value).over(within))
        .join(offsets, [key, "_page"])
        .withColumn(name, F.col("_offset") + F.col("_within"))
        .drop("_page", "_within", "_offset")
    )


def _value_bucket(value: Column) -> Column:
    """A whole number that never falls as ``value`` rises: some 64 per factor of e, at most about 190,000."""
    size = F.floor(F.least(F.ln(F.abs(value)) * 64, F.lit(1e5))) + 48_000
    return F.when(value > 0, size).when(value < 0, -size).otherwise(0).cast("long")


def exact_percentiles(df: DataFrame, key: str, value: str, fractions: Sequence[float]) -> DataFrame:
    """Exact percentiles (linear interpolation) per key: ``key, fraction, result``.

    Equal values are counted before anything is shuffled. Counts per bucket of
    close values then tell which buckets hold the wanted ranks, and only those
    buckets are ordered.
    """
    usable = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    counts = (df.filter(usable).groupBy(key, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_b", _value_bucket(F.col("_v"))))
    of_key = Window.partitionBy(key)
    upto = of_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        counts.groupBy(key, "_b").agg(F.sum("_n").alias("_bn"))
        .withColumn("_end", F.sum("_bn").over(upto)).withColumn("_total", F.sum("_bn").over(of_key))
        .withColumn("_start", F.col("_end") - F.col("_bn")))
    # The two neighbouring ranks of each fraction, each with the bucket that holds it.
    def targets(p: float) -> list[Column]:
        rank = F.lit(float(p)) * (F.col("_total") - 1)
        return [F.struct(F.lit(float(p)).alias("fraction"), rank.alias("rank"), at.alias("at"))
                for at in (F.floor(rank), F.ceil(rank))]

    ranks = F.array(*[t for p in fractions for t in targets(p)])
    wanted = spans.select(key, "_b", "_start", F.array_distinct(F.filter(
        ranks, lambda t: (t["at"] >= F.col("_start")) & (t["at"] < F.col("_end")))).alias("_wanted"))
    inside = Window.partitionBy(key, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    located = (
        counts.join(wanted.filter(F.size("_wanted") > 0), [key, "_b"])
        .withColumn("_upto", F.col("_start") + F.sum("_n").over(inside))
        .select(key, "_v", F.explode(F.filter("_wanted", lambda t: (t["at"] < F.col("_upto")) & (
            t["at"] >= F.col("_upto") - F.col("_n")))).alias("_t")))
    return (
        located.groupBy(key, "_t.fraction", "_t.rank").agg(F.min("_v").alias("_l"), F.max("_v").alias("_h"))
        .select(key, "fraction", (F.col("_l") + (F.col("_h") - F.col("_l")) * (F.col("rank") - F.floor("rank"))).alias("result"))
    )


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """A table as read, over at least as many partitions as there are cores, for costly work per row.

    A small or unsplittable file is read by one task. An input that already has
    enough partitions, as any large one does, is left as it is and not shuffled.
    """
    wanted = partitions or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the one that ``spark.checkpoint.dir`` names; only a local session may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/docloom-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: no lineage, and its size is known to the planner."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_files(df: DataFrame) -> tuple:
    """Path, size and time of the files that ``df`` reads, without a job."""
    spark = df.sparkSession
    found = []
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append((name, status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))
