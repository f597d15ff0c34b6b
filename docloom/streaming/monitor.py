"""Quality of answers in production per time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monitor(df: DataFrame, window: str, watermark: str | None = None, min_correct_percent: float = 80.0,
            time: str = "event_ts", by: str = "experiment") -> DataFrame:
    """Rows, errors, share of correct answers and average latency per tumbling window, with an alert flag.

    A stream needs ``watermark``: windows close, and later rows are dropped, once
    it has passed them.
    """
    source = df.withWatermark(time, watermark) if watermark else df
    good = F.col("correctness") == "yes"
    return (
        source.groupBy(F.window(time, window), by).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(~good).alias("n_errors"),
            F.round(F.avg(F.when(good, 100.0).otherwise(0.0)), 4).alias("correct_percent"),
            F.round(F.avg("latency_seconds"), 9).alias("avg_latency"))
        .withColumn("alert", F.col("correct_percent") < min_correct_percent)
    )
