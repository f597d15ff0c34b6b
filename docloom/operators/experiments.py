"""Which experiment wins. Inputs have one row per experiment and metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASELINE = "poc"

# The metrics compared and whether more is better.
METRICS = {"correct_percentage": True, "avg_token_count": False, "avg_latency_seconds": False}


def long_metrics(summary: DataFrame, by: str = "experiment", metrics: dict[str, bool] | None = None) -> DataFrame:
    """``experiment, metric, value, higher_is_better`` out of a summary row per experiment."""
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(up).alias("higher_is_better"))
        for m, up in (metrics or METRICS).items()])
    return summary.select(F.col(by).alias("experiment"), F.explode(rows).alias("m")).select("experiment", "m.*")


def metric_winners(metrics: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """``metric, winner, best_value``: the baseline wins ties, then the lower name."""
    signed: Column = F.when(F.col("higher_is_better"), -F.col("value")).otherwise(F.col("value"))
    order = F.struct(signed.alias("s"), (F.col("experiment") != baseline).alias("b"), F.col("experiment"))
    return metrics.filter(F.col("value").isNotNull()).groupBy("metric").agg(
        F.min_by(F.struct("experiment", "value"), order).alias("_best"),
    ).select("metric", F.col("_best.experiment").alias("winner"), F.col("_best.value").alias("best_value"))


def overall_winner(metrics: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """The experiment with the most metric wins; the baseline wins ties, then the lower name."""
    wins = metric_winners(metrics, baseline).groupBy(F.col("winner").alias("experiment")).agg(F.count(F.lit(1)).alias("wins"))
    counted = metrics.select("experiment").distinct().join(wins, "experiment", "left").select(
        "experiment", F.coalesce("wins", F.lit(0).cast("long")).alias("wins"))
    order = F.struct((-F.col("wins")).alias("w"), (F.col("experiment") != baseline).alias("b"), F.col("experiment"))
    return counted.agg(F.min_by(F.struct("experiment", "wins"), order).alias("_best")).select(
        F.col("_best.experiment").alias("winner"), F.col("_best.wins").alias("wins"))


def relative_change(metrics: DataFrame, names: list[str], baseline: str = BASELINE) -> DataFrame:
    """(value - baseline) / baseline of each metric and experiment, in percent as well."""
    wanted = metrics.filter(F.col("metric").isin(names)).select("experiment", "metric", "value")
    base = wanted.filter(F.col("experiment") == baseline).select("metric", F.col("value").alias("baseline_value"))
    change = F.try_divide(F.col("value") - F.col("baseline_value"), F.col("baseline_value"))
    return wanted.filter(F.col("experiment") != baseline).join(base, "metric").select(
        "experiment", "metric", F.round(change, 6).alias("change"), F.round(change * 100, 2).alias("change_percent"))
