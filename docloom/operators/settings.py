"""Strategy settings as rows ``strategy, key_path, val``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settings_rows(df: DataFrame, strategy: str, values: dict[str, Column]) -> DataFrame:
    """One row per strategy and key path out of one row per strategy."""
    rows = F.array(*[F.struct(F.lit(k).alias("key_path"), v.cast("string").alias("val")) for k, v in values.items()])
    return df.select(F.col(strategy).alias("strategy"), F.explode(rows).alias("s")).select("strategy", "s.*")


def merge_settings(base: DataFrame, override: DataFrame) -> DataFrame:
    """Base settings with overrides, leaf by leaf; an override may add keys."""
    b = base.select("strategy", "key_path", F.col("val").alias("_base"))
    o = override.select("strategy", "key_path", F.col("val").alias("_over"))
    return b.join(o, ["strategy", "key_path"], "full_outer").select(
        "strategy", "key_path", F.coalesce("_over", "_base").alias("val"))


def diff_settings(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys whose values differ or stand on one side only."""
    a = left.select("strategy", "key_path", F.col("val").alias("left_val"))
    b = right.select("strategy", "key_path", F.col("val").alias("right_val"))
    joined = a.join(b, ["strategy", "key_path"], "full_outer")
    return joined.filter(~F.col("left_val").eqNullSafe(F.col("right_val")))


def strategy_grid(df: DataFrame, kind: str, chunkers: list[str], encoders: list[str]) -> DataFrame:
    """Every combination of a row's kind with the chunkers and encoders, under a composed name.

    The lists are settings, so they are exploded next to each row rather than joined.
    """
    def each(names: list[str]) -> Column:
        return F.explode(F.array(*[F.lit(n) for n in names]))

    return (
        df.withColumn("chunker", each(chunkers)).withColumn("encoder", each(encoders))
        .withColumn("strategy", F.concat_ws("__", kind, "chunker", "encoder")))
