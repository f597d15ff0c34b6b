"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stored


def _lowest(edges: DataFrame, upward: bool) -> DataFrame:
    """One star step. Upward links larger neighbours to the lowest one, downward the smaller ones and the node.

    ``edges`` has ``a`` and ``b``. Minima combine before the shuffle; the join of
    two shuffled sides lets adaptive execution split a node with very many edges.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if upward else both.filter(F.col("b") < F.col("a"))
    low = stored(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "low")
    joined = near.join(low, "a")
    if upward:
        linked = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        linked = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            low.select("a", F.col("low").alias("b")))
    return stored(linked.filter(F.col("a") != F.col("b")).distinct(), "edges")


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, for each node that is not itself the smallest.

    ``edges`` has two whole-number columns ``a`` and ``b``.
    """
    current = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    before = _print(current)
    while before[0]:
        current = _lowest(_lowest(current, upward=True), upward=False)
        after = _print(current)
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
