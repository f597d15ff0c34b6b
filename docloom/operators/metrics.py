"""Retrieval and answer metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators.scaling import exact_percentiles


def precision(queries: DataFrame, hits: DataFrame, key: str = "query_id", relevant: str = "relevant") -> DataFrame:
    """Share of the retrieved chunks that are relevant, for every query; 0 for one without hits."""
    counted = hits.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(relevant)).alias("_relevant"))
    zero = F.lit(0).cast("long")
    return queries.select(key).join(counted, key, "left").select(
        key, F.coalesce("_n", zero).alias("n_retrieved"), F.coalesce("_relevant", zero).alias("n_relevant"),
        F.round(F.coalesce(F.col("_relevant") / F.col("_n"), F.lit(0.0)), 6).alias("precision"))


def document_recall(queries: DataFrame, hits: DataFrame, truth: DataFrame, on: list[str], uri: str,
                    key: str = "query_id") -> DataFrame:
    """Share of the ground-truth documents that were retrieved.

    ``truth`` names the documents of each ``on`` value (a topic, or the query
    itself); it is counted, not paired with the queries. Queries without any
    ground truth are left out.
    """
    columns = [key, *[c for c in on if c != key]]
    documents = truth.select(*on, uri).distinct()
    sizes = documents.groupBy(*on).agg(F.count(F.lit(1)).alias("n_truth"))
    found = (hits.select(*columns, uri).distinct()
             .join(documents, [*on, uri], "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n_found")))
    return queries.select(*columns).join(sizes, on).join(found, key, "left").select(
        key, F.coalesce("n_found", F.lit(0).cast("long")).alias("n_found"), "n_truth",
    ).withColumn("recall", F.round(F.col("n_found") / F.col("n_truth"), 6))


def rank_metrics(hits: DataFrame, totals: DataFrame, ks: Sequence[int], key: str = "query_id") -> DataFrame:
    """``key, k, precision_at_k, recall_at_k`` for every query of ``totals`` (``key``, ``n_truth`` relevant items) and every k.

    A query without hits has 0; recall is null where nothing is relevant.
    """
    counted = hits.groupBy(key).agg(*(F.count_if(F.col("relevant") & (F.col("rank") <= k)).alias(f"_at_{k}") for k in ks))
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(F.col(f"_at_{k}"), F.lit(0)).alias("n")) for k in ks])).alias("at")
    return totals.join(counted, key, "left").select(key, "n_truth", at).select(
        key, "at.k", F.round(F.col("at.n") / F.col("at.k"), 6).alias("precision_at_k"),
        F.round(F.try_divide(F.col("at.n").cast("double"), F.col("n_truth")), 6).alias("recall_at_k"))


def ndcg(hits: DataFrame, totals: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """Normalised discounted gain of 0/1 relevance at ``k`` for every query of ``totals`` (``key``, ``n_truth``).

    The ideal list begins with all relevant items there are, found or not. A
    query without hits has 0, one for which nothing is relevant null.
    """
    def gain(rank: Column) -> Column:
        return 1 / F.log2(rank + 1)

    found = hits.filter((F.col("rank") <= k) & F.col("relevant")).groupBy(key).agg(F.sum(gain(F.col("rank"))).alias("_dcg"))
    places = F.least(F.col("n_truth"), F.lit(k)).cast("int")
    ideal = F.when(places > 0, F.aggregate(F.sequence(F.lit(1), places), F.lit(0.0), lambda a, i: a + gain(i)))
    return totals.join(found, key, "left").select(
        key, F.round(F.coalesce("_dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"))


def summary(df: DataFrame, by: str, rating: str = "correctness") -> DataFrame:
    """Per experiment: percentage of positive ratings, average tokens and latency. All experiments in one job."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg(F.when(F.col(rating) == "yes", 1.0).otherwise(0.0)) * 100, 6).alias("correct_percentage"),
        F.round(F.avg("total_token_count"), 6).alias("avg_token_count"),
        F.round(F.avg("latency_seconds"), 6).alias("avg_latency_seconds"))


def token_counts(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Input (system and user), output (assistant) and total tokens."""
    n = tx.token_count(F.col("content"))
    written = F.col("role") == "assistant"
    return turns.groupBy(key).agg(
        F.sum(F.when(written, 0).otherwise(n)).cast("long").alias("input_tokens"),
        F.sum(F.when(written, n).otherwise(0)).cast("long").alias("output_tokens"),
        F.sum(n).cast("long").alias("total_tokens"))


def latency(df: DataFrame, by: str, value: str = "latency_seconds", fractions: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Average and exact percentiles per experiment."""
    averages = df.groupBy(by).agg(F.round(F.avg(value), 6).alias("avg_latency"))
    ranked = exact_percentiles(df, by, value, fractions)
    wide = ranked.groupBy(by).agg(*[
        F.round(F.max(F.when(F.col("fraction") == float(p), F.col("result"))), 6).alias(f"p{round(p * 100)}") for p in fractions])
    return averages.join(wide, by)
