"""Root causes out of judge ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETRIEVAL = "Improve Retrieval"
GENERATION = "Improve Generation"
PASSED = "No root cause, record passed"

# Precision is low below this.
LOW_PRECISION = 0.5

# Low precision, grounded, correct, relevant (None: any) -> cause, verdict.
RULES_WITH_TRUTH = [
    (True, "no", "no", "no", RETRIEVAL, "fail", "poor retrieval"),
    (True, "no", "no", "yes", RETRIEVAL, "fail", "relevant answer without retrieval support"),
    (True, "no", "yes", None, RETRIEVAL, "fail", "correct answer despite poor retrieval"),
    (True, "yes", "no", "no", RETRIEVAL, "fail", "grounded in poor retrieval"),
    (True, "yes", "no", "yes", RETRIEVAL, "fail", "relevant but grounded in off-target chunks"),
    (True, "yes", "yes", None, PASSED, "pass", "enough was retrieved for a correct answer"),
    (False, "no", "no", None, GENERATION, "fail", "made up"),
    (False, "no", "yes", None, GENERATION, "fail", "correct with made-up details"),
    (False, "yes", "no", "no", GENERATION, "fail", "good retrieval, irrelevant answer"),
    (False, "yes", "no", "yes", GENERATION, "fail", "good retrieval, relevant but wrong answer"),
    (False, "yes", "yes", "yes", PASSED, "pass", "no issue"),
]

# Low precision, grounded, relevant -> cause, verdict.
RULES_WITHOUT_TRUTH = [
    (True, "no", "no", RETRIEVAL, "fail", "poor retrieval"),
    (True, "no", "yes", RETRIEVAL, "fail", "poor retrieval"),
    (True, "yes", "no", RETRIEVAL, "fail", "grounded in poor retrieval"),
    (True, "yes", "yes", RETRIEVAL, "pass", "relevant and grounded despite poor retrieval"),
    (False, "no", "no", GENERATION, "fail", "made up"),
    (False, "no", "yes", GENERATION, "fail", "made up"),
    (False, "yes", "no", GENERATION, "fail", "good retrieval, irrelevant answer"),
    (False, "yes", "yes", PASSED, "pass", "good retrieval, relevant answer; correctness unknown"),
]


def root_cause(df: DataFrame, truth: bool) -> DataFrame:
    """Adds ``root_cause``, ``assessment`` and ``rationale``; null where no rule applies.

    The rules are a few fixed lines, so they are one conditional expression and no join.
    """
    rules = RULES_WITH_TRUTH if truth else RULES_WITHOUT_TRUTH
    ratings = ["groundedness", "correctness", "relevance_to_query"] if truth else ["groundedness", "relevance_to_query"]
    low = F.col("chunk_relevance_precision") < LOW_PRECISION
    chosen: Column | None = None
    for is_low, *wanted, cause, verdict, rationale in rules:
        applies = low if is_low else ~low
        for column, value in zip(ratings, wanted):
            if value is not None:
                applies = applies & (F.col(column) == value)
        result = F.struct(F.lit(cause).alias("root_cause"), F.lit(verdict).alias("assessment"), F.lit(rationale).alias("rationale"))
        chosen = F.when(applies, result) if chosen is None else chosen.when(applies, result)
    return df.withColumn("_why", chosen).select(*df.columns, "_why.*")


def cause_frequency(diagnosed: DataFrame, by: str = "root_cause", with_missing: bool = False) -> DataFrame:
    """``value, n, percent`` of the rows that have a cause, or ``with_missing`` of all rows.

    The window sees one row per rule and one for none at most.
    """
    rated = diagnosed if with_missing else diagnosed.filter(F.col(by).isNotNull())
    counted = rated.groupBy(F.col(by).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("percent", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 6))


def drilldown(diagnosed: DataFrame, cause: str, columns: list[str]) -> DataFrame:
    return diagnosed.filter(F.col("root_cause") == cause).select(*columns)


def suspects(judged: DataFrame) -> DataFrame:
    """Rows to look at first: wrong on low precision, or ungrounded although precision is high."""
    low = F.col("chunk_relevance_precision") < LOW_PRECISION
    reason = (
        F.when((F.col("correctness") == "no") & low, "wrong_low_precision")
        .when((F.col("groundedness") == "no") & ~low, "ungrounded_high_precision"))
    return judged.withColumn("reason", reason).filter(F.col("reason").isNotNull())
