"""A training corpus from raw documents: five stages, each on what its predecessor kept."""

from __future__ import annotations

import os
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import docloom  # noqa: E402
from docloom.llm import decontamination, line_dedup, mixing, near_dedup, quality_rules  # noqa: E402
from docloom.llm.common import stored  # noqa: E402

# Python workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(docloom)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the limits and are no outliers of their language and source."""
    return quality_rules.filtered(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of an earlier document are cut; a document without words left is gone."""
    return line_dedup.cleaned(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.deduplicated(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents to take, and how often, so that sources meet their weights."""
    return mixing.corpus(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("decontamination", leaks), ("mixing", mixture)]

# Robust estimates and similarity verification have no SQL form; tests run the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
