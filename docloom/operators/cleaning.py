"""Removal of lines that many documents share: headers, footers, notices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import let, lines


def boilerplate_lines(df: DataFrame, text: str, min_docs: int) -> DataFrame:
    """Ids of the lines found in at least ``min_docs`` documents.

    Each document counts a line once before anything is shuffled, and only the
    16-byte digest of a line travels.
    """
    per_doc = df.select(F.explode(F.array_distinct(F.transform(lines(F.col(text)), F.md5))).alias("line_id"))
    return per_doc.groupBy(F.unhex("line_id").alias("line_id")).agg(F.count(F.lit(1)).alias("n_docs")).filter(
        F.col("n_docs") >= min_docs)


def strip_boilerplate(df: DataFrame, key: str, text: str, min_docs: int) -> DataFrame:
    """``key``, the text without its boilerplate lines (order kept) and how many were dropped.

    Only line ids go through the join with the boilerplate set; the positions to
    drop come back to the document, whose text is then filtered in place. A null
    text stays null with nothing dropped.
    """
    shared = boilerplate_lines(df, text, min_docs).select("line_id")
    ids = df.select(key, F.posexplode(F.transform(lines(F.col(text)), lambda x: F.unhex(F.md5(x)))).alias("pos", "line_id"))
    dropped = ids.join(shared, "line_id", "left_semi").groupBy(key).agg(F.collect_list("pos").alias("_drop"))
    # array_except hashes the dropped positions, so this stays linear in the lines.
    kept = let(lines(F.col(text)), lambda ls: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_drop")), lambda p: F.get(ls, p)))
    cleaned = F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return df.select(key, text).join(dropped, key, "left").select(
        key, cleaned.alias("clean_text"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))


def collapse_repeats(df: DataFrame, text: str) -> DataFrame:
    """Adds ``clean_text``: a line repeated within one document stays where it first stands."""
    return df.withColumn("clean_text", F.array_join(F.array_distinct(lines(F.col(text))), "\n"))
