import duckdb
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Builds a documents table from ``(doc_id, text, lang, source)``, with a column whose name an operator uses inside."""
    def build(rows):
        full = [(d, t, la, s, None if t is None else len(t)) for d, t, la, s in rows]
        return spark.createDataFrame(full, DOCS).withColumn("n_words", F.lit("x")).withColumn("row", F.lit(1)).withColumn("id", F.lit(2))
    return build


@pytest.fixture
def duck():
    return duckdb.connect()


# Nulls, empty and blank texts, a repeated row, a document without id, one line of very many words.
ODD = [(9001, None, "en", "a"), (9002, "", None, "a"), (9003, " \n\t", "en", None), (9004, "one two", "en", "b"), (9004, "one two", "en", "b"),
       (None, "some words without any id at all in this text here", "de", "c"), (9007, "word " * 30_000, "en", "a"), (None, None, None, None)]
