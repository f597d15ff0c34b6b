"""Every registered query against its SQL, and basic shape where there is none."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from docloom.plans import catalog, oracles
from tests.conftest import SF_DIR

QUERIES = catalog.QUERIES
ORACLES = oracles.ORACLES
TABLES = ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
NO_SQL = {"retrieve_ann"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def shown(rows):
    def cell(v):
        if v is None:
            return ""
        return f"{round(v, 6) + 0.0:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in rows)


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    columns = sorted(got.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    spark_rows = [tuple(r) for r in got.select(*columns).collect()]
    quoted = ", ".join(f'"{c}"' for c in columns)
    duck_rows = duck.execute(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall()
    assert shown(spark_rows) == shown(duck_rows)


def test_all_are_registered():
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


def test_no_query_is_empty_here(spark):
    made = QUERIES["evaluation_set"](spark, SF_DIR)
    asked = spark.read.parquet(f"{SF_DIR}/conversations.parquet").filter("role = 'user'").count()
    # Every question is there, and some have an expected context out of their own hits.
    assert made.select("request_id").distinct().count() == asked == 48
    assert made.filter("expected_retrieved_context <> ''").count() > 0


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0
