import datetime

import pytest
from pyspark.sql import functions as F

from docloom.sources import files, tables
from tests.conftest import rows


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "a.txt").write_text("first text")
    (tmp_path / "docs" / "sub" / "b.html").write_text("<h1>Two</h1><p>second</p>")
    (tmp_path / "empty").mkdir()
    return tmp_path


def test_load_files_is_recursive(spark, folder):
    df = files.load_files(spark, str(folder / "docs"))
    assert df.columns == ["path", "modificationTime", "length", "content"]
    assert sorted(bytes(r.content).decode() for r in df.collect()) == ["<h1>Two</h1><p>second</p>", "first text"]


def test_load_files_by_format(spark, folder):
    assert files.load_files(spark, str(folder / "docs"), "html").count() == 1
    with pytest.raises(FileNotFoundError):
        files.load_files(spark, str(folder / "docs"), "pdf")


def test_missing_and_empty_folders_raise(spark, folder):
    with pytest.raises(FileNotFoundError):
        files.load_files(spark, str(folder / "none"))
    with pytest.raises(FileNotFoundError):
        files.load_files(spark, str(folder / "empty"))


def test_eval_rows(spark):
    df = files.eval_rows(spark, [
        {"request": "q1", "expected_response": "a1", "expected_retrieved_context": [("u", "c")]}, {"request": "q2"}])
    assert rows(df, "request", "expected_response") == [("q1", "a1"), ("q2", None)]
    with pytest.raises(ValueError):
        files.eval_rows(spark, [{"response": "no request"}])
    with pytest.raises(ValueError):
        files.eval_rows(spark, [{"request": "q", "answer": "x"}])


def test_write_table_replaces_schema(spark):
    tables.write_table(spark.createDataFrame([(1,)], "a int"), "replaced")
    tables.write_table(spark.createDataFrame([("x", 2.0)], "b string, c double"), "replaced")
    assert tables.read_table(spark, "replaced").columns == ["b", "c"]


def test_tags_and_lineage(spark):
    tables.write_table(spark.createDataFrame([(1,)], "a int"), "tagged")
    config = {"chunker": {"name": "window", "config": {"size": 5}}, "note": "it's"}
    tags = tables.tag_table(spark, "tagged", config)
    stored = {r.key: r.value for r in spark.sql("SHOW TBLPROPERTIES tagged").collect()}
    assert tags == {"chunker__name": "window", "chunker__config__size": "5", "note": "it's"}
    assert {k: stored[k] for k in tags} == tags
    assert len(tables.tag_table(spark, "tagged", {f"k{i}": i for i in range(40)})) == 40
    for stage in ("parse", "chunk"):
        tables.log_lineage(spark, "lineage", "run1", stage, "tagged", 1, config)
    tables.log_lineage(spark, "lineage", "run1", "bare", "tagged", 1)
    logged = spark.read.table("lineage")
    assert rows(logged, "run", "stage", "rows") == [("run1", "bare", 1), ("run1", "chunk", 1), ("run1", "parse", 1)]
    assert logged.filter("stage = 'parse'").first().config["chunker/config/size"] == "5"


def test_flatten():
    assert tables.flatten({"a": {"b": 1, "c": {"d": 2}}, "e": 3, "f": {}}) == {"a/b": 1, "a/c/d": 2, "e": 3, "f": {}}


def test_layout_names():
    layout = tables.layout_for("html-Window 512", "s", "/ck")
    assert layout.parsed == "s.html_window_512_silver_parsed"
    assert layout.quarantine(layout.parsed) == "s.html_window_512_silver_parsed_quarantine"
    assert layout.checkpoint(layout.raw) == "/ck/s.html_window_512_bronze_raw"


def test_modification_time_is_a_timestamp(spark, folder):
    row = files.load_files(spark, str(folder / "docs")).select(F.max("modificationTime").alias("t")).first()
    assert isinstance(row.t, datetime.datetime)
