from pyspark.sql import functions as F

from docloom.operators import indexing
from docloom.operators.encoding import HashingEncoder, RemoteEncoder
from docloom.sources import tables
from tests.conftest import rows


def chunks(spark, data):
    return spark.createDataFrame(list(data.items()), "chunk_id string, chunked_text string")


def test_changes(spark):
    old, new = chunks(spark, {"a": "1", "b": "2", "c": "3"}), chunks(spark, {"a": "1", "b": "x", "d": "4"})
    assert rows(indexing.index_changes(old, new)) == [("a", "same"), ("b", "update"), ("c", "delete"), ("d", "insert")]


def test_sync_builds_then_touches_only_changes(spark):
    tables.drop_index(spark, "idx")
    first = {f"k{i}": f"text number {i}" for i in range(60)}
    assert indexing.sync_index("idx", chunks(spark, first))["insert"] == 60
    assert indexing.sync_index("idx", chunks(spark, first)) == {"insert": 0, "update": 0, "delete": 0, "same": 60}
    second = {k: v for k, v in first.items() if k not in ("k3", "k4")} | {"k5": "changed", "new": "added"}
    # Only the changed rows are encoded again.
    got = indexing.sync_index("idx", chunks(spark, second), factory=lambda: RemoteEncoder(lambda t: [1.0, 2.0]))
    assert got == {"insert": 1, "update": 1, "delete": 2, "same": 57}
    index = spark.read.table("idx")
    assert rows(index, "chunk_id", "chunked_text") == sorted(second.items())
    assert rows(index.filter(F.size("embedding") == 2), "chunk_id") == [("k5",), ("new",)]
    assert HashingEncoder().encode(["text number 0"])[0][0].tolist() == index.filter("chunk_id = 'k0'").first().embedding


def test_deleted_rows_are_gone_and_come_back(spark):
    tables.drop_index(spark, "idx2")
    for data in ({"a": "1", "b": "2"}, {"b": "2"}, {"a": "1", "b": "2"}, {"b": "3"}):
        indexing.sync_index("idx2", chunks(spark, data), compact_share=1e9)
        assert rows(spark.read.table("idx2"), "chunk_id", "chunked_text") == sorted(data.items())
    assert rows(spark.read.table("idx2"), "chunk_id", "origin") == [("b", 3)]
    assert tables.index_versions(spark, "idx2", "base") == [0]


def test_sync_writes_only_the_changed_share(spark):
    tables.drop_index(spark, "idx3")
    first = {f"k{i}": f"text number {i}" for i in range(2000)}
    indexing.sync_index("idx3", chunks(spark, first), bucket_bytes=4000)
    base = spark.read.table("idx3_base_v0").inputFiles()
    assert 4 < len({f.rsplit("_", 1)[-1] for f in base}) < 20  # buckets by size
    second = first | {"k7": "changed", "k1000": "changed too"}
    assert indexing.sync_index("idx3", chunks(spark, second)) == {"insert": 0, "update": 2, "delete": 0, "same": 1998}
    assert spark.read.table("idx3_base_v0").inputFiles() == base
    assert rows(spark.read.table("idx3_delta_v0"), "chunk_id", "origin") == [("k1000", 1), ("k7", 1)]
    kept = spark.read.table("idx3").filter("origin = 0")
    assert kept.count() == 1998 and kept.join(spark.read.table("idx3_base_v0"), ["chunk_id", "embedding"], "left_semi").count() == 1998


def test_compaction_changes_no_row(spark):
    tables.drop_index(spark, "idx4")
    first = {f"k{i}": f"text number {i}" for i in range(20)}
    indexing.sync_index("idx4", chunks(spark, first))
    second = {k: v + "!" for k, v in first.items() if k != "k0"}
    indexing.sync_index("idx4", chunks(spark, second), compact_share=0.0)
    assert tables.index_versions(spark, "idx4", "base") == [0, 1] and spark.read.table("idx4_delta_v1").count() == 0
    assert rows(spark.read.table("idx4"), "chunk_id", "chunked_text") == sorted(second.items())
    indexing.compact_index(spark, "idx4")
    assert tables.index_versions(spark, "idx4", "base") == [1, 2]
    assert rows(spark.read.table("idx4"), "chunk_id", "chunked_text", "origin") == sorted((k, v, 1) for k, v in second.items())


def test_null_texts_and_an_empty_corpus(spark):
    tables.drop_index(spark, "idx5")
    indexing.sync_index("idx5", chunks(spark, {"a": "1"}))
    one = spark.createDataFrame([("a", None), ("b", "")], "chunk_id string, chunked_text string")
    assert indexing.index_changes(spark.read.table("idx5"), one).filter("change = 'update'").count() == 1
    assert indexing.index_changes(one, one).select("change").distinct().first().change == "same"
    empty = one.limit(0)
    assert indexing.sync_index("idx5", empty) == {"insert": 0, "update": 0, "delete": 1, "same": 0}
    assert spark.read.table("idx5").count() == 0


def test_coverage(spark):
    docs = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t")], "doc_id int, source string")
    indexed = spark.createDataFrame([(1,), (1,), (3,)], "doc_id int")
    assert rows(indexing.index_coverage(docs, indexed, "doc_id", "source")) == [("s", 2, 1), ("t", 1, 0)]
