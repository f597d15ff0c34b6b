import datetime
import re

import pytest
from pyspark.sql import functions as F

from docloom.plans import sweep
from docloom.plans.documents import Strategy, run_documents
from docloom.plans.sweep import run_sweep
from docloom.sources import files, published, tables
from docloom.streaming import latest, monitor, stages
from tests.conftest import rows


@pytest.fixture
def corpus(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.html").write_text("<h1>A</h1><p>one two three four five six</p>")
    (folder / "b.txt").write_text("plain words here")
    (folder / "c.html").write_bytes(b"\xff\xfe broken")
    (folder / "d.pdf").write_bytes(b"%PDF")
    return folder


def drop(spark, layout):
    tables.reset(spark, layout)


def test_stream_reads_each_file_once(spark, corpus, tmp_path):
    target, checkpoint = "ingested", str(tmp_path / "ck")
    spark.sql("DROP TABLE IF EXISTS ingested")
    for expected in (2, 2):
        tables.append_table(files.stream_files(spark, str(corpus), "html"), target, checkpoint).awaitTermination()
        assert spark.read.table(target).count() == expected
    (corpus / "e.html").write_text("<p>new</p>")
    tables.append_table(files.stream_files(spark, str(corpus), "html"), target, checkpoint).awaitTermination()
    assert spark.read.table(target).count() == 3


def test_incremental_run(spark, corpus, tmp_path):
    layout = tables.Layout("default", str(tmp_path / "ck"), "inc")
    drop(spark, layout)
    first = stages.run_incremental(spark, str(corpus), layout, chunker="window", size=4, overlap=1)
    assert spark.read.table(layout.raw).count() == 4
    assert spark.read.table(layout.parsed).count() == 2
    bad = spark.read.table(layout.quarantine(layout.parsed))
    assert sorted(r.doc_uri.split("/")[-1] for r in bad.collect()) == ["c.html", "d.pdf"]
    assert first == {"parse": 2, "chunk": 0}
    n = spark.read.table(layout.chunked).count()
    assert n > 2
    # Nothing new: nothing added, no failures reported.
    assert stages.run_incremental(spark, str(corpus), layout, chunker="window", size=4, overlap=1) == {"parse": 0, "chunk": 0}
    assert spark.read.table(layout.chunked).count() == n
    (corpus / "f.txt").write_text("later")
    stages.run_incremental(spark, str(corpus), layout, chunker="window", size=4, overlap=1)
    assert spark.read.table(layout.chunked).count() == n + 1
    # After a reset every file is read again.
    tables.reset(spark, layout)
    stages.run_incremental(spark, str(corpus), layout, chunker="window", size=4, overlap=1)
    assert spark.read.table(layout.parsed).count() == 3


@pytest.mark.parametrize("chunker", ["recursive", "semantic", "markdown", "paragraph"])
def test_chunkers_by_name_and_quarantine(spark, corpus, tmp_path, chunker):
    (corpus / "empty.txt").write_text(" \n ")
    layout = tables.Layout("default", str(tmp_path / "ck"), f"named_{chunker}")
    drop(spark, layout)
    assert stages.run_incremental(spark, str(corpus), layout, chunker=chunker) == {"parse": 2, "chunk": 1}
    uris = {r.doc_uri.split("/")[-1] for r in spark.read.table(layout.chunked).collect()}
    assert uris == {"a.html", "b.txt"}
    bad = spark.read.table(layout.quarantine(layout.chunked)).collect()
    assert [(r.doc_uri.split("/")[-1], r.chunker_status) for r in bad] == [("empty.txt", "ERROR: no text")]
    (corpus / "heading.txt").write_text("# Only a heading")
    stages.run_incremental(spark, str(corpus), layout, chunker=chunker)
    parsed, cut, bad = (spark.read.table(t) for t in (layout.parsed, layout.chunked, layout.quarantine(layout.chunked)))
    assert parsed.count() == cut.select("doc_uri").distinct().count() + bad.count() == 4
    assert bad.filter("chunker_status = 'ERROR: no chunk'").count() == (chunker == "markdown")
    with pytest.raises(ValueError, match="unknown chunker"):
        stages.chunk_stage(spark, layout, "no such")


def test_reset_drops_the_batch_index(spark, corpus, tmp_path):
    layout = tables.layout_for("reset run", "default", str(tmp_path / "ck"))
    drop(spark, layout)
    run_documents(spark, str(corpus), Strategy("reset run", chunker="markdown"), layout)
    assert spark.catalog.tableExists(layout.table("index")) and spark.read.table(layout.quarantine(layout.chunked)).count() == 0
    tables.reset(spark, layout)
    assert not any(spark.catalog.tableExists(t) for t in layout.tables())


def test_index_follows_the_chunks(spark, corpus, tmp_path):
    layout = tables.Layout("default", str(tmp_path / "ck"), "idxs")
    drop(spark, layout)
    sizes = []
    for name, text in (("g.txt", "plain words here"), ("h.txt", "other words")):
        stages.run_incremental(spark, str(corpus), layout, chunker="window", size=4, overlap=1)
        stages.index_stage(spark, layout).awaitTermination()
        index = spark.read.table(layout.table("index_stream"))
        assert index.count() == index.select("chunk_id").distinct().count() == spark.read.table(layout.chunked).select("chunk_id").distinct().count()
        sizes.append(index.count())
        (corpus / name).write_text(text)
    # The second run brought a copy of a known text only.
    assert sizes[0] == sizes[1]
    stages.run_incremental(spark, str(corpus), layout, chunker="window", size=4, overlap=1)
    query = stages.index_stage(spark, layout, continuous="1 second")
    query.processAllAvailable()
    query.stop()
    assert spark.read.table(layout.table("index_stream")).count() == sizes[0] + 1


def test_repeated_batch_changes_nothing(spark):
    spark.sql("DROP TABLE IF EXISTS batches")
    df = spark.createDataFrame([(1,), (2,)], "a int")
    for batch in (0, 1, 1):
        published.publish_batch(df, "batches", batch)
    assert spark.read.table("batches").count() == 4


def test_reader_sees_a_repeated_batch_once(spark, tmp_path, monkeypatch):
    """A batch is repeated while a stream reads the table, and again after a stop between mark and partition."""
    spark.sql("DROP TABLE IF EXISTS followed")
    spark.sql("DROP TABLE IF EXISTS seen")
    batch = lambda *v: spark.createDataFrame([(x,) for x in v], "a int")
    published.publish_batch(batch(1, 2), "followed", 0)

    def copy(listed, batch_id):
        published.publish_batch(published.published_rows(listed, "followed"), "seen", batch_id)

    query = (published.stream_published(spark, "followed").writeStream.foreachBatch(copy)
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start())
    try:
        query.processAllAvailable()
        published.publish_batch(batch(1, 2), "followed", 0)
        run = type(spark).sql

        def stopped(self, text, *args, **kwargs):
            if text.startswith("ALTER"):
                raise KeyboardInterrupt
            return run(self, text, *args, **kwargs)

        with monkeypatch.context() as patch, pytest.raises(KeyboardInterrupt):
            patch.setattr(type(spark), "sql", stopped)
            published.publish_batch(batch(3), "followed", 1)
        query.processAllAvailable()
        published.publish_batch(batch(3), "followed", 1)
        published.publish_batch(batch(), "followed", 2)
        query.processAllAvailable()
    finally:
        query.stop()
    assert rows(spark.read.table("seen"), "a") == rows(spark.read.table("followed"), "a") == [(1,), (2,), (3,)]


def test_unpublished_files_are_not_read(spark):
    spark.sql("DROP TABLE IF EXISTS halfway")
    df = spark.createDataFrame([(1,)], "a int")
    published.publish_batch(df, "halfway", 0)
    df.write.parquet(f"{published.location(spark, 'halfway')}/_batches/1-left")
    assert spark.read.table("halfway").count() == 1


def test_latest_click_per_key(spark, tmp_path):
    schema = "event_id long, request_id long, ts timestamp, v string"
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    folder, checkpoint = str(tmp_path / "log"), str(tmp_path / "ck")
    spark.sql("DROP TABLE IF EXISTS newest")
    for part in ([(1, 1, t(5), "old"), (2, 2, t(1), "x"), (6, None, t(1), None)],
                 [(3, 1, t(9), "new"), (4, 2, t(1), "tie"), (5, 1, t(2), "late")], [(7, 1, t(3), "later still")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        latest.stream_latest(stream, ["request_id"], ["ts", "event_id"], checkpoint, "newest").awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        assert state.count() == state.select("key").distinct().count() == 3
    got = latest.read_latest(spark, checkpoint)
    assert rows(got, "request_id", "v") == rows(spark.createDataFrame([(1, "new"), (2, "tie"), (None, None)], "a long, b string"))
    assert rows(spark.read.table("newest").filter("request_id = 1"), "batch_id", "v") == [(0, "old"), (1, "new"), (2, "new")]


def test_monitor_stream_closes_windows_and_drops_late_rows(spark, tmp_path):
    schema = "event_ts timestamp, experiment string, correctness string, latency_seconds double"
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    folder = str(tmp_path / "runs")
    spark.sql("DROP TABLE IF EXISTS monitored")
    for part in ([(at(0, 5), "poc", "yes", 1.0), (at(0, 50), "poc", "no", 3.0), (at(3, 0), "poc", "yes", 1.0)],
                 [(at(0, 10), "poc", "no", 9.0), (at(5, 0), "poc", "yes", 1.0)], [(at(9, 0), "poc", "yes", 1.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        out = monitor.monitor(stream, "1 hour", "30 minutes").select(F.hour("window.start").alias("h"), "n_rows", "correct_percent", "alert")
        tables.append_table(out, "monitored", str(tmp_path / "ck")).awaitTermination()
    # The row of 0:10 arrives after its window has closed.
    assert rows(spark.read.table("monitored")) == [(0, 2, 50.0, True), (3, 1, 100.0, False), (5, 1, 100.0, False)]


def test_batch_run_and_sweep(spark, corpus, tmp_path):
    layout = tables.layout_for("batch run", "default", str(tmp_path / "ck"))
    drop(spark, layout)
    spark.sql("DROP TABLE IF EXISTS runs_log")
    strategy = Strategy("batch run", chunker="window", chunker_settings={"size": 4, "overlap": 1})
    counts = run_documents(spark, str(corpus), strategy, layout, "runs_log")
    assert (counts["documents"], counts["quarantined"]) == (4, 2)
    assert counts["insert"] == spark.read.table(layout.table("index")).count() > 0
    assert spark.read.table("runs_log").count() == 2
    assert run_documents(spark, str(corpus), strategy, layout)["insert"] == 0
    swept = [Strategy("sweep w", "html", "html", "window", {"size": 3, "overlap": 0}), Strategy("sweep none", "docx")]
    for s in swept:
        drop(spark, tables.layout_for(s.name, "default", str(tmp_path / "ck")))
    results = run_sweep(spark, str(corpus), swept, "default", str(tmp_path / "ck"))
    assert results["sweep w"]["documents"] == 2 and results["sweep none"].startswith("ERROR")


def test_sweep_scans_and_parses_once(spark, corpus, tmp_path):
    root = str(tmp_path / "ck")
    wanted = [("html", "html"), (None, None), ("html", "text")]
    plan = sweep.parse_once(files.load_files(spark, str(corpus)), wanted)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan binaryFile") == 1
    chunkers = ["window", "chars", "paragraph", "sentence", "markdown", "recursive", "semantic"]
    swept = [Strategy(f"all {c}", chunker=c) for c in chunkers] + [Strategy("all text", "html", "text"), Strategy("all odd", parser="no such")]
    for s in swept:
        drop(spark, tables.layout_for(s.name, "default", root))
    results = sweep.run_sweep(spark, str(corpus), swept, "default", root)
    assert results["all odd"].startswith("ERROR: unknown parser")
    alone = tables.Layout("default", root, "alone")
    for strategy in swept[:-1]:
        drop(spark, alone)
        assert run_documents(spark, str(corpus), strategy, alone) == results[strategy.name]
        own = tables.layout_for(strategy.name, "default", root)
        columns = ["chunk_id", "doc_uri", "chunked_text"]
        assert rows(spark.read.table(own.chunked), *columns) == rows(spark.read.table(alone.chunked), *columns)
    assert not [t.name for t in spark.catalog.listTables("default") if re.fullmatch("sweep_[0-9a-f]{8}_parsed", t.name)]
