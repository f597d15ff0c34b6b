"""Incremental document stages chained by tables, each exactly once per checkpoint.

Loading appends through Spark's file sink, which keeps a log of its files. The
later stages write two tables from one micro-batch, so they publish their
batches (``sources.published``) and read what the stage before has published.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.chunkers import chunker_named, without_chunk
from docloom.operators.chunking import dedup_chunks
from docloom.operators.encoding import Encoder, HashingEncoder, embed
from docloom.operators.parsing import split_status
from docloom.plans.documents import parse_files
from docloom.sources.files import stream_files
from docloom.sources.published import publish_batch, published_rows, stream_published
from docloom.sources.tables import Layout, append_table, stream_table


def _trigger(continuous: str | None) -> dict:
    return {"processingTime": continuous} if continuous else {"availableNow": True}


def split_sink(stream: DataFrame, status: str, good_table: str, bad_table: str, checkpoint: str,
               continuous: str | None = None,
               project: Callable[[DataFrame], DataFrame] = lambda df: df,
               failed: dict[int, int] | None = None) -> StreamingQuery:
    """Write successes and failures of one stream to two tables, computing the rows once.

    ``failed`` receives the failed rows of each micro-batch under its number.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            good, bad = split_status(batch, F.col(status))
            publish_batch(project(good), good_table, batch_id)
            stored = publish_batch(bad, bad_table, batch_id)
            if failed is not None:
                failed[batch_id] = stored.count()
        finally:
            batch.unpersist()

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**_trigger(continuous)).start())


def load_stage(spark: SparkSession, path: str, layout: Layout, file_format: str | None = None,
               continuous: str | None = None) -> StreamingQuery:
    return append_table(stream_files(spark, path, file_format), layout.raw, layout.checkpoint(layout.raw), continuous)


def parse_stage(spark: SparkSession, layout: Layout, parser: str | None = None,
                continuous: str | None = None, failed: dict[int, int] | None = None) -> StreamingQuery:
    raw = stream_table(spark, layout.raw)
    return split_sink(parse_files(raw, parser), "parser_status", layout.parsed, layout.quarantine(layout.parsed),
                      layout.checkpoint(layout.parsed), continuous, failed=failed)


def chunk_stage(spark: SparkSession, layout: Layout, chunker: str = "window", continuous: str | None = None,
                failed: dict[int, int] | None = None, **settings) -> StreamingQuery:
    """Chunks of newly parsed documents; documents that give no chunk go to the quarantine table.

    Document columns travel with the chunks, so no stream is joined. The chunks
    are stored before the documents without any are looked for.
    """
    cut, keep = chunker_named(chunker), ["doc_uri", "last_modified"]

    def write(listed: DataFrame, batch_id: int) -> None:
        documents = published_rows(listed, layout.parsed)
        chunks = cut(documents, "doc_content", keep, **settings)
        stored = publish_batch(chunks.withColumn("chunker_status", F.lit("SUCCESS")), layout.chunked, batch_id)
        empty = publish_batch(without_chunk(documents, stored, "doc_content", keep, "doc_uri"),
                              layout.quarantine(layout.chunked), batch_id)
        if failed is not None:
            failed[batch_id] = empty.count()

    stream = stream_published(spark, layout.parsed)
    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", layout.checkpoint(layout.chunked))
            .trigger(**_trigger(continuous)).start())


def index_stage(spark: SparkSession, layout: Layout, factory: Callable[[], Encoder] = HashingEncoder,
                continuous: str | None = None) -> StreamingQuery:
    """Encode newly stored chunks into the index table, once or at every ``continuous`` interval.

    A chunk id stands for its text, so a known id needs no new vector. A batch
    that is already in the index is not written again.
    """
    table = layout.table("index_stream")

    def write(listed: DataFrame, batch_id: int) -> None:
        session = listed.sparkSession
        fresh = dedup_chunks(published_rows(listed, layout.chunked), "doc_uri").select("chunk_id", "chunked_text", "doc_uri")
        if session.catalog.tableExists(table):
            known = session.read.table(table).select("chunk_id")
            fresh = fresh.join(known, "chunk_id", "left_anti")
        publish_batch(embed(fresh, "chunked_text", "embedding", factory), table, batch_id)

    stream = stream_published(spark, layout.chunked)
    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", layout.checkpoint(table))
            .trigger(**_trigger(continuous)).start())


def run_incremental(spark: SparkSession, path: str, layout: Layout, file_format: str | None = None,
                    parser: str | None = None, chunker: str = "window", **settings) -> dict[str, int]:
    """Bring raw, parsed and chunk tables up to date with the files, then stop. Returns failures per stage."""
    load_stage(spark, path, layout, file_format).awaitTermination()
    failed: dict[str, dict[int, int]] = {"parse": {}, "chunk": {}}
    parse_stage(spark, layout, parser, failed=failed["parse"]).awaitTermination()
    chunk_stage(spark, layout, chunker, failed=failed["chunk"], **settings).awaitTermination()
    return {stage: sum(batches.values()) for stage, batches in failed.items()}
