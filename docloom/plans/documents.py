"""The batch document run: files, parsed text, chunks, index."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import indexing, parsing
from docloom.operators.chunkers import chunk_by_name, without_chunk
from docloom.operators.chunking import dedup_chunks
from docloom.sources.files import load_files
from docloom.sources.tables import Layout, log_lineage, read_table, tag_table, write_table


@dataclass(frozen=True)
class Strategy:
    """How one corpus is parsed, chunked and encoded."""

    name: str
    file_format: str | None = None
    parser: str | None = None
    chunker: str = "window"
    chunker_settings: dict = field(default_factory=dict)
    encoder: str = "hashing"

    def config(self) -> dict:
        return {"pipeline_config": {
            "file_format": self.file_format, "parser": self.parser or "by extension",
            "chunker": {"name": self.chunker, "config": self.chunker_settings}}, "encoder": self.encoder}


def parse_files(files: DataFrame, parser: str | None = None) -> DataFrame:
    """``doc_uri, doc_content, parser_status, last_modified`` of raw files."""
    known = files.withColumn("ext", tx.extension(F.col("path")))
    parsed = parsing.apply_parser(known, parser) if parser else parsing.parse_by_extension(known)
    return parsed.select(
        tx.doc_uri(F.col("path")).alias("doc_uri"), F.col("parsing.output").alias("doc_content"),
        F.col("parsing.status").alias("parser_status"), F.col("modificationTime").alias("last_modified"))


def run_documents(spark: SparkSession, path: str, strategy: Strategy, layout: Layout,
                  lineage_table: str | None = None) -> dict[str, int]:
    """Run every step once and store its table; each table is read back, so nothing is parsed twice."""
    files = load_files(spark, path, strategy.file_format)
    write_table(parse_files(files, strategy.parser), layout.staging)
    counts = store_documents(read_table(spark, layout.staging), strategy, layout, lineage_table)
    spark.sql(f"DROP TABLE {layout.staging}")
    return counts


def store_documents(parsed: DataFrame, strategy: Strategy, layout: Layout, lineage_table: str | None = None) -> dict[str, int]:
    """Documents, chunks, index and quarantine tables of a strategy out of stored rows of ``parse_files``."""
    from docloom.operators.encoding import encoder_factory

    spark = parsed.sparkSession
    report = parsing.check_parsed(parsed)
    good, bad = parsing.split_status(parsed, F.col("parser_status"))
    write_table(good, layout.parsed)
    write_table(bad, layout.quarantine(layout.parsed))
    documents, keep = read_table(spark, layout.parsed), ["doc_uri", "last_modified"]
    write_table(chunk_by_name(strategy.chunker, documents, "doc_content", keep, **strategy.chunker_settings), layout.chunked)
    stored = read_table(spark, layout.chunked)
    write_table(without_chunk(documents, stored, "doc_content", keep, "doc_uri"), layout.quarantine(layout.chunked))
    unique = dedup_chunks(stored, "doc_uri").select("chunk_id", "chunked_text", "doc_uri")
    synced = indexing.sync_index(layout.table("index"), unique, factory=encoder_factory(strategy.encoder))
    counts = {"documents": report["total"], "quarantined": report["failed"], "chunks": stored.count(), **synced}
    for table in (layout.parsed, layout.chunked):
        tag_table(spark, table, strategy.config())
        if lineage_table:
            log_lineage(spark, lineage_table, strategy.name, "documents", table,
                        counts["chunks"] if table == layout.chunked else report["total"] - report["failed"],
                        strategy.config())
    return counts
