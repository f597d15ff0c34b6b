"""Many strategies over one corpus in one job: the strategy is a column."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import parsing
from docloom.operators.chunking import windows_of_tokens
from docloom.plans.documents import Strategy, store_documents
from docloom.sources.files import load_files
from docloom.sources.tables import layout_for, read_table, write_table


def _named(arrays: dict[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("strategy"), chunks.alias("chunks")) for name, chunks in arrays.items()])


def _exploded(df: DataFrame, keep: list[str], by_strategy: Column) -> DataFrame:
    exploded = df.select(*keep, F.explode(by_strategy).alias("s"))
    chunked = exploded.select("s.strategy", *keep, F.posexplode("s.chunks").alias("chunk_pos", "chunked_text"))
    return chunked.withColumn("chunk_id", tx.chunk_id(F.col("chunked_text")))


def chunk_all(df: DataFrame, keep: list[str], arrays: dict[str, Column]) -> DataFrame:
    """Chunks of several strategies, each an array expression: ``strategy, keep..., chunk_pos, chunked_text, chunk_id``.

    Documents are read once; the strategies are exploded within each row.
    """
    return _exploded(df, keep, _named(arrays))


def sweep_chunks(df: DataFrame, text: str, keep: list[str], specs: dict[str, tuple[int, int]]) -> DataFrame:
    """Token windows of every (size, overlap) spec; a document is split into tokens once for all of them."""
    return _exploded(df, keep, tx.let(tx.tokens(F.col(text)), lambda toks: _named(
        {name: windows_of_tokens(toks, size, overlap) for name, (size, overlap) in specs.items()})))


def parse_once(files: DataFrame, wanted: list[tuple[str | None, str | None]]) -> DataFrame:
    """``parse_files`` for every (file format, parser) of a list, in one pass over the files.

    ``parse`` is the place in the list. A file's content is read once, whatever
    the number of parsers; only parsed text is exploded.
    """
    known = files.withColumn("ext", tx.extension(F.col("path")))
    results = []
    for i, (file_format, parser) in enumerate(wanted):
        known = parsing.apply_parser(known, parser) if parser else parsing.parse_by_extension(known)
        known = known.withColumnRenamed("parsing", f"_parsing{i}")
        one = F.struct(F.lit(i).alias("parse"), F.col(f"_parsing{i}").alias("parsing"))
        results.append(F.when(F.col("path").endswith(f".{file_format.lstrip('.')}"), one) if file_format else one)
    rows = known.select("path", "modificationTime", F.explode(F.array_compact(F.array(*results))).alias("_one"))
    return rows.select(
        tx.doc_uri(F.col("path")).alias("doc_uri"), F.col("_one.parsing.output").alias("doc_content"),
        F.col("_one.parsing.status").alias("parser_status"), F.col("modificationTime").alias("last_modified"),
        F.col("_one.parse").alias("parse"))


def run_sweep(spark: SparkSession, path: str, strategies: list[Strategy], schema: str,
              checkpoint_root: str) -> dict[str, dict[str, int] | str]:
    """Each strategy's own tables over one corpus; one failing strategy does not stop the others.

    The files are scanned once, and parsed once by each parser that is asked
    for. The parsed text is stored in a folder per parse, which the strategies read.
    """
    def known(parser: str | None) -> bool:
        return parser is None or parser in parsing.parser_names()

    wanted = list(dict.fromkeys((s.file_format, s.parser) for s in strategies if known(s.parser)))
    table = f"{schema}.sweep_{uuid.uuid4().hex[:8]}_parsed"
    write_table(parse_once(load_files(spark, path), wanted), table, ["parse"])
    results: dict[str, dict[str, int] | str] = {}
    try:
        found = {r["parse"] for r in read_table(spark, table).select("parse").distinct().collect()}
        for strategy in strategies:
            try:
                if not known(strategy.parser):
                    raise ValueError(f"unknown parser {strategy.parser!r}")
                at = wanted.index((strategy.file_format, strategy.parser))
                if at not in found:
                    raise FileNotFoundError(f"{path} holds no {strategy.file_format or ''} files")
                parsed = read_table(spark, table).filter(F.col("parse") == at).drop("parse")
                results[strategy.name] = store_documents(parsed, strategy, layout_for(strategy.name, schema, checkpoint_root))
            except (ValueError, FileNotFoundError) as problem:
                results[strategy.name] = f"ERROR: {problem}"
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    return results
