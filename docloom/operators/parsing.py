"""Parsing: text out of files, with a status per row instead of failed tasks."""

from __future__ import annotations

import datetime
import typing
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as tx
from docloom.functions.markup import html_language, html_title, html_to_markdown

SUCCESS = "SUCCESS"

# A parser maps the raw content column to struct<output string, status string>.
Parser = Callable[[Column], Column]


def _parsed(output: Column, status: Column) -> Column:
    return F.struct(F.when(status == SUCCESS, output).alias("output"), status.alias("status"))


def decode_utf8(content: Column) -> Column:
    """Text of a binary column; null for bytes that are not UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))


def text_parser(content: Column) -> Column:
    decoded = decode_utf8(content)
    return _parsed(decoded, F.when(decoded.isNull(), "ERROR: not valid UTF-8").otherwise(SUCCESS))


def html_parser(content: Column) -> Column:
    decoded = decode_utf8(content)
    return _parsed(html_to_markdown(decoded), F.when(decoded.isNull(), "ERROR: not valid UTF-8").otherwise(SUCCESS))


_PARSERS: dict[str, Parser] = {"html": html_parser, "text": text_parser, "md": text_parser}
_BY_EXTENSION: dict[str, str] = {".html": "html", ".htm": "html", ".txt": "text", ".md": "md"}


def register_parser(name: str, parser: Parser, extensions: tuple[str, ...] = ()) -> None:
    """Add a parser by name, and by the file extensions it takes."""
    _PARSERS[name] = parser
    _BY_EXTENSION.update({e.lower(): name for e in extensions})


def parser_names() -> list[str]:
    return sorted(_PARSERS)


def parser(name: str) -> Parser:
    if name not in _PARSERS:
        raise ValueError(f"unknown parser {name!r}, known: {parser_names()}")
    return _PARSERS[name]


def apply_parser(df: DataFrame, name: str, content: str = "content") -> DataFrame:
    """Adds ``parsing struct<output, status>``."""
    return df.withColumn("parsing", parser(name)(F.col(content)))


def parse_by_extension(df: DataFrame, content: str = "content", ext: str = "ext") -> DataFrame:
    """Adds ``parsing`` by each row's extension; an unsupported one becomes an error status."""
    unsupported = F.concat(F.lit("ERROR: unsupported format "), F.col(ext))
    extensions: dict[str, list[str]] = {}
    for extension, name in _BY_EXTENSION.items():
        extensions.setdefault(name, []).append(extension)
    chosen = None
    for name, taken in extensions.items():
        hit, parsed = F.col(ext).isin(taken), parser(name)(F.col(content))
        chosen = F.when(hit, parsed) if chosen is None else chosen.when(hit, parsed)
    return df.withColumn("parsing", chosen.otherwise(_parsed(F.lit(None).cast("string"), unsupported)))


def apply_python_parser(df: DataFrame, parse: Callable[[bytes], str], content: str = "content") -> DataFrame:
    """Adds ``parsing`` from a Python function, for binary formats Spark cannot read.

    An exception becomes that row's status; the task goes on.
    """
    schema = T.StructType(df.schema.fields + [T.StructField("parsing", T.StructType([
        T.StructField("output", T.StringType()), T.StructField("status", T.StringType())]))])

    def one(raw: bytes) -> dict:
        try:
            return {"output": parse(raw), "status": SUCCESS}
        except Exception as problem:
            return {"output": None, "status": f"ERROR: {problem}"}

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(parsing=[one(raw) for raw in frame[content]])

    return df.mapInPandas(batches, schema)


def parse_json_doc(df: DataFrame, content: str, content_key: str) -> DataFrame:
    """Adds ``doc_parsed_contents map<string,string>`` and ``parser_status``.

    The content key is renamed ``parsed_content`` and takes the place of a key
    that already has this name; all other keys are kept. Of a repeated key the
    first value counts.
    """
    raw, fields = F.col(content).cast("string"), F.col("_fields")
    status = (
        F.when(~F.is_valid_utf8(raw), "ERROR: not valid UTF-8")
        .when(F.coalesce(F.map_contains_key(fields, content_key), F.lit(False)), SUCCESS)
        .when(fields.isNull() | (F.size(fields) == 0), "ERROR: not a JSON object")
        .otherwise(f"ERROR: no key {content_key}"))
    names = F.filter(F.array_distinct(F.map_keys(fields)), lambda k: (k == content_key) | (k != "parsed_content"))
    renamed = F.map_from_arrays(
        F.transform(names, lambda k: F.when(k == content_key, "parsed_content").otherwise(k)),
        F.transform(names, lambda k: F.element_at(fields, k)))
    return (
        df.withColumn("_fields", F.from_json(raw, "map<string,string>"))
        .withColumn("parser_status", status)
        .withColumn("doc_parsed_contents", F.when(F.col("parser_status") == SUCCESS, renamed))
        .drop("_fields"))


def pages_to_text(pages: Column) -> Column:
    """Map with the page texts in page order, one per line, and the page count as text."""
    ordered = F.transform(F.array_sort(pages), lambda p: p["parsed_content"])
    return F.create_map(
        F.lit("parsed_content"), F.array_join(ordered, "\n"),
        F.lit("num_pages"), F.size(pages).cast("string"))


def elements_to_text(elements: Column) -> Column:
    """Tables on lines of their own, as Markdown where HTML is known; other elements joined by a space.

    ``elements`` is ``array<struct<category, text, text_as_html>>`` in reading order.
    """
    def piece(e: Column, i: Column) -> Column:
        table = F.concat(F.lit("\n"), F.coalesce(html_to_markdown(e["text_as_html"]), e["text"]), F.lit("\n"))
        return F.when(e["category"] == "Table", table).otherwise(F.concat(F.lit(" "), e["text"]))

    return tx.strip(F.array_join(F.transform(elements, piece), ""))


def extract_metadata(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One column per rule, a rule being any expression over the document."""
    return df.withColumns(rules)


def contains_word(text: Column, word: str, yes: str, no: str) -> Column:
    return F.when(F.contains(text, F.lit(word)), yes).otherwise(no)


def select_parsed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Successful rows, the parsing struct flattened to the declared columns."""
    ok = df.filter(F.col("parsing.status") == SUCCESS)
    inner = {f.name for f in df.schema["parsing"].dataType.fields}
    return ok.select(*[(F.col(f"parsing.{f.name}") if f.name in inner else F.col(f.name))
                       .cast(f.dataType).alias(f.name) for f in schema.fields])


def split_status(df: DataFrame, status: Column) -> tuple[DataFrame, DataFrame]:
    """Success and quarantine; a null status is a failure."""
    good = F.coalesce(status == SUCCESS, F.lit(False))
    return df.filter(good), df.filter(~good)


def parse_report(df: DataFrame, status: str = "parser_status", content: str = "doc_content") -> DataFrame:
    """Total, failed and empty documents in one pass."""
    good = F.coalesce(F.col(status) == SUCCESS, F.lit(False))
    empty = good & (F.coalesce(tx.strip(F.col(content)), F.lit("")) == "")
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(~good).alias("failed"), F.count_if(empty).alias("empty"))


def check_parsed(df: DataFrame, status: str = "parser_status", content: str = "doc_content") -> dict[str, int]:
    """The report as numbers; raises when nothing was parsed or all of it is empty."""
    row = parse_report(df, status, content).first().asDict()
    if row["total"] == 0 or row["failed"] == row["total"]:
        raise ValueError(f"all {row['total']} documents failed to parse")
    if row["empty"] == row["total"] - row["failed"]:
        raise ValueError(f"all {row['empty']} parsed documents are empty")
    return row


def document_metadata(pages: DataFrame, url: str = "path", html: str = "content") -> DataFrame:
    """Title, language and URL parts, as columns to filter retrieval by."""
    address = F.col(url)
    return pages.withColumns({
        "title": html_title(F.col(html)),
        "language": html_language(F.col(html)),
        "host": F.coalesce(F.try_parse_url(address, F.lit("HOST")), F.lit("")),
        "url_path": F.coalesce(F.try_parse_url(address, F.lit("PATH")), F.lit("")),
        "url_query": F.coalesce(F.try_parse_url(address, F.lit("QUERY")), F.lit("")),
    })


def parse_sample(df: DataFrame, by: str, uri: str, n: int) -> DataFrame:
    """``n`` documents of each group for review, the same ones on every run."""
    from pyspark.sql import Window

    order = Window.partitionBy(by).orderBy(F.md5(F.col(uri)), F.col(uri))
    return df.withColumn("sample_no", F.row_number().over(order)).filter(F.col("sample_no") <= n)


def corpus_report(df: DataFrame, keys: list[str], size: str = "n_chars", status: str = "parser_status") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(size).cast("long").alias("total_chars"),
        F.count_if(F.coalesce(F.col(status) != SUCCESS, F.lit(True))).alias("n_failed"))


# The Spark type of each annotation a record may use.
_PRIMITIVES: dict[type, T.DataType] = {
    str: T.StringType(),
    int: T.IntegerType(),
    float: T.DoubleType(),
    bool: T.BooleanType(),
    datetime.datetime: T.TimestampType(),
    datetime.date: T.DateType(),
    list: T.ArrayType(T.StringType()),
}


def _spark_type(annotation: object) -> T.DataType:
    if typing.get_origin(annotation) is list:
        return T.ArrayType(_spark_type(typing.get_args(annotation)[0]))
    if annotation in _PRIMITIVES:
        return _PRIMITIVES[annotation]
    raise TypeError(f"no Spark type for {annotation!r}")


def schema_of(*records: type) -> T.StructType:
    """Schema of the annotations of one or more record classes, every field nullable."""
    return T.StructType([
        T.StructField(name, _spark_type(annotation), True)
        for record in records for name, annotation in typing.get_type_hints(record).items()])
