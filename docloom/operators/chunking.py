"""Chunkers that Spark expressions can say: windows, paragraphs, sentences, headings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx

# Embedding model names and their context windows in tokens.
MODEL_WINDOWS: dict[str, int] = {
    "gte-large-en-v1.5": 8192,
    "gte_large_en_v1_5": 8192,
    "bge-large-en-v1.5": 512,
    "bge_large_en_v1_5": 512,
    "text-embedding-ada-002": 8192,
    "text-embedding-3-small": 8192,
    "text-embedding-3-large": 8192,
}


def check_overlap(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"need 0 <= overlap < size, got size {size}, overlap {overlap}")


def n_windows(n: Column, size: int, overlap: int) -> Column:
    """Windows over ``n`` units: enough that the last one ends at the last unit."""
    step = size - overlap
    count = F.greatest(F.ceil((n - overlap) / F.lit(float(step))).cast("long"), F.lit(1))
    return F.when(n > 0, count).otherwise(0)


def _windows(n: Column, size: int, overlap: int, piece: Callable[[Column], Column]) -> Column:
    count = n_windows(n, size, overlap)
    starts = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<long>"))
    return F.transform(starts, lambda i: piece((i * (size - overlap) + 1).cast("int")))


def token_windows(text: Column, size: int, overlap: int) -> Column:
    """Array of chunks of ``size`` tokens, each repeating the last ``overlap`` of the one before."""
    return tx.let(tx.tokens(text), lambda toks: windows_of_tokens(toks, size, overlap))


def windows_of_tokens(toks: Column, size: int, overlap: int) -> Column:
    check_overlap(size, overlap)
    return _windows(F.size(toks).cast("long"), size, overlap, lambda start: F.array_join(F.slice(toks, start, size), " "))


def char_windows(text: Column, size: int, overlap: int) -> Column:
    check_overlap(size, overlap)
    return _windows(F.char_length(text).cast("long"), size, overlap, lambda start: F.substr(text, start, F.lit(size)))


def explode_chunks(df: DataFrame, chunks: Column, keep: list[str]) -> DataFrame:
    """One row per chunk: ``chunk_id, chunk_pos, chunked_text`` and the kept document columns.

    The kept columns travel with the array, so no join brings them back.
    """
    exploded = df.select(*keep, F.posexplode(chunks).alias("chunk_pos", "chunked_text"))
    return exploded.select(tx.chunk_id(F.col("chunked_text")).alias("chunk_id"), *keep, "chunk_pos", "chunked_text")


def chunk_tokens(df: DataFrame, text: str, size: int, overlap: int, keep: list[str]) -> DataFrame:
    return explode_chunks(df, token_windows(F.col(text), size, overlap), keep)


def chunk_chars(df: DataFrame, text: str, size: int, overlap: int, keep: list[str]) -> DataFrame:
    return explode_chunks(df, char_windows(F.col(text), size, overlap), keep)


def chunk_paragraphs(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return explode_chunks(df, tx.paragraphs(F.col(text)), keep)


def chunk_sentences(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return explode_chunks(df, tx.sentences(F.col(text)), keep)


def markdown_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sections between headings of levels 1-3, with the headings in force.

    ``key, section, h1, h2, h3, body``. A heading ends the lower-level headings
    before it. Sections without any text are left out.

    One fold over a document's sections carries the headings; a document stays one row until
    its sections are listed, so nothing is shuffled.
    """
    head = r"^(#{1,3}) ([^\n]*)"
    level = lambda part: F.length(F.regexp_extract(part, head, 1))
    sized = F.transform(F.split(F.col(text), r"\n(?=#{1,3} )", -1), lambda p, i: F.struct(
        i.alias("section"), level(p).alias("level"), tx.strip(F.regexp_extract(p, head, 2)).alias("title"),
        tx.strip(F.when(level(p) > 0, F.regexp_replace(p, r"^[^\n]*", "")).otherwise(p)).alias("body")))
    none = F.lit(None).cast("string")
    start = F.struct(*(none.alias(h) for h in ("h1", "h2", "h3")),
                     F.array().cast("array<struct<section:int,h1:string,h2:string,h3:string,body:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        at = p["level"]
        heads = F.struct(
            F.when(at == 1, p["title"]).otherwise(acc["h1"]).alias("h1"),
            F.when(at == 2, p["title"]).when(at == 1, none).otherwise(acc["h2"]).alias("h2"),
            F.when(at == 3, p["title"]).when(at.isin(1, 2), none).otherwise(acc["h3"]).alias("h3"))

        def carried(h: Column) -> Column:
            row = F.struct(p["section"].alias("section"), h["h1"].alias("h1"), h["h2"].alias("h2"), h["h3"].alias("h3"), p["body"].alias("body"))
            out = F.when(p["body"] != "", F.concat(acc["out"], F.array(row))).otherwise(acc["out"])
            return F.struct(h["h1"].alias("h1"), h["h2"].alias("h2"), h["h3"].alias("h3"), out.alias("out"))

        return tx.let(heads, carried)

    listed = F.aggregate(sized, start, step, lambda acc: acc["out"])
    return df.select(key, F.inline(listed))


def chunk_markdown(df: DataFrame, key: str, text: str, include_headers: bool = True) -> DataFrame:
    """One chunk per section, its headings put before the text once each if wanted."""
    sections = markdown_sections(df, key, text)
    chunk = F.concat_ws("\n", "h1", "h2", "h3", "body") if include_headers else F.col("body")
    return sections.select(tx.chunk_id(chunk).alias("chunk_id"), key, "section", chunk.alias("chunked_text"))


def metadata_keys(df: DataFrame, contents: str = "doc_parsed_contents", most: int = 10_000) -> list[str]:
    """Distinct keys of the metadata map: the names, never the values, come to the driver.

    More than ``most`` names cannot be columns; the map column holds them as they are.
    """
    found = df.select(F.explode(F.map_keys(contents)).alias("k")).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} metadata keys: use the map column, or name the keys wanted")
    return sorted(row["k"] for row in found)


def metadata_columns(df: DataFrame, contents: str = "doc_parsed_contents", keep_body: bool = False,
                     keys: list[str] | None = None) -> DataFrame:
    """A column per metadata key; the map stays, so keys that arrive later are not lost."""
    names = metadata_keys(df, contents) if keys is None else keys
    return df.withColumns({k: F.try_element_at(F.col(contents), F.lit(k)) for k in names
                           if keep_body or k != "parsed_content"})


def prefix_metadata(chunks: DataFrame, columns: list[str], text: str = "chunked_text") -> DataFrame:
    """Adds ``prefixed_text``: the given metadata on a line each, then the chunk."""
    return chunks.withColumn("prefixed_text", F.concat_ws("\n", *columns, text))


def dedup_chunks(chunks: DataFrame, uri: str, position: str = "chunk_pos") -> DataFrame:
    """One row per chunk id: its text, first place and number of copies.

    The copies of one text may be most of the table, so they are counted and
    reduced before the shuffle and never gathered in a list; ``chunk_sources``
    lists them as rows.
    """
    return chunks.groupBy("chunk_id").agg(
        F.first("chunked_text").alias("chunked_text"),
        F.min(F.struct(F.col(uri), F.col(position))).alias("_first"),
        F.count(F.lit(1)).alias("n_copies"),
    ).select("chunk_id", "chunked_text", F.col(f"_first.{uri}").alias(uri),
             F.col(f"_first.{position}").alias(position), "n_copies")


def chunk_sources(chunks: DataFrame, uri: str, position: str = "chunk_pos") -> DataFrame:
    return chunks.select("chunk_id", uri, position)


def model_rows(windows: dict[str, int] | None = None) -> Column:
    """The model table as an array, to explode next to each row instead of a join."""
    return F.array(*[F.struct(F.lit(m).alias("model"), F.lit(w).alias("context_window"))
                     for m, w in (windows or MODEL_WINDOWS).items()])


def spec_problem(size: Column, overlap: Column, window: Column) -> Column:
    """Why a chunk size does not suit a model; null when it does."""
    return (
        F.when(size + overlap > window, "size plus overlap exceeds the context window")
        .when(overlap > size, "overlap exceeds size")
    )


def check_chunk_spec(size: int, overlap: int, model: str) -> float:
    """Share of the model's window a chunk uses, in percent; raises when the sizes do not fit."""
    if model not in MODEL_WINDOWS:
        raise ValueError(f"unknown embedding model {model!r}, known: {sorted(MODEL_WINDOWS)}")
    window = MODEL_WINDOWS[model]
    if size + overlap > window:
        raise ValueError(f"chunk size {size} plus overlap {overlap} exceeds the {window} tokens of {model}")
    if overlap > size:
        raise ValueError(f"overlap {overlap} exceeds chunk size {size}")
    return round((size + overlap) / window * 100, 2)


def chunk_fit(chunks: DataFrame, text: str = "chunked_text", windows: dict[str, int] | None = None) -> DataFrame:
    """Per model: chunks, the largest in tokens, and those the model would cut."""
    sized = chunks.select(tx.token_count(F.col(text)).alias("n"))
    paired = sized.select("n", F.explode(model_rows(windows)).alias("m")).select("n", "m.*")
    return paired.groupBy("model", "context_window").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.max("n").alias("max_tokens"),
        F.count_if(F.col("n") > F.col("context_window")).alias("n_cut"),
        F.round(F.avg(F.col("n") / F.col("context_window")) * 100, 4).alias("avg_window_percent"))


def chunk_stats(chunks: DataFrame, keys: list[str], text: str = "chunked_text") -> DataFrame:
    n = tx.token_count(F.col(text))
    return chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"),
        F.sum(n).alias("total_tokens"), F.round(F.avg(n), 6).alias("avg_tokens"))


def _markdown(df: DataFrame, text: str, keep: list[str], include_headers: bool = True) -> DataFrame:
    chunks = chunk_markdown(df.select(F.struct(*keep).alias("_doc"), text), "_doc", text, include_headers)
    return chunks.select("chunk_id", *[F.col("_doc").getField(k).alias(k) for k in keep], F.col("section").alias("chunk_pos"), "chunked_text")


# A chunker maps (documents, text column, kept columns, **settings) to chunk rows.
_CHUNKERS: dict[str, Callable[..., DataFrame]] = {
    "window": lambda df, text, keep, size=512, overlap=256: chunk_tokens(df, text, size, overlap, keep),
    "chars": lambda df, text, keep, size=2000, overlap=500: chunk_chars(df, text, size, overlap, keep),
    "paragraph": lambda df, text, keep: chunk_paragraphs(df, text, keep),
    "sentence": lambda df, text, keep: chunk_sentences(df, text, keep),
    "markdown": _markdown,
}


def register_chunker(name: str, chunker: Callable[..., DataFrame]) -> None:
    _CHUNKERS[name] = chunker


def chunker_named(name: str) -> Callable[..., DataFrame]:
    if name not in _CHUNKERS:
        raise ValueError(f"unknown chunker {name!r}, known: {sorted(_CHUNKERS)}")
    return _CHUNKERS[name]


def chunk_by_name(name: str, df: DataFrame, text: str, keep: list[str], **settings) -> DataFrame:
    return chunker_named(name)(df, text, keep, **settings)


def without_chunk(docs: DataFrame, chunks: DataFrame, text: str, keep: list[str], key: str) -> DataFrame:
    """Documents of which ``chunks`` holds nothing, with the reason as ``chunker_status``.

    Found from the chunks themselves, so it is right for every chunker: a text
    of white space only, or one that the chunker made nothing of.
    """
    blank = ~F.coalesce(F.rlike(text, F.lit(r"\S")), F.lit(False))
    reason = F.when(blank, "ERROR: no text").otherwise("ERROR: no chunk")
    cut = chunks.select(F.col(key).alias("_cut")).distinct()
    return docs.select(*keep, reason.alias("chunker_status")).join(cut, F.col(key).eqNullSafe(F.col("_cut")), "left_anti")
