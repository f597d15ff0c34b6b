"""Recursive splitting: the largest natural boundary that keeps a chunk within its size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators.chunking import check_overlap, explode_chunks, register_chunker

# Boundaries from the strongest to the weakest.
SEPARATORS = ("\n\n", "\n", " ")
# A row holds less than 2^31 characters, so this many halvings leave at most one.
_HALVINGS = 31

Measure = Callable[[Column], Column]


def _sized(part: Column, measure: Measure) -> Column:
    return F.struct(part.alias("part"), measure(part).cast("long").alias("n"))


def pieces(text: Column, size: int, measure: Measure = tx.token_count) -> Column:
    """``array<struct<part, n>>``: consecutive slices within ``size``; joined they give the text back.

    A slice that is too long is cut before each separator, level by level, and at last in halves.
    """
    def too_long(p: Column) -> Column:
        return (p["n"] > size) & (F.char_length(p["part"]) > 1)

    def each(parts: Column, cut: Callable[[Column], Column]) -> Column:
        # Parts that fit are kept; nothing is done where all fit.
        return F.when(F.exists(parts, too_long), F.flatten(F.transform(
            parts, lambda p: F.when(too_long(p), cut(p["part"])).otherwise(F.array(p))))).otherwise(parts)

    def before(mark: str) -> Callable[[Column], Column]:
        return lambda part: F.transform(F.filter(F.split(part, f"(?={mark})", -1), lambda x: x != ""), lambda x: _sized(x, measure))

    def halves(part: Column) -> Column:
        length = F.char_length(part)
        middle = F.floor(length / 2).cast("int")
        return F.array(_sized(F.substr(part, F.lit(1), middle), measure), _sized(F.substr(part, middle + 1, length), measure))

    def at_level(mark: str) -> Callable[[Column], Column]:
        return lambda parts: each(parts, before(mark))

    found = F.array(_sized(text, measure))
    for mark in SEPARATORS:
        found = tx.let(found, at_level(mark))
    return tx.let(found, lambda parts: F.when(F.exists(parts, too_long), F.aggregate(
        F.sequence(F.lit(1), F.lit(_HALVINGS)), parts, lambda acc, _: each(acc, halves))).otherwise(parts))


def merged(parts: Column, size: int, overlap: int) -> Column:
    """``array<struct<first, last>>``: the ranges of pieces (from 1, both included) that make the chunks.

    One fold over the pieces holds where the held pieces start, their size, and whether
    any of them is new and not blank. A piece that does not fit closes the chunk; as many
    of the last pieces stay held as fit into ``overlap`` and beside the new one.
    """
    def state(start: Column, total: Column, fresh: Column, out: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), total.cast("long").alias("total"), fresh.alias("fresh"), out.alias("out"))

    def closed(acc: Column, end: Column) -> Column:
        chunk = F.struct((acc["start"] + 1).alias("first"), end.cast("int").alias("last"))
        return F.when(acc["fresh"], F.concat(acc["out"], F.array(chunk))).otherwise(acc["out"])

    def step(acc: Column, i: Column) -> Column:
        n = F.get(parts, i)["n"]

        def stays(tail: Column, p: Column) -> Column:
            fits = tail["open"] & (tail["sum"] + p["n"] <= F.least(F.lit(overlap), size - n))
            return F.struct(F.when(fits, tail["sum"] + p["n"]).otherwise(tail["sum"]).alias("sum"),
                            F.when(fits, tail["count"] + 1).otherwise(tail["count"]).alias("count"), fits.alias("open"))

        held = F.aggregate(F.reverse(F.slice(parts, acc["start"] + 1, i - acc["start"])),
                           F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("count"), F.lit(True).alias("open")), stays)
        after = tx.let(held, lambda t: state(i - t["count"], t["sum"] + n, n > 0, closed(acc, i)))
        fits = (acc["start"] == i) | (acc["total"] + n <= size)
        return F.when(fits, state(acc["start"], acc["total"] + n, acc["fresh"] | (n > 0), acc["out"])).otherwise(after)

    none = F.array().cast("array<struct<first:int,last:int>>")
    folded = F.aggregate(F.sequence(F.lit(0), F.size(parts) - 1), state(F.lit(0), F.lit(0), F.lit(False), none), step,
                         lambda acc: closed(acc, F.size(parts)))
    return F.when(F.size(parts) > 0, folded).otherwise(none)


def split_text(text: Column, size: int, overlap: int, measure: Measure = tx.token_count) -> Column:
    """Chunks of at most ``size`` by ``measure`` (an expression of a text: its words by default), neighbours sharing up to ``overlap`` of whole pieces.

    ``measure`` has to be 0 for blank text alone.
    """
    return tx.let(pieces(text, size, measure), lambda parts: F.transform(merged(parts, size, overlap), lambda c: tx.strip(F.array_join(
        F.transform(F.slice(parts, c["first"], c["last"] - c["first"] + 1), lambda p: p["part"]), ""))))


def chunk_recursive(df: DataFrame, text: str, size: int, overlap: int, keep: list[str], measure: Measure = tx.token_count) -> DataFrame:
    """Chunk rows of ``split_text``; a document's pieces and chunks are arrays of its row, nothing is shuffled."""
    check_overlap(size, overlap)
    return explode_chunks(df, split_text(F.col(text), size, overlap, measure), keep)


register_chunker("recursive", lambda df, text, keep, size=512, overlap=256:
                 chunk_recursive(df, text, size, overlap, keep))
