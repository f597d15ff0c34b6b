"""Semantic chunking: cut where neighbouring sentences drift apart.

A document stays one row throughout: its sentences, token counts, gaps and
groups are arrays of that row, so no step shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators.chunking import explode_chunks, register_chunker
from docloom.operators.encoding import Encoder, shared_counts, sparse_counts

# The defaults of the semantic chunker.
MAX_CHUNK_SIZE = 512
SPLIT_PERCENTILE = 0.95
MIN_SENTENCES = 3

# A row holds less than 2^31 characters, so this many halvings leave at most one.
_HALVINGS = 31


def _sized(part: Column) -> Column:
    return F.struct(part.alias("part"), tx.token_count(part).alias("n"))


def halve_long(sentence: Column, max_tokens: int) -> Column:
    """``array<struct<part, n>>``: the sentence halved at its middle character until each part fits."""
    def halves(p: Column) -> Column:
        length = F.char_length(p["part"])
        mid = F.floor(length / 2).cast("int")
        both = F.array(_sized(F.substr(p["part"], F.lit(1), mid)), _sized(F.substr(p["part"], mid + 1, length)))
        return F.when(p["n"] > max_tokens, both).otherwise(F.array(p))

    def halved(parts: Column, _: Column) -> Column:
        long = F.exists(parts, lambda p: p["n"] > max_tokens)
        return F.when(long, F.flatten(F.transform(parts, halves))).otherwise(parts)

    return tx.let(_sized(sentence), lambda p: F.when(
        p["n"] > max_tokens, F.aggregate(F.sequence(F.lit(1), F.lit(_HALVINGS)), F.array(p), halved)).otherwise(F.array(p)))


def fitting_sentences(text: Column, max_tokens: int) -> Column:
    """Sentences as ``array<struct<part, n>>``, ``n`` being the token count."""
    return F.flatten(F.transform(tx.sentences(text), lambda s: halve_long(s, max_tokens)))


def _gaps(texts: list[str], encoder: Encoder) -> np.ndarray:
    gaps = np.ones(len(texts))
    vectors, _ = encoder.encode(texts)
    known = np.array([v is not None for v in vectors])
    if known.any():
        dim = len(next(v for v in vectors if v is not None))
        rows = np.stack([np.asarray(v, dtype=float) if v is not None else np.zeros(dim) for v in vectors])
        lengths = np.sqrt((rows * rows).sum(axis=1))
        dots = (rows[:-1] * rows[1:]).sum(axis=1)
        both = known[:-1] & known[1:]
        gaps[:-1][both] = 1.0 - dots[both] / (lengths[:-1] * lengths[1:])[both]
    gaps[-1] = 0.0
    # Rounded, so that equal gaps compare equal whatever the order of summation.
    return np.round(gaps, 9) + 0.0


def neighbour_distances(sentences: Column, factory: Callable[[], Encoder] | None = None) -> Column:
    """Cosine distance of each sentence to the next one; 0 for the last.

    A sentence without a vector is at distance 1 from its neighbours. Without a ``factory``,
    sentences are hashed within the JVM; with one, an encoder of it runs in each task.
    """
    if factory is None:
        def pairs(vectors: Column) -> Column:
            last = F.size(vectors) - 1
            # Signed counts are whole numbers: products and sums are exact.
            return F.transform(vectors, lambda v, i: F.when(i == last, 0.0).otherwise(F.round(F.lit(1.0) - F.coalesce(tx.let(
                F.get(vectors, i + 1), lambda w: F.try_divide(shared_counts(v, w), v["norm"] * w["norm"])), F.lit(0.0)), 9) + 0.0))

        return tx.let(F.transform(sentences, sparse_counts), pairs)

    @F.pandas_udf("array<double>")
    def distances(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = factory()
        for column in batches:
            yield pd.Series([_gaps(list(texts), encoder) if texts is not None and len(texts) else np.zeros(0)
                             for texts in column])

    # Marked so that a later filter is not moved below it, which would run it twice.
    return distances.asNondeterministic()(sentences)


def array_percentile(values: Column, fraction: float) -> Column:
    """Percentile of an array with linear interpolation; null for an empty one."""
    def at(ordered: Column) -> Column:
        rank = F.lit(float(fraction)) * (F.size(ordered) - 1)
        low = F.get(ordered, F.floor(rank).cast("int"))
        high = F.get(ordered, F.ceil(rank).cast("int"))
        return low + (high - low) * (rank - F.floor(rank))

    return F.when(F.size(values) > 0, tx.let(F.sort_array(values), at))


def segment(counts: Column, distances: Column, threshold: Column, max_tokens: int, min_sentences: int) -> Column:
    """Greedy groups of sentences as ``array<struct<start, len>>``, ``start`` from 1.

    A group ends when the next sentence would exceed ``max_tokens``, or when it
    holds a multiple of ``min_sentences`` and the gap to the next is above the threshold.
    One fold over the sentences holds the groups' starts, the last group's length and its tokens.
    """
    def state(starts: Column, length: Column, total: Column) -> Column:
        return F.struct(starts.alias("starts"), length.alias("len"), total.cast("long").alias("total"))

    def grouped(given: Column) -> Column:
        tokens, gaps = given["tokens"], given["gaps"]

        def step(acc: Column, i: Column) -> Column:
            n = F.get(tokens, i).cast("long")
            drifted = (acc["len"] % min_sentences == 0) & (F.get(gaps, i - 1) > given["limit"])
            joins = (acc["len"] > 0) & (acc["total"] + n <= max_tokens) & ~F.coalesce(drifted, F.lit(False))
            return F.when(joins, state(acc["starts"], acc["len"] + 1, acc["total"] + n)).otherwise(
                state(F.concat(acc["starts"], F.array(i + 1)), F.lit(1), n))

        start = state(F.array().cast("array<int>"), F.lit(0), F.lit(0))
        folded = F.aggregate(F.sequence(F.lit(0), F.size(tokens) - 1), start, step, lambda acc: acc["starts"])
        groups = tx.let(folded, lambda s: F.transform(s, lambda at, g: F.struct(
            at.alias("start"), (F.coalesce(F.get(s, g + 1), F.size(tokens) + 1) - at).alias("len"))))
        return F.when(F.size(tokens) > 0, groups).otherwise(F.array().cast("array<struct<start:int,len:int>>"))

    # Handed over at once: a column named within the fold would be computed again for every sentence.
    return tx.let(F.struct(counts.alias("tokens"), distances.alias("gaps"), F.coalesce(threshold, F.lit(0.0)).alias("limit")), grouped)


def semantic_groups(df: DataFrame, text: str, max_tokens: int = MAX_CHUNK_SIZE, fraction: float = SPLIT_PERCENTILE,
                    min_sentences: int = MIN_SENTENCES,
                    factory: Callable[[], Encoder] | None = None) -> DataFrame:
    """Adds the arrays ``sentences, token_counts, distances, groups`` and the ``threshold``."""
    def columns(**named: Column) -> Column:
        """The columns of a one-row list. A filter above stays above it: it would otherwise run the whole chain again for each use."""
        return F.inline(F.array(F.struct(*[c.alias(n) for n, c in named.items()])))

    staged = df.select("*", columns(_parts=fitting_sentences(F.col(text), max_tokens)))
    staged = staged.withColumns({"sentences": F.col("_parts.part"), "token_counts": F.col("_parts.n")}).drop("_parts")
    staged = staged.select("*", columns(distances=neighbour_distances(F.col("sentences"), factory)))
    between = F.slice(F.col("distances"), F.lit(1), F.greatest(F.size("distances") - 1, F.lit(0)))
    staged = staged.select("*", columns(threshold=array_percentile(between, fraction)))
    return staged.select("*", columns(groups=segment(
        F.col("token_counts"), F.col("distances"), F.col("threshold"), max_tokens, min_sentences)))


def chunk_semantic(df: DataFrame, text: str, keep: list[str], max_tokens: int = MAX_CHUNK_SIZE,
                   fraction: float = SPLIT_PERCENTILE, min_sentences: int = MIN_SENTENCES,
                   factory: Callable[[], Encoder] | None = None) -> DataFrame:
    """Chunk rows; a document with fewer than ``min_sentences`` gives its sentences as they are."""
    staged = semantic_groups(df, text, max_tokens, fraction, min_sentences, factory)
    grouped = tx.let(F.struct("groups", "sentences"), lambda s: F.transform(
        s["groups"], lambda g: F.array_join(F.slice(s["sentences"], g["start"], g["len"]), " ")))
    whole = tx.sentences(F.col(text))
    chunks = F.when(F.size(whole) < min_sentences, whole).otherwise(grouped)
    return explode_chunks(staged, chunks, keep)


register_chunker("semantic", chunk_semantic)
