"""Text encoders and the column they fill."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from hashlib import md5
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as tx
from docloom.functions.vectors import l2_normalize, norm

DIMENSION = 256
# Texts given to an encoder at a time.
_BATCH = 1024
_GAP = re.compile("[ \t\n\x0b\f\r]+")


class Encoder(Protocol):
    def encode(self, texts: Sequence[str]) -> tuple[list, list[str]]:
        """Vectors in the order of the texts (None where it failed) and a status for each."""


class HashingEncoder:
    """Signed feature hashing of tokens into 256 buckets, scaled to unit length.

    A token's md5 gives its bucket by the first two hex digits and its sign by
    the third. Needs no model and gives the same vector everywhere.
    """

    def __init__(self, max_cached_tokens: int = 500_000):
        self._slots: dict[str, tuple[int, float]] = {}
        self._max = max_cached_tokens

    def _slot(self, token: str) -> tuple[int, float]:
        slot = self._slots.get(token)
        if slot is None:
            digest = md5(token.encode()).hexdigest()
            slot = int(digest[:2], 16), 1.0 if int(digest[2], 16) < 8 else -1.0
            if len(self._slots) < self._max:
                self._slots[token] = slot
        return slot

    def counts(self, texts: Sequence[str]) -> np.ndarray:
        """Signed token counts, a row per text."""
        slots, lengths = [], []
        for text in texts:
            found = [self._slot(t) for t in _GAP.split(text) if t] if text else []
            slots.extend(found)
            lengths.append(len(found))
        if not slots:
            return np.zeros((len(texts), DIMENSION))
        buckets, signs = np.array(slots).T
        cells = np.repeat(np.arange(len(texts)), lengths) * DIMENSION + buckets.astype(np.int64)
        return np.bincount(cells, signs, len(texts) * DIMENSION).reshape(len(texts), DIMENSION)

    def encode(self, texts: Sequence[str]) -> tuple[list, list[str]]:
        rows = self.counts(texts)
        lengths = np.sqrt((rows * rows).sum(axis=1))
        good = lengths > 0
        rows[good] /= lengths[good, None]
        vectors = [row if ok else None for row, ok in zip(rows, good)]
        return vectors, ["SUCCESS" if ok else "ERROR: no direction" for ok in good]


class RemoteEncoder:
    """Wraps a call that embeds one text; keeps order, retries, and reports per item.

    At most ``concurrency`` calls are in flight per partition, so the whole job
    has at most partitions x concurrency.
    """

    # The limits of the embedding calls.
    CONCURRENCY = 20
    RETRIES = 5

    def __init__(self, call: Callable[[str], Sequence[float]], concurrency: int = CONCURRENCY, retries: int = RETRIES):
        self._call, self._concurrency, self._retries = call, concurrency, retries

    def _one(self, text: str) -> tuple[Sequence[float] | None, str]:
        problem: Exception | None = None
        for _ in range(self._retries):
            try:
                return self._call(text), "SUCCESS"
            except Exception as e:
                problem = e
        return None, f"ERROR: {problem}"

    def encode(self, texts: Sequence[str]) -> tuple[list, list[str]]:
        with ThreadPoolExecutor(self._concurrency) as pool:
            results = list(pool.map(self._one, texts))
        return [v for v, _ in results], [s for _, s in results]


_ENCODERS: dict[str, Callable[[], Encoder]] = {"hashing": HashingEncoder}


def register_encoder(name: str, factory: Callable[[], Encoder]) -> None:
    _ENCODERS[name] = factory


def encoder_factory(name: str) -> Callable[[], Encoder]:
    if name not in _ENCODERS:
        raise ValueError(f"unknown encoder {name!r}, known: {sorted(_ENCODERS)}")
    return _ENCODERS[name]


def embed(df: DataFrame, text: str, out: str = "embedding",
          factory: Callable[[], Encoder] = HashingEncoder, only: str | None = None) -> DataFrame:
    """Adds ``out array<double>`` and ``<out>_status``; one encoder per partition, no shuffle.

    With ``only``, a boolean column, other rows are not given to the encoder and get nulls.
    """
    schema = T.StructType(df.schema.fields + [
        T.StructField(out, T.ArrayType(T.DoubleType())), T.StructField(f"{out}_status", T.StringType())])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = factory()
        for frame in frames:
            for at in range(0, len(frame), _BATCH):
                part = frame.iloc[at:at + _BATCH]
                chosen = np.flatnonzero(part[only].to_numpy(dtype=bool)) if only else np.arange(len(part))
                encoded, reported = encoder.encode([part[text].iloc[i] for i in chosen])
                vectors, statuses = ([None] * len(part) for _ in range(2))
                for i, vector, status in zip(chosen, encoded, reported):
                    vectors[i], statuses[i] = vector, status
                yield part.assign(**{out: pd.Series(vectors, index=part.index, dtype=object),
                                     f"{out}_status": pd.Series(statuses, index=part.index, dtype=object)})

    return df.mapInPandas(batches, schema)


def _half_buckets(text: Column) -> Column:
    """Bucket and sign of each token as one number: the first three hex digits of its md5, without the last three bits."""
    return F.transform(tx.tokens(text), lambda t: F.shiftright(F.conv(F.substring(F.md5(t), 1, 3), 16, 10).cast("int"), 3))


def hashed_counts(text: Column) -> Column:
    """The signed token counts of ``HashingEncoder`` as an expression: 256 numbers, without Python.

    Sorted behind one mark for each half bucket, the marks' distances are the counts.
    """
    halves = 2 * DIMENSION
    # ``sort_array`` sorts plain numbers; ``array_sort`` would evaluate a comparison for each step.
    marked = F.sort_array(F.concat(_half_buckets(text), F.sequence(F.lit(0), F.lit(halves - 1))))

    def counts(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return tx.let(F.concat(starts, F.array(n)), lambda at: F.transform(
            F.sequence(F.lit(0), F.lit(DIMENSION - 1)),
            lambda b: (2 * F.get(at, 2 * b + 1) - F.get(at, 2 * b) - F.get(at, 2 * b + 2)).cast("double")))

    return tx.let(marked, counts)


def sparse_counts(text: Column) -> Column:
    """The numbers of ``hashed_counts`` for a short text: ``buckets`` that have tokens, their ``counts`` and the ``norm`` of all."""
    def counted(own: Column) -> Column:
        # What is left without the one sign less what is left without the other.
        counts = tx.let(F.array_distinct(F.transform(own, lambda h: F.shiftright(h, 1))), lambda buckets: F.struct(
            buckets.alias("buckets"), F.transform(buckets, lambda b: (
                F.size(F.array_remove(own, 2 * b + 1)) - F.size(F.array_remove(own, 2 * b))).cast("double")).alias("counts")))
        return tx.let(counts, lambda c: F.struct(c["buckets"].alias("buckets"), c["counts"].alias("counts"), norm(c["counts"]).alias("norm")))

    return tx.let(_half_buckets(text), counted)


def shared_counts(left: Column, right: Column) -> Column:
    """Dot product of two ``sparse_counts``."""
    products = F.zip_with(left["buckets"], left["counts"], lambda b, n: n * F.coalesce(
        F.get(right["counts"], F.array_position(right["buckets"], b).cast("int") - 1), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def embed_hashing(df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
    """Adds ``out`` and ``<out>_status`` as ``embed`` with the hashing encoder does, within the JVM.

    The vector comes out of a one-row list: a filter on it stays above, and does not work it out again.
    """
    vector = tx.let(hashed_counts(F.coalesce(F.col(text), F.lit(""))), l2_normalize)
    found = df.select(*[c for c in df.columns if c != out], F.inline(F.array(F.struct(vector.alias(out)))))
    return found.withColumn(f"{out}_status", F.when(F.col(out).isNull(), "ERROR: no direction").otherwise("SUCCESS"))


def embedding_report(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows, missing vectors, dimensions and norm spread."""
    n = norm(F.col(vector))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(vector).isNull()).alias("n_null"),
        F.min(F.size(vector)).cast("long").alias("min_dim"),
        F.max(F.size(vector)).cast("long").alias("max_dim"),
        F.count_if(n == 0).alias("n_zero"),
        F.round(F.min(n), 6).alias("min_norm"),
        F.round(F.max(n), 6).alias("max_norm"),
        F.round(F.avg(n), 6).alias("avg_norm"))
