"""Exact vector search over an index that is asked once: blocks of queries meet blocks of the index.

An index that is asked often is built as lists (``vector_index``), which rule out
most pairs where the vectors have any structure; here every pair is scored. Both
rank by the score itself and round only what they show.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Shown digits; scores that agree in ``TIE`` digits are ties, settled by id, as their sums may differ in the last bits.
DECIMALS, TIE = 6, 12
# Vectors of one side in a task.
BLOCK_BYTES = 32 * 1024 * 1024
# Below the k-th best by how much a product may lie and still be compared exactly.
SLACK = 1e-9
# Scores, and candidates, held at a time by one task.
_HELD = 1_000_000
# Queries scored, and pairs whose vectors are laid side by side, at a time.
_QUERIES, _PAIRS = 4096, 65_536


def list_matrix(vectors: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``dim`` finite numbers as a matrix, and which rows those are."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if dim == 0 or not len(vectors):
        return np.zeros((0, dim)), np.zeros(len(vectors), dtype=bool)
    good = pc.equal(pc.list_value_length(vectors), dim).fill_null(False).to_numpy(zero_copy_only=False).copy()
    rows = (vectors if good.all() else vectors.filter(pa.array(good))).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)
    finite = np.isfinite(rows).all(axis=1)
    if finite.all():
        return rows, good
    good[np.flatnonzero(good)[~finite]] = False
    return rows[finite], good


class Best:
    """The best k rows of each of n queries so far, and all that are within the slack of them."""

    def __init__(self, k: int, n: int):
        self.k, self.parts, self.held, self.unreduced = k, [], 0, 0
        # What a further row of a query has to reach: the k-th best when its rows were last reduced.
        self.floor = np.full(n, -np.inf)

    def add(self, scores: np.ndarray, row_numbers: np.ndarray, query_numbers: np.ndarray) -> None:
        """``scores`` has a row per index row and a column per query."""
        floor = self.floor[query_numbers]
        if len(scores) > self.k and not np.isfinite(floor).all():
            floor = np.maximum(floor, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        row, q = np.nonzero(scores >= floor - SLACK)
        self.parts.append((query_numbers[q], row_numbers[row], scores[row, q]))
        self.held += len(q)
        self.unreduced += len(q)
        # Twice what is kept anyway, so that many queries are not sorted again for every few rows.
        if self.unreduced > max(_HELD, self.held - self.unreduced):
            self._reduce()

    def _reduce(self) -> None:
        q, row, score = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        order = np.lexsort((-score, q))
        q, row, score = q[order], row[order], score[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.intp)
        sizes = np.diff(np.r_[first, len(q)])
        last = score[np.minimum(first + self.k, first + sizes) - 1]
        full = sizes >= self.k
        self.floor[q[first[full]]] = last[full]
        keep = score >= np.repeat(last, sizes) - SLACK
        self.parts, self.held, self.unreduced = [(q[keep], row[keep], score[keep])], int(keep.sum()), 0

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Query and row numbers."""
        if not self.parts:
            return np.empty(0, np.intp), np.empty(0, np.intp)
        self._reduce()
        return self.parts[0][:2]


def score_blocks(query_matrix: np.ndarray, rows: np.ndarray, row_numbers: np.ndarray, query_numbers: np.ndarray, best: Best) -> None:
    """Scores rows against queries, tile by tile."""
    for first in range(0, len(query_numbers), _QUERIES):
        who = query_numbers[first:first + _QUERIES]
        asked, step = query_matrix[who].T, max(1, _HELD // len(who))
        for at in range(0, len(row_numbers), step):
            part = row_numbers[at:at + step]
            best.add(rows[part] @ asked, part, who)


def exact_scores(query_matrix: np.ndarray, rows: np.ndarray, q: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The same product for the same two vectors, wherever they stand. Adding zero turns -0.0 into 0.0."""
    out = np.empty(len(q))
    for at in range(0, len(q), _PAIRS):
        out[at:at + _PAIRS] = np.einsum("ij,ij->i", query_matrix[q[at:at + _PAIRS]], rows[row[at:at + _PAIRS]])
    return out + 0.0


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with ``rank``; the score unrounded."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", TIE).desc(), F.asc("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def shown(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", DECIMALS) + 0.0)


def usable_queries(queries: DataFrame, vector: str = "embedding") -> DataFrame:
    asked = queries.select("query_id", F.col(vector).cast("array<double>").alias("embedding"))
    return asked.filter(F.col("embedding").isNotNull())


def blocks(df: DataFrame, vector: str = "embedding") -> int:
    """Blocks of bounded bytes that ``df`` makes."""
    return max(1, math.ceil((df.agg(F.sum(F.size(vector) * 8)).first()[0] or 0) / BLOCK_BYTES))


def hit_schema(asked: DataFrame, indexed: DataFrame, columns: list[str] | None = None) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("chunk_id", indexed.schema["chunk_id"].dataType),
        *[T.StructField(c, indexed.schema[c].dataType) for c in columns or []], T.StructField("score", T.DoubleType())])


def similarity_topk(queries: DataFrame, index: DataFrame, k: int, where: Column | None = None,
                    query_vector: str = "embedding", index_vector: str = "embedding") -> DataFrame:
    """``query_id, chunk_id, score, rank`` of the k highest dot products.

    ``queries`` holds ``query_id`` (unique) and a vector, ``index`` a ``chunk_id``
    and a vector; ``where`` filters the index before the search. Vectors that are
    null, hold a non-number or differ in size from the queries have no score.
    Every block of queries meets every block of the index, by equality on the
    pair of block numbers; a task sends k rows per query.
    """
    if where is not None:
        index = index.filter(where)
    asked = usable_queries(queries, query_vector)
    indexed = index.select("chunk_id", F.col(index_vector).cast("array<double>").alias("embedding"))
    q_blocks = blocks(asked)
    # At least a block for each core.
    i_blocks = max(blocks(indexed), indexed.sparkSession.sparkContext.defaultParallelism)

    def dealt(df: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        number = F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int")
        return df.select("*", number.alias(own), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    def meet(q: pa.Table, i: pa.Table) -> pa.Table:
        dim = len(q["embedding"][0]) if q.num_rows else 0
        query_matrix, good = list_matrix(q["embedding"], dim)
        rows, usable = list_matrix(i["embedding"], dim)
        best = Best(k, len(query_matrix))
        if len(rows) and len(query_matrix):
            score_blocks(query_matrix, rows, np.arange(len(rows)), np.arange(len(query_matrix)), best)
        at, row = best.pairs()
        return pa.table({"query_id": q["query_id"].filter(pa.array(good)).take(pa.array(at)),
                         "chunk_id": i["chunk_id"].filter(pa.array(usable)).take(pa.array(row)),
                         "score": exact_scores(query_matrix, rows, at, row)})

    left = dealt(asked, "query_id", "qb", q_blocks, "ib", i_blocks).groupBy("qb", "ib")
    right = dealt(indexed, "chunk_id", "ib", i_blocks, "qb", q_blocks).groupBy("qb", "ib")
    return shown(ranked(left.cogroup(right).applyInArrow(meet, hit_schema(asked, indexed)), k))
