"""Product codes of vectors by Lloyd rounds that compare active entries only.

A vector's components become integers, floor(4096 * x), and are cut into equal
consecutive parts. Each part position has a codebook, started from that part of
the vectors with the smallest ids. A round assigns every part to its nearest
entry and moves each used entry to the floor of its parts' mean. All arithmetic
is on whole numbers, so results are exact and do not depend on the partitioning.

Each row carries its codes and their exact distances from round to round. A part
whose entry did not move is compared with the moved entries only, against the
stored distance; it changes to a nearer entry, or to an equally near one of lower
index. A part whose entry moved is compared with all entries. Once few entries
move, a round costs little more than reading the rows.

A round is one pass without shuffle that writes the rows' new state to a stored
table, and one aggregation whose tasks send a sum per part, entry and position.
The driver holds the codebooks only (16 entries of a vector's length each).

Defined results: a vector that is null, or holds a null, a NaN, an infinity or a
component outside -32768 to 32768 (its squared distances would not fit whole
numbers of 64 bits), is dropped. So is an empty one, and one whose length differs
from that of the smallest id with a length that can be cut. Rows without id are
coded but start no entry; of several rows with one id the least vector starts the
entry. Fewer ids than entries make fewer entries, which may be equal; without any
id, codes and errors are null. Rows without label form one group. A sum of errors
beyond 64 bits is null. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import discard, stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LARGEST = 32768
STATE = "vec_id long, label string, ints binary, codes binary, dists binary"


def whole_numbers(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """``vec_id, label, ints`` (array of int) of the vectors that can be coded."""
    def usable(x):
        # Comparisons with a null are null, and a NaN is larger than any number.
        return F.coalesce((x > -LARGEST) & (x < LARGEST), F.lit(False))

    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v")).filter(
        F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0) & F.forall("v", usable))
    first = kept.agg(F.min_by(F.size("v"), F.coalesce("vec_id", F.lit((1 << 63) - 1)))).first()[0]
    return kept.filter(F.size("v") == F.lit(first)).select(
        "vec_id", F.col("label").cast("string").alias("label"), F.transform("v", lambda x: F.floor(x * SCALE).cast("int")).alias("ints"))


def first_books(numbers: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The codebooks at the start: an array of part, entry, position."""
    known = numbers.filter(F.col("vec_id").isNotNull())
    ids = [r[0] for r in known.select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    if not ids:
        return np.empty((parts, 0, 0), np.int64)
    starts = known.filter(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("ints").alias("ints")).orderBy("vec_id").collect()
    table = np.array([r.ints for r in starts], np.int64)
    return np.ascontiguousarray(table.reshape(len(table), parts, -1).transpose(1, 0, 2))


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to the rows of ``book``."""
    out = np.empty((len(x), len(book)), np.int64)
    for k, entry in enumerate(book):
        gap = x - entry
        out[:, k] = np.einsum("ij,ij->i", gap, gap)
    return out


def assigned(x: np.ndarray, book: np.ndarray, moved: np.ndarray | None = None, code: np.ndarray | None = None,
             dist: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row of ``x`` and the squared distance; of equally near ones the lowest index.

    ``code`` and ``dist`` are those of the round before, ``moved`` tells the entries that changed since.
    """
    if moved is None:
        all_ = squares(x, book)
        code = all_.argmin(axis=1)
        return code, np.take_along_axis(all_, code[:, None], 1)[:, 0]
    if not moved.any():
        return code, dist
    code, dist = code.copy(), dist.copy()
    lost = np.flatnonzero(moved[code])
    fixed = np.flatnonzero(~moved[code])
    active = np.flatnonzero(moved)
    if len(fixed):
        some = squares(x[fixed], book[active])
        best = some.argmin(axis=1)
        near = some[np.arange(len(fixed)), best]
        entry = active[best]
        better = (near < dist[fixed]) | ((near == dist[fixed]) & (entry < code[fixed]))
        code[fixed[better]], dist[fixed[better]] = entry[better], near[better]
    if len(lost):
        code[lost], dist[lost] = assigned(x[lost], book)
    return code, dist


def _numbers(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _round(books: np.ndarray, moved: np.ndarray | None):
    """The function that gives each row its new codes and distances."""
    parts, _, length = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = _numbers(batch.column(2), np.int32, parts * length).reshape(rows, parts, length).astype(np.int64)
            codes, dists = np.zeros((rows, parts), np.uint8), np.zeros((rows, parts), np.int64)
            if moved is not None:
                codes, dists = _numbers(batch.column(3), np.uint8, parts).copy(), _numbers(batch.column(4), np.int64, parts).copy()
            for p in range(parts):
                state = () if moved is None else (moved[p], codes[:, p].astype(np.intp), dists[:, p])
                codes[:, p], dists[:, p] = assigned(np.ascontiguousarray(x[:, p]), books[p], *state)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(i) for i in range(3)), pa.array([c.tobytes() for c in codes], pa.binary()),
                pa.array([d.tobytes() for d in dists], pa.binary())], names=["vec_id", "label", "ints", "codes", "dists"])
    return run


def _sums(shape: tuple[int, int, int]):
    """The function that adds up the parts of each entry within a task."""
    parts, entries, length = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _numbers(batch.column(0), np.int32, parts * length).reshape(-1, parts, length)
            codes = _numbers(batch.column(1), np.uint8, parts)
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=entries)
                for k in np.flatnonzero(count[p]):
                    total[p, k] += x[codes[:, p] == k, p].sum(axis=0, dtype=np.int64)
        used = np.argwhere(count > 0)
        if len(used):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(used[:, 0], length)), pa.array(np.repeat(used[:, 1], length)), pa.array(np.tile(np.arange(length), len(used))),
                pa.array(np.concatenate([total[p, k] for p, k in used])), pa.array(np.repeat([count[p, k] for p, k in used], length))],
                names=["part", "entry", "place", "total", "n"])
    return run


def moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after every used entry went to the floor of its parts' mean."""
    sums = state.select("ints", "codes").mapInArrow(_sums(books.shape), "part long, entry long, place long, total long, n long")
    out = books.copy()
    for r in sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        out[r.part, r.entry, r.place] = int(r.total) // r.n
    return out


def encoded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, codes, dists`` per vector (binary: a byte and a 64-bit number per part), and the final codebooks."""
    spark = vectors.sparkSession
    numbers = whole_numbers(vectors, parts)
    books = first_books(numbers, parts, entries)
    if not books.shape[1]:
        empty = numbers.select("vec_id", "label", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("dists"))
        return empty, books

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = np.asarray(batch.column(2).flatten(), np.int32).reshape(batch.num_rows, -1)
            none = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in ints], pa.binary()), none, none],
                                             names=["vec_id", "label", "ints", "codes", "dists"])

    state = stored(numbers.mapInArrow(packed, STATE), "vectors")
    moved = None
    for _ in range(rounds):
        before, state = state, stored(state.mapInArrow(_round(books, moved), STATE), "codes")
        discard(before)
        last, books = books, moved_books(state, books)
        moved = (books != last).any(axis=2)
    before, state = state, stored(state.mapInArrow(_round(books, moved), STATE), "codes")
    discard(before)
    return state.select("vec_id", "label", "codes", "dists"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        errors = [None if d is None else int(np.frombuffer(d, np.int64).sum()) for d in batch.column(3).to_pylist()]
        codes = [None if c is None else c.hex() for c in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                                         names=["vec_id", "label", "code", "error"])


def coded(vectors: DataFrame) -> DataFrame:
    """Per vector ``vec_id, code, error, label_error, codebooks_sha256``."""
    state, books = encoded(vectors)
    rows = stored(state.mapInArrow(_errors, "vec_id long, label string, code string, error long"), "errors")
    labels = rows.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return rows.join(labels, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same in DuckDB, every part compared with all entries in every round."""
    steps = ["""kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             """cut AS MATERIALIZED (SELECT row, vec_id, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS x FROM kept, range(8) AS t(p))""",
             """book0 AS MATERIALIZED (
  SELECT p, k - 1 AS k, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS k FROM cut) WHERE k <= 16)"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT row, p, any_value(x) AS x, min(struct_pack(d := d, k := k)) AS best
  FROM (SELECT row, c.p, c.x, k, list_sum(list_transform(list_zip(c.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d
        FROM cut c JOIN book{r} b ON c.p = b.p)
  GROUP BY row, p)""")
        if r < ROUNDS:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
  WITH sums AS (
    SELECT p, k, i, sum(y) AS s, count(*) AS n
    FROM (SELECT p, best.k AS k, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM near{r}) GROUP BY p, k, i),
  means AS (SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM sums GROUP BY p, k)
  SELECT b.p, b.k, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN means m ON b.p = m.p AND b.k = m.k)""")
    steps.append(f"""coded AS (
  SELECT row, string_agg(format('{{:02x}}', best.k), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY row)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (row)"""


ORACLE = _oracle()
