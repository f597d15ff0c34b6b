"""A stored vector index: lists around centroids, built once and asked often, exactly or approximately.

Building trains unit-length centroids on a bounded sample, puts every vector
into the list of the centroid with the highest dot product, and stores the
vectors in folders by list, in blocks of bounded bytes, beside a small table of
the lists. A list keeps how far its vectors reach along its centroid and at most
away from that line.

Exact search has two passes. In the first every query scores its nearest lists,
which gives it a lower bound, its k-th best score so far. In the second it meets
only those lists that could hold a better one: with a query's part along a
centroid and its part across, no vector of the list scores more than the best of
along times along, plus across times across. Approximate search stops after the
first pass. What a query is sent to are blocks, so a list that holds most
vectors is many blocks, and small lists share one.

Vectors without structure, such as random directions in many dimensions, have no
lists that can be ruled out; the exact search then scores nearly all pairs, and
the approximate one needs most lists. ``cost`` tells the pairs scored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.scaling import input_files, shared_folder, stored
from docloom.operators.similarity import (
    BLOCK_BYTES, Best, blocks, exact_scores, hit_schema, list_matrix, ranked, score_blocks, shown, similarity_topk, usable_queries,
)

# Bounds of what the driver holds: lists, and vectors that centroids are trained on.
MAX_LISTS, SAMPLE_BYTES = 16_384, 32 * 1024 * 1024
TRAINING_ROUNDS = 12
# Lists of an exact search's first pass.
FIRST_LISTS = 3
# Queries whose lists are chosen at a time.
_SENT = 512


def train(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Unit-length centroids by rounds of nearest direction and mean; a list left empty restarts at the worst placed vector."""
    rng = np.random.default_rng(seed)
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    centroids = unit[rng.choice(len(unit), min(lists, len(unit)), replace=False)]
    for _ in range(TRAINING_ROUNDS):
        scores = unit @ centroids.T
        near = scores.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, unit)
        empty = np.setdiff1d(np.arange(len(centroids)), near)
        if len(empty):
            sums[empty] = unit[np.argsort(scores.max(axis=1), kind="stable")[:len(empty)]]
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(lengths > 1e-12, sums / np.maximum(lengths, 1e-12), centroids)
    return centroids


def _placing(centroids: np.ndarray):
    """Adds each vector's list, its part along the centroid and its distance from that line; drops vectors that cannot be scored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, good = list_matrix(batch.column("embedding"), centroids.shape[1])
            if not len(rows):
                continue
            scores = rows @ centroids.T
            near = scores.argmax(axis=1)
            along = scores[np.arange(len(rows)), near]
            across = np.sqrt(np.maximum((rows * rows).sum(axis=1) - along * along, 0))
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(near.astype(np.int32)), pa.array(along), pa.array(across)],
                                             names=[*kept.schema.names, "list_id", "along", "across"])
    return run


def build(index: DataFrame, path: str, lists: int | None = None, columns: list[str] | None = None, seed: int = 7) -> "VectorIndex":
    """Stores ``chunk_id``, ``embedding`` and further ``columns`` of ``index`` below ``path``.

    ``lists`` is the square root of the number of vectors by default, ``MAX_LISTS`` at most. The
    dimension is that of most vectors. Centroids are trained on the vectors with the smallest
    hashes of their ids, ``SAMPLE_BYTES`` of them at most; every usable vector is indexed.
    """
    spark = index.sparkSession
    rows = index.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"), *(columns or [])).filter(
        F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    # Counted, sampled and placed: vectors that are made of other columns are made once.
    rows = stored(rows, "vectors")
    sizes = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, n = (sizes["dim"], sizes["count"]) if sizes else (0, 0)
    wanted = min(MAX_LISTS, lists or max(1, math.isqrt(n)))
    most = max(1, SAMPLE_BYTES // (8 * max(dim, 1)))
    # A margin of hashes for the share, then a limit for the bound.
    share = F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < min(1 << 20, math.ceil(1.05 * most / max(n, 1) * (1 << 20)))
    sample = list_matrix(rows.filter((F.size("embedding") == dim) & share).select("embedding").limit(most).toArrow()["embedding"], dim)[0]
    centroids = train(sample, wanted, seed) if len(sample) else np.zeros((1, dim))
    schema = T.StructType([*rows.schema.fields, T.StructField("list_id", T.IntegerType()), T.StructField("along", T.DoubleType()),
                           T.StructField("across", T.DoubleType())])
    placed = stored(rows.mapInArrow(_placing(centroids), schema), "placed")
    found = {r["list_id"]: r for r in placed.groupBy("list_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("along").alias("low"), F.max("along").alias("high"), F.max("across").alias("across")).collect()}
    # Small lists share a block, a large one has several; no fewer blocks than cores where there are enough vectors.
    room = max(1, min(BLOCK_BYTES // (8 * max(dim, 1)), math.ceil(n / spark.sparkContext.defaultParallelism)))
    table, block, used = [], 0, 0
    for i, centroid in enumerate(centroids.tolist()):
        r = found.get(i)
        if r is None:
            continue
        if used and used + r["n"] > room:
            block, used = block + 1, 0
        parts = math.ceil(r["n"] / room)
        table.append((i, centroid, r["n"], r["low"], r["high"], r["across"], block, parts))
        block, used = (block, used + r["n"]) if parts == 1 else (block + parts, 0)
    stats = spark.createDataFrame(table, "list_id int, centroid array<double>, n long, low double, high double, across double, block int, parts int")
    blocked = placed.join(F.broadcast(stats.select("list_id", "block", "parts")), "list_id").withColumn(
        "block", (F.col("block") + F.pmod(F.xxhash64("chunk_id"), F.col("parts"))).cast("int"))
    dealt = blocked.drop("along", "across", "parts").repartition("list_id", "block")
    # Without any list there is no folder that could hold the schema.
    (dealt.write.partitionBy("list_id") if table else dealt.write).parquet(f"{path}/vectors")
    stats.coalesce(1).write.parquet(f"{path}/lists")
    return VectorIndex(spark, path)


class VectorIndex:
    """An index stored by ``build``. The driver holds the table of lists, ``MAX_LISTS`` rows at most."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.vectors = spark.read.parquet(f"{path}/vectors")
        table = spark.read.parquet(f"{path}/lists").orderBy("list_id").toPandas()
        self.list_ids = table["list_id"].to_numpy(np.int32)
        self.centroids = np.stack(table["centroid"]).astype(np.float64) if len(table) else np.zeros((0, 0))
        self.sizes, self.low, self.high, self.across, self.block, self.parts = (
            table[c].to_numpy() for c in ("n", "low", "high", "across", "block", "parts"))

    def __len__(self) -> int:
        return int(self.sizes.sum())

    def _sent(self, asked: DataFrame, probe: int, rest: bool) -> DataFrame:
        """``query_id, embedding, block, lists``: the ``probe`` nearest lists, or all others that the column ``floor`` does not rule out."""
        centroids, low, high, across, block, parts = self.centroids, self.low, self.high, self.across, self.block, self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # A few queries at a time, as each has a number per list and is sent to many blocks.
            for batch in (whole.slice(at, _SENT) for whole in batches for at in range(0, whole.num_rows, _SENT)):
                rows, good = list_matrix(batch.column("embedding"), centroids.shape[1])
                if not len(rows):
                    continue
                kept = batch.filter(pa.array(good))
                along = rows @ centroids.T
                near = np.argsort(-along, axis=1, kind="stable")[:, :probe]
                wanted = np.zeros(along.shape, bool)
                np.put_along_axis(wanted, near, True, axis=1)
                if rest:
                    side = np.sqrt(np.maximum((rows * rows).sum(axis=1, keepdims=True) - along * along, 0))
                    most = np.maximum(along * low, along * high) + side * across + 1e-9
                    wanted = ~wanted & (most >= kept.column("floor").to_numpy(zero_copy_only=False)[:, None])
                at, to, lists = [], [], []
                for q, mask in enumerate(wanted):
                    by_block: dict[int, list[int]] = {}
                    for i in np.flatnonzero(mask).tolist():
                        for b in range(block[i], block[i] + parts[i]):
                            by_block.setdefault(b, []).append(i)
                    for b, own in by_block.items():
                        at.append(q), to.append(b), lists.append(own)
                yield pa.RecordBatch.from_arrays([
                    kept.column("query_id").take(pa.array(at, pa.int64())), kept.column("embedding").take(pa.array(at, pa.int64())),
                    pa.array(to, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "embedding", "block", "lists"])

        schema = T.StructType([asked.schema["query_id"], T.StructField("embedding", T.ArrayType(T.DoubleType())),
                               T.StructField("block", T.IntegerType()), T.StructField("lists", T.ArrayType(T.IntegerType()))])
        return asked.mapInArrow(run, schema)

    def _scored(self, sent: DataFrame, k: int, q_blocks: int, where: Column | None, columns: list[str], prune: bool) -> DataFrame:
        """The best k rows of each query in each block, with exact scores."""
        vectors, list_ids, dim = self.vectors, self.list_ids, self.centroids.shape[1]
        if where is not None:
            vectors = vectors.filter(where)
        if prune:
            # The numbers of the lists asked for: MAX_LISTS at most. Other folders are not read.
            asked_for = [r[0] for r in sent.select(F.explode("lists").alias("i")).distinct().collect()]
            if len(asked_for) < len(list_ids):
                vectors = vectors.filter(F.col("list_id").isin([int(list_ids[i]) for i in asked_for]))
        left = sent.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int"))
        right = vectors.select("chunk_id", "embedding", *columns, "list_id", "block").withColumn(
            "qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

        def meet(q: pa.Table, i: pa.Table) -> pa.Table:
            query_matrix, _ = list_matrix(q["embedding"], dim)
            rows, _ = list_matrix(i["embedding"], dim)
            best = Best(k, len(query_matrix))
            if len(rows) and len(query_matrix):
                of_list = np.searchsorted(list_ids, i["list_id"].to_numpy())
                asked_lists = q["lists"].combine_chunks()
                numbers = asked_lists.flatten().to_numpy()
                owners = np.repeat(np.arange(q.num_rows, dtype=np.int32), pc.list_value_length(asked_lists).to_numpy())
                for own in np.unique(of_list):
                    who = owners[numbers == own]
                    if len(who):
                        score_blocks(query_matrix, rows, np.flatnonzero(of_list == own), who, best)
            at, row = best.pairs()
            taken = i.take(pa.array(row))
            return pa.table({"query_id": q["query_id"].take(pa.array(at)), "chunk_id": taken["chunk_id"],
                             **{c: taken[c] for c in columns}, "score": exact_scores(query_matrix, rows, at, row)})

        return left.groupBy("block", "qb").cogroup(right.groupBy("block", "qb")).applyInArrow(meet, hit_schema(sent, vectors, columns))

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None, where: Column | None = None,
               columns: list[str] | None = None) -> DataFrame:
        """``query_id, chunk_id``, further ``columns``, ``score`` and ``rank`` of the k highest dot products.

        Exact without ``nprobe``; with it, the best among each query's ``nprobe`` nearest lists.
        """
        columns = columns or []
        asked = usable_queries(queries)
        if not len(self.list_ids):
            empty = asked.sparkSession.createDataFrame([], hit_schema(asked, self.vectors, columns))
            return ranked(empty, k)
        q_blocks = blocks(asked)
        first = self._scored(self._sent(asked, nprobe or FIRST_LISTS, False), k, q_blocks, where, columns, nprobe is not None)
        if nprobe is not None:
            return shown(ranked(first, k))
        # Stored, as both the bound and the result read it.
        first = stored(ranked(first, k), "first_pass")
        second = self._scored(self._sent(self._floors(asked, first, k), FIRST_LISTS, True), k, q_blocks, where, columns, False)
        return shown(ranked(first.drop("rank").unionByName(second), k))

    def _floors(self, asked: DataFrame, first: DataFrame, k: int) -> DataFrame:
        """The queries with the score that a vector has to reach."""
        found = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
        return asked.join(found, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-float("inf"))))

    def cost(self, queries: DataFrame, k: int) -> dict[str, int]:
        """Pairs that an exact search scores, and all pairs."""
        asked = usable_queries(queries)
        near = self._sent(asked, FIRST_LISTS, False)
        first = ranked(self._scored(near, k, blocks(asked), None, [], False), k)
        sent = near.unionByName(self._sent(self._floors(asked, first, k), FIRST_LISTS, True))
        # A list of several blocks is named in each.
        each = sent.select("query_id", F.explode("lists").alias("i")).distinct().groupBy("i").count().collect()
        return {"scored": int(sum(r["count"] * self.sizes[r["i"]] for r in each)), "all": asked.count() * len(self)}


_OPEN: dict[tuple, VectorIndex] = {}


def built_once(index: DataFrame, source: DataFrame, name: str, columns: list[str] | None = None) -> VectorIndex:
    """The index of ``index`` in the session's shared folder, built when first asked for and again when a file of ``source`` has changed."""
    spark = index.sparkSession
    key = (spark.sparkContext.applicationId, name, input_files(source))
    if key not in _OPEN:
        _OPEN[key] = build(index, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", columns=columns)
    return _OPEN[key]


def recall_against_exact(queries: DataFrame, index: DataFrame, approximate: DataFrame, k: int) -> float:
    """Share of the exact best k that the approximate search found."""
    exact = similarity_topk(queries, index, k).select("query_id", "chunk_id")
    found = exact.join(approximate.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    total = exact.count()
    return found.count() / total if total else 1.0
