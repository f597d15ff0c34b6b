"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

Features of a text are its words, symbols and word pairs, hashed into 2^18
places; a place's value is its count over the root of the sum of squared
counts. Training reads at most ``MAX_TRAINING`` labelled documents, chosen by
the hash of their id; ``SHARDS`` learners go through their share in hash order
by FTRL-proximal, and their weights are averaged. Scoring is a sparse dot
product in the scan of the documents.

Defined results: a null or empty text has only the bias; labels of one id are
averaged (half counts as 1) and null labels ignored; without any label every
score is 0.5; only the text is used for a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import WordHashes, fold, ngram_hashes, stored, texts_of

BITS = 18
MAX_TRAINING = 24_000
SHARDS = 4
FOLDS, HELD_OUT = 3, 1
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.05, 0.1
EPOCHS = 3
# Symbols stand as words of their own, so that a word is the same with and without them.
_SYMBOLS = b"#*$%&|<>!?.,;:"

_TWICE = np.uint64(0x9E3779B97F4A7C15)


def features(text: bytes, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features."""
    for symbol in _SYMBOLS:
        one = bytes([symbol])
        if one in text:
            text = text.replace(one, b" " + one + b" ")
    words = hashes.of(text.split())
    pairs = ngram_hashes(words, 2)
    # A word said twice is the same pair whatever the word.
    pairs[words[1:] == words[:-1]] = _TWICE
    places = np.concatenate([ngram_hashes(words, 1), pairs]) >> np.uint64(64 - BITS)
    place, count = np.unique(places.astype(np.int64), return_counts=True)
    value = np.sqrt(count)
    return place, value / max(1.0, np.sqrt((value * value).sum()))


class Learner:
    """FTRL-proximal for logistic loss; the last weight is the bias."""

    def __init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, place: np.ndarray, value: np.ndarray, label: int) -> None:
        at, x = np.r_[place, 1 << BITS], np.r_[value, 1.0]
        w = self.weights(at)
        gradient = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        rate = (np.sqrt(self.n[at] + gradient * gradient) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += gradient - rate * w
        self.n[at] += gradient * gradient


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights of each shard in this task; rows come ordered by shard."""
    hashes = WordHashes()
    rows: list = []
    shard = None

    def learned() -> pa.RecordBatch:
        model = Learner()
        for _ in range(EPOCHS):
            for place, value, label in rows:
                model.learn(place, value, label)
        return pa.RecordBatch.from_arrays([pa.array([model.weights(slice(None)).astype(np.float32).tobytes()], pa.binary())], names=["weights"])

    for batch in batches:
        for own, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
            if own != shard and rows:
                yield learned()
                rows = []
            shard = own
            place, value = features(text, hashes)
            rows.append((place.astype(np.int32), value.astype(np.float32), label))
    if rows:
        yield learned()


def train(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> np.ndarray:
    """Averaged weights of the learners."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)).groupBy(
        "doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    total = known.count()
    # A threshold on the hash of the id keeps about max_training of them, whatever the order of rows.
    order = F.xxhash64(F.col("doc_id").cast("string"))
    share = min(1.0, max_training / max(total, 1))
    chosen = stored(known.withColumn("order", order).filter(F.pmod("order", F.lit(1_000_000)) < int(share * 1_000_000)), "chosen")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").select(
        F.pmod("order", F.lit(SHARDS)).alias("shard"), "label", "text", "order")
    shards = rows.repartition(SHARDS, "shard").sortWithinPartitions("shard", "order").select("shard", "label", "text")
    models = [np.frombuffer(r["weights"], np.float32) for r in shards.mapInArrow(_trained, "weights binary").collect()]
    return np.mean(models, axis=0) if models else np.zeros((1 << BITS) + 1, np.float32)


def _scored(weights):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, hashes = weights.value, WordHashes()
        for batch in batches:
            scores = []
            for text in texts_of(batch.column(2)):
                place, value = features(text, hashes)
                scores.append(float(w[place] @ value + w[-1]))
            score = 1 / (1 + np.exp(-np.clip(np.array(scores, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return scan


def scored(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_training))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
                       F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_scored(weights), "doc_id long, held_out boolean, score double, predicted int")
