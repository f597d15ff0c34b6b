"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Benchmark items are cut into passages of up to 64 words. The three-word seeds
of the passages are counted over all documents; a seed weighs the more the
fewer documents hold it. A document that has enough of a passage's weight is a
candidate, and the passage is aligned with the words around the seeds. The
similarity is the alignment's score over that of a full copy, so that edited and
paraphrased copies score high as well.

The documents are scanned, not shuffled: passages are sent to them in blocks of
at most ``BLOCK_WORDS`` words, with two scans per block (count, align).

Defined results: words are compared lower-cased and without ASCII punctuation;
null and empty texts match nothing; items of fewer than ``MIN_WORDS`` words say
too little to prove a leak and match nothing; rows with the same id give one row
per item, the best; a document without id is reported with a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import mixed, ngram_hashes, opened, sent, stored, texts_of

SEED = 3
MIN_WORDS = 8
PASSAGE, STRIDE = 64, 32
# Words of passages per block: some 20 MB with the seed index.
BLOCK_WORDS = 400_000
# Share of a passage's seed weight that makes a document a candidate, and the similarity that makes it a leak.
EVIDENCE = 0.1
SIMILARITY = 0.5
MATCH, MISMATCH, GAP = 2, -1, 1
# Bytes of text that are hashed at a time; a longer document is looked up alone.
_PIECE = 1 << 18
_PLAIN = bytes(32 if 9 <= c <= 13 or 33 <= c <= 126 and not chr(c).isalnum() else c for c in range(256))
# A number for each byte at each of 256 places of a word.
_NUMBERS = mixed(np.arange(1, 1 + (1 << 16), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def plain(text: bytes) -> bytes:
    """Lower-cased, with spaces for punctuation and white space."""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return text.lower().translate(_PLAIN)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and first byte of each word of a plain text; a word's hash is the sum of its bytes' numbers."""
    hashes, starts, low = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while low < len(text):
        high = text.find(b" ", low + _PIECE)
        codes = np.frombuffer(text[low:high if high >= 0 else len(text)], np.uint8)
        inside = codes != 32
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        first, length = edges[::2], edges[1::2] - edges[::2]
        if len(first):
            begin = np.cumsum(length) - length
            place = np.arange(begin[-1] + length[-1]) - np.repeat(begin, length)
            numbers = _NUMBERS[(place & 255) << 8 | codes[inside]]
            if length.max() > 256:
                numbers = numbers * ((place >> 8) * 2 + 1).astype(np.uint64)
            hashes.append(mixed(np.add.reduceat(numbers, begin)))
            starts.append(first + low)
        low = high if high >= 0 else len(text)
    return np.concatenate(hashes), np.concatenate(starts)


def align(passage: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and the last of ``words`` in it (or -1)."""
    at = np.arange(len(words) + 1) * GAP
    row = np.zeros(len(words) + 1, np.int64)
    best, end = 0, -1
    for word in passage:
        step = np.where(words == word, MATCH, MISMATCH)
        new = np.maximum(row - GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + step)
        # Gaps along the row: a running maximum of the values less what the way to them costs.
        row = np.maximum.accumulate(new + at) - at
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top - 1
    return best, end


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, parts, texts, counts = [], [], [], []
        for item, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            words = plain(text).split()
            if len(words) < MIN_WORDS:
                continue
            for part, start in enumerate(range(0, max(len(words) - PASSAGE + STRIDE, 1), STRIDE)):
                own = words[start:start + PASSAGE]
                items.append(item)
                parts.append(part)
                texts.append(b" ".join(own))
                counts.append(len(own))
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(parts, pa.int64()), pa.array(texts, pa.binary()),
                                          pa.array(counts, pa.int64())], names=["item_id", "part", "words", "n"])


class SeedIndex:
    """The seeds of a block of passages, sorted, each with the passages that hold it."""

    def __init__(self, items: list, texts: list[bytes]):
        self.items = items
        self.words = [word_hashes(text)[0] for text in texts]
        grams = [ngram_hashes(w, SEED) for w in self.words]
        every = np.concatenate(grams)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        self.seeds, seed = np.unique(every, return_inverse=True)
        # Each seed counts once per passage, however often the passage repeats it.
        pairs = np.unique(seed * len(grams) + owner)
        self.owner, self.seed = pairs % len(grams), pairs // len(grams)
        self.first = np.searchsorted(self.seed, np.arange(len(self.seeds)))
        self.count = np.bincount(self.seed, minlength=len(self.seeds))
        self.weight = np.ones(len(self.seeds))
        self._weigh()

    def _weigh(self) -> None:
        self.total = np.bincount(self.owner, self.weight[self.seed], len(self.words))

    def set_counts(self, documents: int, counts: np.ndarray) -> None:
        self.weight = np.log((documents + 2) / (counts + 1))
        self._weigh()

    def bits(self) -> np.ndarray:
        """Which leading 20 bits occur among the seeds."""
        flags = np.zeros(1 << 20, bool)
        flags[(self.seeds >> np.uint64(44)).astype(np.intp)] = True
        return flags

    def hits(self, grams: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``grams`` that are seeds, and which."""
        at = np.flatnonzero(flags[(grams >> np.uint64(44)).astype(np.intp)])
        if not len(at):
            return at, at
        seed = np.minimum(np.searchsorted(self.seeds, grams[at]), len(self.seeds) - 1)
        true = self.seeds[seed] == grams[at]
        return at[true], seed[true]

    def leaks(self, words: np.ndarray, at: np.ndarray, seed: np.ndarray) -> dict:
        """Per item its best ``(similarity, first word, last word)``, from ``SIMILARITY`` on. ``seed`` are the seeds, ``at`` their positions."""
        present = np.unique(seed)
        counts = self.count[present]
        entries = np.repeat(self.first[present], counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        owners, inverse = np.unique(self.owner[entries], return_inverse=True)
        evidence = np.bincount(inverse, self.weight[self.seed[entries]])
        best: dict = {}
        for owner in owners[evidence >= EVIDENCE * self.total[owners]].tolist():
            passage = self.words[owner]
            for low, high in self._regions(owner, at, seed, len(passage), len(words)):
                score, end = align(passage, words[low:high])
                similarity = score / (MATCH * len(passage))
                item = self.items[owner]
                if similarity >= SIMILARITY and similarity > best.get(item, (0.0,))[0]:
                    # The same alignment from its end backwards gives its first word.
                    _, back = align(passage[::-1], words[low:low + end + 1][::-1])
                    best[item] = (similarity, low + end - back, low + end)
        return best

    def _regions(self, owner: int, at: np.ndarray, seed: np.ndarray, length: int, n: int) -> list[tuple[int, int]]:
        """Stretches of the document around seeds of a passage, half a passage wider on both sides."""
        own = {s for s in np.unique(seed).tolist()
               if (self.owner[self.first[s]:self.first[s] + self.count[s]] == owner).any()}
        places = at[np.isin(seed, list(own))]
        cuts = np.flatnonzero(np.diff(places) > length)
        starts, ends = places[np.r_[0, cuts + 1]], places[np.r_[cuts, len(places) - 1]]
        return [(max(0, a - length - length // 2), min(n, b + SEED + length + length // 2)) for a, b in zip(starts.tolist(), ends.tolist())]


def _groups(texts: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of several texts in a row, and the word at which each text ends; a group closes when it has ``_PIECE`` bytes."""
    def group(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words, starts = word_hashes(b" ".join(parts))
        return words, np.searchsorted(starts, np.cumsum([len(part) + 1 for part in parts]))

    parts, held = [], 0
    for text in texts:
        parts.append(plain(text))
        held += len(parts[-1]) + 1
        if held >= _PIECE:
            yield group(parts)
            parts, held = [], 0
    if parts:
        yield group(parts)


def _hits(own: SeedIndex, flags: np.ndarray, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that hold a seed, which seed, and in which text of the group; a seed lies within one text."""
    at, seed = own.hits(ngram_hashes(words, SEED), flags)
    text = np.searchsorted(ends, at, side="right")
    within = at + SEED <= ends[text]
    return at[within], seed[within], text[within]


def _found(own: SeedIndex, flags: np.ndarray, texts: Iterator[bytes]) -> Iterator[tuple[int, dict]]:
    """The number of each text that holds items, and these."""
    before = 0
    for words, ends in _groups(texts):
        at, seed, text = _hits(own, flags, words, ends)
        some, edges = np.unique(text, return_index=True)
        for i, low, high in zip(some.tolist(), edges.tolist(), [*edges[1:].tolist(), len(text)]):
            start = int(ends[i - 1]) if i else 0
            items = own.leaks(words[start:ends[i]], at[low:high] - start, seed[low:high])
            if items:
                yield before + i, items
        before += len(ends)


def _counted(index):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(index)
        flags, counts, documents = own.bits(), np.zeros(len(own.seeds), np.int64), 0
        for batch in batches:
            documents += batch.num_rows
            for words, ends in _groups(texts_of(batch.column(0))):
                _, seed, text = _hits(own, flags, words, ends)
                # A text counts once, however often it has the seed.
                np.add.at(counts, np.unique(text * len(counts) + seed) % len(counts), 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some], pa.int64()), pa.array(np.r_[documents, counts[some]], pa.int64())], names=["seed", "n"])

    return scan


def _aligned(index):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(index)
        flags = own.bits()
        for batch in batches:
            ids = batch.column(0)
            rows = [(ids[i].as_py(), item, *found) for i, items in _found(own, flags, texts_of(batch.column(1)))
                    for item, found in items.items()]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
                                             names=["doc_id", "item_id", "similarity", "first_word", "last_word"])

    return scan


def _clean(index):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(index)
        flags = own.bits()
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[i for i, _ in _found(own, flags, texts_of(batch.column(1)))]] = False
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["row"]).filter(pa.array(clean))

    return scan


def _indexes(docs: DataFrame, benchmark: DataFrame, block_words: int):
    """A broadcast index per block of passages, with seed counts over all documents."""
    spark = docs.sparkSession
    passages = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
                      .filter("item_id is not null").mapInArrow(_passages, "item_id long, part long, words binary, n long"), "passages")
    total = passages.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // block_words)
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    for block in range(blocks):
        here = F.pmod(F.xxhash64("item_id", "part"), F.lit(blocks)) == block
        rows = sorted((r["item_id"], r["part"], bytes(r["words"])) for r in passages.filter(here).toLocalIterator())
        if not rows:
            continue
        index = SeedIndex([r[0] for r in rows], [r[2] for r in rows])
        counting = sent(spark, index)
        counts = np.zeros(len(index.seeds), np.int64)
        documents = 0
        for r in texts.mapInArrow(_counted(counting), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toLocalIterator():
            if r["seed"] < 0:
                documents = r["n"]
            else:
                counts[r["seed"]] = r["n"]
        index.set_counts(documents, counts)
        yield sent(spark, index)


def leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, last_word``: a row per document and item that it holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, item_id long, similarity double, first_word long, last_word long"
    found = docs.sparkSession.createDataFrame([], schema)
    for index in _indexes(docs, benchmark, block_words):
        found = found.unionByName(rows.mapInArrow(_aligned(index), schema))
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("first"), "last_word"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", "best.similarity", (-F.col("best.first")).alias("first_word"), "best.last_word")


def decontaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that hold no item, with all their columns; nothing is joined or shuffled."""
    schema = T.StructType([docs.select(F.struct("*").alias("row")).schema["row"]])
    left = docs
    for index in _indexes(docs, benchmark, block_words):
        left = left.select(F.struct("*").alias("row"), F.col("text").cast("binary").alias("text")).mapInArrow(_clean(index), schema).select("row.*")
    return left
