"""Near-duplicate documents by HyperMinHash registers, banding and verification.

A document's set is its distinct five-word shingles. One hash per shingle picks
a bucket; a bucket keeps its smallest hash, compressed to a leading-zero count
and ten mantissa bits (two bytes). Documents with equal sets form a class and
go on as one representative. Empty buckets borrow from others for the bands
only; six registers make a band. Representatives that share a band are
candidates; registers estimate their similarity, corrected for chance
collisions, and pairs that may reach the threshold are verified on the full
sets of 64-bit shingle hashes.

No bucket is expanded into pairs. First each member of a bucket is compared
with the bucket's smallest id, and components are formed. Where a bucket still
has members of several components, those outside the smallest id's component
are compared with all others in blocks: by their registers, then on the full sets.
A block emits a link only where it joins two components; a pair that is left
out is already connected, so no component is lost. At the threshold of 0.85 a pair shares none
of the 42 bands once in 400 million cases.

Defined results: a null, empty or blank text has an empty set, linked with
nothing; fewer than five words make one shingle of the whole sequence; rows
with one document id are one node; rows without id count as one node with the
largest id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import NO_ID, WordHashes, concat, fresh, mixed, ngram_hashes, stored, texts_of, with_fixed_ids
from docloom.llm.components import components

SHINGLE = 5
BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
THRESHOLD = 85
EMPTY = np.uint16(0xFFFF)
# Standard errors that an estimate may lie below the threshold.
MARGIN = 4.0
# Documents per block of a comparison.
BLOCK = 256
# Chance that two registers of different sets agree, times 2^MANTISSA (fixed value from the HyperMinHash analysis).
_COLLISIONS = 0.169919487159739093975315012348


def shingle_set(text: bytes, hashes: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    own = hashes.of(words)
    return np.unique(ngram_hashes(own, min(n, len(words))))


def registers(shingles: np.ndarray) -> np.ndarray:
    """Per bucket the smallest hash as leading zeros and mantissa; ``EMPTY`` without one."""
    spread = mixed(shingles ^ np.uint64(0x5851F42D4C957F2D))
    bucket = (spread >> np.uint64(32)) % np.uint64(REGISTERS)
    value = mixed(shingles ^ np.uint64(0x14057B7EF767814F)) >> np.uint64(1)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bucket.astype(np.intp), value)
    full = least != np.iinfo(np.uint64).max
    # Exponent of the value read as a fraction of 2^63.
    exponent = np.frexp(least.astype(np.float64))[1]
    zeros = np.clip(63 - exponent, 0, 52).astype(np.uint64)
    fraction = (least << (zeros + np.uint64(2))) >> np.uint64(64 - MANTISSA)
    return np.where(full, (zeros << np.uint64(MANTISSA)) | fraction, np.uint64(EMPTY)).astype(np.uint16)


_BORROW = np.array([[xxhash.xxh3_64_intdigest(b"%d %d" % (k, i)) % REGISTERS for i in range(REGISTERS)] for k in range(64)], np.intp)


def filled(regs: np.ndarray) -> np.ndarray:
    """Empty registers take the value of the first full one in an order of their own."""
    out = regs.copy()
    missing = np.flatnonzero(out == EMPTY)
    for order in _BORROW:
        if not len(missing):
            return out
        out[missing] = regs[order[missing]]
        missing = missing[out[missing] == EMPTY]
    full = np.flatnonzero(regs != EMPTY)
    out[missing] = regs[full[np.searchsorted(full, missing) % len(full)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    bands = filled(regs).reshape(BANDS, ROWS).astype(np.uint64)
    return mixed(ngram_rows(bands) ^ np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def ngram_rows(bands: np.ndarray) -> np.ndarray:
    key = np.full(len(bands), 17, np.uint64)
    for column in bands.T:
        key = mixed(key * np.uint64(0x2545F4914F6CDD1D) + column)
    return key


def estimates(one: np.ndarray, many: np.ndarray, n_one: int, n_many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard similarity of one set with many, and its standard error at the threshold."""
    used = (one != EMPTY) | (many != EMPTY)
    same = (one == many) & (one != EMPTY)
    count = np.maximum(used.sum(axis=1), 1)
    ratio = np.maximum(n_one, n_many) / np.maximum(np.minimum(n_one, n_many), 1)
    chance = _COLLISIONS / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    jaccard = np.clip((same.sum(axis=1) / count - chance) / (1 - chance), 0, 1)
    at = THRESHOLD / 100
    return jaccard, np.sqrt(at * (1 - at) / count)


def may_pass(one: np.ndarray, many: np.ndarray, n_one: int, n_many: np.ndarray) -> np.ndarray:
    sizes = 100 * np.minimum(n_one, n_many) >= THRESHOLD * np.maximum(n_one, n_many)
    jaccard, error = estimates(one, many, n_one, n_many)
    return sizes & (jaccard >= THRESHOLD / 100 - MARGIN * error)


def _reaches(one: np.ndarray, other: np.ndarray) -> bool:
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * both >= THRESHOLD * (len(one) + len(other) - both)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sizes, high, low, regs = [], [], [], []
        for text in texts_of(batch.column(1)):
            own = shingle_set(text, hashes)
            full = xxhash.xxh3_128_intdigest(own.tobytes())
            sizes.append(len(own))
            high.append(np.uint64(full >> 64))
            low.append(np.uint64(full & 0xFFFFFFFFFFFFFFFF))
            regs.append(registers(own).tobytes() if len(own) else None)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(high, np.uint64).view(np.int64)),
            pa.array(np.array(low, np.uint64).view(np.int64)), pa.array(regs, pa.binary())], names=["id", "n", "high", "low", "regs"])


def signatures(docs: DataFrame) -> DataFrame:
    """``id, n`` (set size), ``high, low`` (digest of the set), ``regs``."""
    return docs.select(with_fixed_ids(F.col("doc_id")).alias("id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        _signed, "id long, n long, high long, low long, regs binary")


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [band_keys(np.frombuffer(regs, np.uint16)) for regs in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(concat(keys, np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))],
                                         names=["key", "id"])


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pairs ``a, b, n_a, n_b, regs_a, regs_b`` those that may pass."""
    for batch in batches:
        if not batch.num_rows:
            continue
        one, many = (np.stack([np.frombuffer(r, np.uint16) for r in batch.column(i).to_pylist()]) for i in (4, 5))
        yield batch.select([0, 1]).filter(pa.array(may_pass(one, many, batch.column(2).to_numpy(), batch.column(3).to_numpy())))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by block, the block's own document first; every other row is compared with it."""
    hashes = WordHashes()
    block, centre = None, []
    for batch in batches:
        found: list[tuple[int, int]] = []
        for a, part, b, text in zip(*(batch.column(i).to_pylist() for i in range(3)), texts_of(batch.column(3))):
            own = shingle_set(text, hashes)
            if b is None:
                centre = [*centre, own] if block == (a, part) else [own]
                block = (a, part)
                continue
            for other in centre:
                if _reaches(own, other):
                    found.append((a, b))
                    break
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets reach the threshold. ``texts`` has ``id, text``.

    The pairs of one document are split into blocks, each with its own copy of that document.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(stored(counts, "blocks"), "a").withColumn("part", F.pmod(F.xxhash64("b"), "blocks").cast("int"))
    dealt = stored(dealt.select("a", "b", "part"), "dealt")
    centres = dealt.select("a", "part").distinct().join(texts, F.col("a") == F.col("id")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    others = dealt.join(texts, F.col("b") == F.col("id")).select("a", "part", "b", "text")
    ordered = centres.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(_verified, "a long, b long")


class _Block:
    """The residents of a block, and which components the block's links have joined so far."""

    def __init__(self, key: tuple):
        self.key, self.ids, self.labels, self.sizes, self.regs, self.texts = key, [], [], [], [], []
        self.sets: dict[int, np.ndarray] = {}
        self.joined: dict[int, int] = {}
        self.table = None

    def add(self, i: int, label: int, n: int, regs: bytes, text: bytes) -> None:
        for column, value in zip((self.ids, self.labels, self.sizes, self.regs, self.texts), (i, label, n, np.frombuffer(regs, np.uint16), text)):
            column.append(value)

    def root(self, label: int) -> int:
        while label in self.joined:
            label = self.joined[label]
        return label

    def visit(self, i: int, label: int, n: int, regs: bytes, text: bytes, hashes: WordHashes) -> Iterator[tuple[int, int]]:
        """Links of a visitor to residents of other components; one per component it joins."""
        if self.table is None:
            self.table = np.stack(self.regs), np.array(self.labels), np.array(self.sizes)
        other = np.flatnonzero(self.table[1] != label)
        passing = other[may_pass(np.frombuffer(regs, np.uint16), self.table[0][other], n, self.table[2][other])] if len(other) else other
        own = None
        for at in passing.tolist():
            mine, theirs = self.root(label), self.root(self.labels[at])
            if mine == theirs:
                continue
            own = shingle_set(text, hashes) if own is None else own
            if at not in self.sets:
                self.sets[at] = shingle_set(self.texts[at], hashes)
            if _reaches(own, self.sets[at]):
                self.joined[max(mine, theirs)] = min(mine, theirs)
                yield min(i, self.ids[at]), max(i, self.ids[at])


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by block, residents first; each visitor is compared with the residents of other components."""
    hashes, block = WordHashes(), None
    for batch in batches:
        found: list[tuple[int, int]] = []
        for key, part, visits, *member in zip(*(c.to_pylist() for c in batch.columns)):
            if block is None or block.key != (key, part):
                block = _Block((key, part))
            if not visits:
                block.add(*member)
            elif block.ids:
                found += block.visit(*member, hashes)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])


def _cross_links(members: DataFrame, labels: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links between members of one bucket that are in different components, enough to join these."""
    labelled = members.join(labels, F.col("id") == F.col("node"), "left").select(
        "key", "id", "leader", F.coalesce("component", "id").alias("label"))
    lead = labelled.filter(F.col("id") == F.col("leader")).select("key", F.col("label").alias("lead")).distinct()
    counts = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"))
    open_ = stored(counts.filter(F.col("lo") < F.col("hi")).join(lead, "key").select(
        "key", "lead", F.ceil(F.col("n") / (2 * BLOCK)).cast("int").alias("blocks")), "open")
    rows = stored(labelled.join(open_, "key").select("key", "id", "label", "blocks", (F.col("label") != F.col("lead")).alias("outside")), "crossing")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    residents = rows.select("key", own.alias("part"), F.lit(False).alias("visits"), "id", "label")
    visitors = rows.filter("outside").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(True).alias("visits"), "id", "label")
    dealt = residents.unionByName(visitors).join(sigs, "id").join(texts, "id").select("key", "part", "visits", "id", "label", "n", "regs", "text")
    ordered = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "visits")
    return ordered.mapInArrow(_crossed, "a long, b long").distinct()


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and ``high, low, n, rep`` per distinct non-empty set."""
    sigs = stored(signatures(docs), "signatures")
    reps = sigs.filter(F.col("n") > 0).groupBy("high", "low", "n").agg(F.min("id").alias("rep"))
    return sigs, stored(reps, "classes")


def links(docs: DataFrame, sigs: DataFrame, reps: DataFrame) -> DataFrame:
    """Verified links ``a, b`` between representatives, enough to connect every component."""
    own = sigs.join(reps.select("high", "low", F.col("rep").alias("id")), ["high", "low", "id"], "left_semi")
    slim = stored(own.select("id", "n", "regs").distinct(), "representatives")
    bands = stored(slim.select("id", "regs").mapInArrow(_banded, "key long, id long"), "bands")
    shared = stored(bands.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last"))
                    .filter(F.col("leader") < F.col("last")).select("key", "leader"), "shared")
    members = stored(bands.join(shared, "key"), "members")

    star = members.filter(F.col("id") != F.col("leader")).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    joined = star.join(slim.toDF("a", "n_a", "regs_a"), "a").join(slim.toDF("b", "n_b", "regs_b"), "b")
    first = stored(joined.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(_estimated, "a long, b long"), "candidates")

    wanted = stored(members.select("id").distinct(), "wanted")
    texts = stored(docs.select(with_fixed_ids(F.col("doc_id")).alias("id"), F.col("text").cast("binary").alias("text"))
                   .join(wanted, "id", "left_semi"), "texts")
    edges = stored(verified(first, texts), "links")
    more = stored(_cross_links(members, components(edges), slim, texts), "more_links")
    return edges.unionByName(more)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept`` and the ``class_id`` of its set."""
    sigs, reps = classes(docs)
    found = components(links(docs, sigs, reps))
    placed = stored(reps.join(found, F.col("rep") == F.col("node"), "left").select(
        "high", "low", "rep", F.coalesce("component", "rep").alias("component")), "placed")
    rows = sigs.select("id", "n", "high", "low").join(placed, ["high", "low"], "left")
    component = F.coalesce("component", "id")

    def shown(value):
        return F.when(value != NO_ID, value)

    return rows.select(
        shown(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), shown(component).alias("component_id"),
        (F.col("id") == component).alias("kept"), shown(F.coalesce("rep", "id")).alias("class_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, with all columns: the smallest id of the group, a row without id last; of equal ids any one row.

    Every row is a document of its own here, so rows that share an id, or have none, are told apart.
    """
    row, taken = (fresh(docs, name) for name in ("row_key", "taken"))
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    groups = near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(taken), "component_id")
    named = groups.join(keyed.select(F.col(row), F.col("doc_id").cast("long").alias("own_id")), F.col(taken) == F.col(row))
    first = F.min(F.struct(F.col("own_id").isNull(), "own_id", taken))[taken]
    kept = named.groupBy("component_id").agg(first.alias("kept"))
    gone = stored(groups.join(kept.select("kept"), F.col(taken) == F.col("kept"), "left_anti").select(taken), "gone")
    return keyed.join(gone, F.col(row) == F.col(taken), "left_anti").drop(row)
