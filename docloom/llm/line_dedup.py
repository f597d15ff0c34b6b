"""Line deduplication: two Bloom filters name the suspects, only suspects are shuffled.

A first scan hashes the long lines of each document. Blocks of hashes become
bit positions of a filter; merging two blocks keeps, beside the bits set once,
the bits set by more than one block or by two documents of a block. A line of
two documents has all of its bits among those, so no repeat is missed. A second
scan emits (digest, document) for the lines whose bits are all set twice; their
exact 128-bit digests are grouped, and the smallest document id of each true
repeat keeps the line.

The filter has 12 bits per line up to ``MAX_BITS`` (32 MB as a broadcast). Past
that it fills up: more lines become suspects and are shuffled, up to all of
them, and the result stays the same.

Defined results: a null or empty text is one empty line; rows with the same
document id are one document; documents without an id count as one document
with the largest id; other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import concat, mixed, stored, texts_of, with_fixed_ids

MIN_POINTS = 10
MAX_BITS = 1 << 28
BITS_PER_LINE = 12
_POSITIONS = 3
_SEGMENT_BITS = 16
# Hashes per block; a block is 16 MB.
_BLOCK = 1 << 21


def line_keys(text: bytes) -> list[bytes]:
    """A key for each line: stripped, A-Z lower-cased."""
    return [line.strip() for line in text.lower().split(b"\n")]


def is_long(key: bytes) -> bool:
    return len(key) >= 4 * MIN_POINTS or (len(key) >= MIN_POINTS and len(key.decode("utf-8", "replace")) >= MIN_POINTS)


def _long_keys(text: bytes) -> set[bytes]:
    return {key for key in line_keys(text) if is_long(key)}


def _bits(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    step = mixed(hashes) | np.uint64(1)
    return [(hashes + np.uint64(i) * step) & np.uint64(size - 1) for i in range(_POSITIONS)]


def _segments(hashes: np.ndarray, size: int) -> dict[int, np.ndarray]:
    """Sorted bit positions by filter segment."""
    bits = np.unique(concat(_bits(hashes, size), np.uint64))
    segment = bits >> np.uint64(_SEGMENT_BITS)
    starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(bits) else np.empty(0, int)
    low = (bits & np.uint64((1 << _SEGMENT_BITS) - 1)).astype(np.uint16)
    return {int(segment[a]): low[a:b] for a, b in zip(starts, np.r_[starts[1:], len(bits)])}


def _partial_filters(size: int):
    def block(parts: list[np.ndarray]) -> pa.RecordBatch:
        hashes, counts = np.unique(concat(parts, np.uint64), return_counts=True)
        once, twice = _segments(hashes, size), _segments(hashes[counts > 1], size)
        none = np.empty(0, np.uint16)
        return pa.RecordBatch.from_arrays([
            pa.array(list(once), pa.int32()),
            pa.array([v.tobytes() for v in once.values()], pa.binary()),
            pa.array([twice.get(k, none).tobytes() for k in once], pa.binary())], names=["segment", "once", "twice"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for text in texts_of(batch.column(0)):
                keys = _long_keys(text)
                parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
                held += len(keys)
                if held >= _BLOCK:
                    yield block(parts)
                    parts, held = [], 0
        if held:
            yield block(parts)

    return scan


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each segment the bits that were set twice; holds two bitmaps per segment."""
    width = 1 << _SEGMENT_BITS
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}

    def packed(positions: bytes) -> np.ndarray:
        flags = np.zeros(width, bool)
        flags[np.frombuffer(positions, np.uint16)] = True
        return np.packbits(flags)

    for batch in batches:
        for segment, o, t in zip(*(c.to_pylist() for c in batch.columns)):
            new = packed(o)
            if segment not in once:
                once[segment], twice[segment] = new, packed(t)
            else:
                twice[segment] |= packed(t) | (once[segment] & new)
                once[segment] |= new
    if once:
        yield pa.RecordBatch.from_arrays([pa.array(list(twice), pa.int32()), pa.array([v.tobytes() for v in twice.values()], pa.binary())],
                                         names=["segment", "twice"])


def twice_filter(texts: DataFrame, max_bits: int = MAX_BITS) -> np.ndarray:
    """The bits, packed, that more than one document's lines may have set; at most ``max_bits / 8`` bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    lines = texts.agg(F.sum(breaks + 1)).first()[0] or 0
    size = min(max_bits, 1 << max(_SEGMENT_BITS, int(lines * BITS_PER_LINE).bit_length()))
    partial = texts.mapInArrow(_partial_filters(size), "segment int, once binary, twice binary")
    merged = partial.repartition("segment").mapInArrow(_merged, "segment int, twice binary")
    bitmap = np.zeros((size >> _SEGMENT_BITS, (1 << _SEGMENT_BITS) // 8), np.uint8)
    for row in merged.toLocalIterator():
        bitmap[row["segment"]] = np.frombuffer(row["twice"], np.uint8)
    return bitmap.reshape(-1)


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _suspects(bitmap):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        size = len(bits) * 8
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                own = _long_keys(text)
                keys += own
                ids += [doc] * len(own)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
            hit = np.ones(len(keys), bool)
            for at in _bits(hashes, size):
                hit &= (bits[at >> np.uint64(3)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1
            chosen = np.flatnonzero(hit).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([digest(keys[i]) for i in chosen], pa.binary()),
                                              pa.array([ids[i] for i in chosen], pa.int64())], names=["digest", "id"])

    return scan


def repeats(texts: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``id, digests``: per document the digests of the lines that an earlier document holds."""
    spark = texts.sparkSession
    bitmap = spark.sparkContext.broadcast(twice_filter(texts.select("text"), max_bits))
    found = stored(texts.select("id", "text").mapInArrow(_suspects(bitmap), "digest binary, id long"), "suspects")
    true = stored(found.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
                  .filter(F.col("first") < F.col("last")).select("digest", "first"), "repeats")
    # Two scans meet: a line of very many documents is split by adaptive execution.
    later = found.join(true, "digest").filter(F.col("id") != F.col("first"))
    return stored(later.groupBy("id").agg(F.collect_set("digest").alias("digests")), "drops")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, lines, dropped = [], [], []
        for text, digests in zip(texts_of(batch.column(1)), batch.column(2).to_pylist()):
            raw = text.split(b"\n")
            stay = raw
            if digests:
                drop = set(digests)
                stay = [line for line, key in zip(raw, line_keys(text)) if not (is_long(key) and digest(key) in drop)]
            kept.append(b"\n".join(stay))
            lines.append(len(raw))
            dropped.append(len(raw) - len(stay))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                                         names=["row", "kept", "n_lines", "n_dropped"])


def deduplicated(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``row`` (the document's columns as given), ``kept`` (the text left, binary), ``n_lines``, ``n_dropped``."""
    rows = docs.select(F.struct("*").alias("row"), with_fixed_ids(F.col("doc_id")).alias("id"), F.col("text").cast("binary").alias("text"))
    drops = repeats(rows.select("id", "text"), max_bits)
    joined = rows.join(drops, "id", "left").select("row", "text", "digests")
    schema = T.StructType([rows.schema["row"], T.StructField("kept", T.BinaryType()), T.StructField("n_lines", T.LongType()),
                           T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(_kept, schema)


def cleaned(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents with the text that is left; those that lose all of their words are gone."""
    done = deduplicated(docs, max_bits)
    text = F.col("kept").cast("string")
    had_words = F.rlike("row.text", F.lit(r"[^\x20\x09-\x0D]"))
    emptied = F.coalesce(had_words & ~F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    fields = docs.columns
    return done.filter(~emptied).select(*[
        F.when(F.col("n_dropped") > 0, text).otherwise(F.col("row.text")).alias(c) if c == "text"
        else F.when(F.col("n_dropped") > 0, F.length(text)).otherwise(F.col(f"row.{c}")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(f"row.{c}") for c in fields])
