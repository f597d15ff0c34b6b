"""Near-duplicate documents by 64-bit SimHash fingerprints and a grid over their segments' bit counts.

A fingerprint bit is set if it is set in more than half of the hashes of the
text's three-word shingles, repeats included. The fingerprint is cut into 16
segments of four bits; the bit counts of the segments place it in a space of 16
small whole numbers. A differing bit changes one count by one, so the Manhattan
distance of two places is never above the number of differing bits.

The range join goes through a grid of the places themselves. Each distinct
fingerprint stands in the cell of its place and in every cell one step away (33
at most). Two places at most two steps apart meet in a cell between them. A cell
of two fingerprints is a candidate pair, compared bit by bit. A cell of more is
not expanded into pairs: its members go to a finer grid, where every bit is a
segment of its own. There, the Manhattan distance is the number of differing
bits, all members of a cell (65 at most, as they are within one bit of the
cell's pattern) are linked, and each is joined to the smallest. So no bucket is
capped or expanded, and no link between different fingerprints is lost: work is
at most 33 + 65 rows per distinct fingerprint, whatever the sizes of the groups.

Counting a cell combines within tasks before the shuffle, so a cell that many
documents share is a few rows. Documents with equal fingerprints are one node.

Defined results: a null, empty or blank text has fingerprint zero, linked like
any other; fewer than three words are one shingle. All rows of one document id
are one document: their fingerprints are in one component. Rows without id are
documents of their own; their component is the smallest id linked with them,
null if there is none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stored, texts_of
from docloom.llm.components import components

SHINGLE, SEED, BITS, DISTANCE = 3, 42, 64, 2
# Shingles whose bits are added up at a time.
CHUNK = 65_536


def shingle_hashes(words: list[bytes]) -> Iterator[np.ndarray]:
    """XXH64 of each run of three words joined by a space, in chunks; of the whole sequence if there are fewer."""
    if len(words) < SHINGLE:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(words) - SHINGLE + 1, CHUNK):
        own = words[at:at + CHUNK + SHINGLE - 1]
        yield np.array([digest(b"%b %b %b" % run, SEED) for run in zip(own, own[1:], own[2:])], np.uint64)


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    total, count = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(words):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
        count += len(hashes)
    return int(np.packbits(2 * total > count, bitorder="little").view(np.uint64)[0])


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(text) for text in texts_of(batch.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, print``: the fingerprint as a signed 64-bit number."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        _fingerprinted, "doc_id long, print long")


def place(bits: Column) -> Column:
    """The bit counts of the 16 four-bit segments, each in four bits of one number."""
    lowest = F.lit(0x1111111111111111)
    return sum((F.shiftrightunsigned(bits, k).bitwiseAND(lowest) for k in (1, 2, 3)), bits.bitwiseAND(lowest))


def cells(at: Column) -> Column:
    """The place and the places one step away."""
    def step(i):
        unit = F.call_function("shiftleft", F.lit(1).cast("long"), (i * 4).cast("int"))
        count = F.call_function("shiftrightunsigned", at, (i * 4).cast("int")).bitwiseAND(F.lit(15))
        # Segments hold 0 to 4 bits.
        return F.array(F.when(count < 4, at.bitwiseXOR(count * unit).bitwiseOR((count + 1) * unit)),
                       F.when(count > 0, at.bitwiseXOR(count * unit).bitwiseOR((count - 1) * unit)))

    around = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), step))
    return F.concat(F.array(at), F.filter(around, lambda x: x.isNotNull()))


def patterns(bits: Column) -> Column:
    """The fingerprint and the patterns that differ from it in one bit."""
    flipped = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return F.concat(F.array(bits), flipped)


def links(prints: DataFrame) -> DataFrame:
    """Links ``a, b`` between the distinct values of ``print`` that differ in at most two bits, enough to connect every component."""
    distinct = prints.select("print").distinct()
    standing = stored(distinct.select("print", F.explode(cells(place(F.col("print")))).alias("cell")), "cells")
    met = stored(standing.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("a"), F.max("print").alias("b")).filter("n > 1"), "met")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = met.filter((F.col("n") == 2) & near).select("a", "b").distinct()
    crowded = stored(standing.join(met.filter("n > 2").select("cell"), "cell", "left_semi").select("print").distinct(), "crowded")
    finer = stored(crowded.select("print", F.explode(patterns(F.col("print"))).alias("pattern")), "patterns")
    shared = finer.groupBy("pattern").agg(F.min("print").alias("a"), F.max("print").alias("last")).filter("a < last").select("pattern", "a")
    stars = finer.join(shared, "pattern").filter(F.col("print") != F.col("a")).select("a", F.col("print").alias("b")).distinct()
    return pairs.unionByName(stars)


def _same_documents(prints: DataFrame) -> DataFrame:
    """Links between the fingerprints of rows that share a document id."""
    known = prints.filter(F.col("doc_id").isNotNull())
    several = known.groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("last")).filter("a < last").select("doc_id", "a")
    return known.join(several, "doc_id").filter(F.col("print") != F.col("a")).select("a", F.col("print").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hexadecimal digits) and ``component_id``."""
    prints = stored(fingerprints(docs), "fingerprints")
    joined = components(links(prints).unionByName(_same_documents(prints)))
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    placed = stored(nodes.join(joined, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("component", "print").alias("component")), "placed")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(placed.join(least, "component").select("print", "component_id"), "named")
    return prints.join(named, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
