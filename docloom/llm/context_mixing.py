"""Language-model scores by online logistic context mixing.

Learning counts the words of the training documents. The commonest make a
prefix code (shorter for commoner words) with an end sign and an escape; each
step of a code is one binary decision. Three predictors know each decision: the
code's own frequencies, and two tables of counts hashed by the decision with
one and with two words of context. Their log odds are mixed with weights kept
per document and chosen by a gate (which of the tables have seen the context);
a last stage corrects the mix by how sure it is. Weights and corrections start
equal for all documents and learn online, after every block of words, from what
the document has shown so far. An escaped word is spelled byte by byte, each
after the two before it, as the uncommon training words are. The costs add up to the text's
bits, and to its bits per byte.

Exact word counts are needed for the base score. The common words are sent to
the tasks (``HEAD`` words at most); the other words of each document meet their
counts in a join, whatever their number.

Defined results: a null text is empty and has the end sign only; rows with equal
texts get equal scores, repeated rows included; a document without id trains
(fold 0); without training documents every decision is even.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import fold, mixed, opened, sent, stored, texts_of

FOLDS, HELD_OUT = 7, 2
HEAD = 16_384
TABLE_BITS = 20
ORDERS = 2
_SEGMENT_BITS = 14
# Words per online step, bytes of the documents that learn side by side, and words expanded into decisions at a time.
BLOCK = 64
_GROUP, _CHUNK = 600_000, 4_000
# Bytes of the documents scored and sent at a time: an Arrow batch of long ones, its copy in order and their other words would fill the memory.
_SCORED = 4_000_000
RATE, CORRECTION_RATE = 0.002, 0.01
_BUCKETS = 13
_END, _ESCAPE = 0, 1
# Places of the hash of two bytes.
_PAIRS = 4093
# Multipliers of a decision's slot in the tables: of its node, then of node and context together.
_NODE, _SLOT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x2545F4914F6CDD1D)
# 0 for the six characters between words, 1 for all others.
_INSIDE = bytes(len(bytes([i]).split()) for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def words_in(texts: pa.BinaryArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """``words_of`` all texts one behind the other, and their number by text."""
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")[edges[0]:edges[-1]].tobytes()
    edges = edges - edges[0]
    inside = np.frombuffer(data.translate(_INSIDE), bool)
    # A word begins behind a blank or at the beginning of a text, and ends before a blank or at the end of one.
    blank, edge = ~inside, np.zeros(len(data) + 1, bool)
    edge[edges] = True
    begins, ends = edge[:-1].copy(), edge[1:].copy()
    begins[1:] |= blank[:-1]
    ends[:-1] |= blank[1:]
    first, last = np.flatnonzero(begins & inside), np.flatnonzero(ends & inside)
    offsets = np.append(0, np.cumsum(last + 1 - first)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.frombuffer(data.lower(), np.uint8)[inside])])
    return words, np.diff(np.searchsorted(first, edges))


def listed(words: pa.BinaryArray) -> list[bytes]:
    """The values of an array without nulls that starts at its buffers' beginning; three times as fast as ``to_pylist``."""
    data = words.buffers()[2].to_pybytes() if len(words) else b""
    edges = np.frombuffer(words.buffers()[1], np.int32)[:len(words) + 1].tolist() if len(words) else [0]
    return [data[a:b] for a, b in zip(edges[:-1], edges[1:])]


def _parts(columns: Iterable[pa.Array], most: int = _GROUP) -> Iterator[pa.BinaryArray]:
    """All texts in order, nulls as empty, some ``most`` bytes at a time; a longer one stands alone."""
    held, size = [], 0
    for column in columns:
        column = pc.fill_null(column.cast(pa.binary()), b"")
        ends = np.cumsum(pc.binary_length(column).to_numpy(), dtype=np.int64)
        low = 0
        while low < len(column):
            before = int(ends[low - 1]) if low else 0
            # At least one text, at most a million: empty ones have no bytes.
            high = min(max(int(np.searchsorted(ends, before + most - size, "right")), low + 1), low + 1_000_000)
            held.append(column.slice(low, high - low))
            size += int(ends[high - 1]) - before
            low = high
            if low < len(column):
                yield pa.concat_arrays(held)
                held, size = [], 0
    if held:
        yield pa.concat_arrays(held)


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, some ``most`` bytes of the column at a time."""
    part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for low, high in zip(edges[:-1], edges[1:]):
        yield batch.slice(low, high - low)


# --- counts ------------------------------------------------------------------

def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def shown() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

    for batch in batches:
        for text in texts_of(batch.column(0)):
            counts.update(words_of(text))
            if len(counts) > 200_000:
                yield shown()
                counts.clear()
    yield shown()


def word_counts(training: DataFrame) -> DataFrame:
    """``token, c`` of all training texts (``text`` as binary)."""
    return stored(training.select("text").mapInArrow(_counted, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c")), "words")


def _head(counts: DataFrame, most: int) -> tuple[dict[bytes, int], int]:
    """The commonest words, at most ``most``, and the count of all others: words are in by their count's bin."""
    binned = F.floor(F.log2("c") * 32)
    bins = {r["b"]: (r["k"], r["n"]) for r in counts.groupBy(binned.alias("b")).agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("n")).collect()}
    held, lowest = 0, None
    for b in sorted(bins, reverse=True):
        if held + bins[b][0] > most:
            break
        held, lowest = held + bins[b][0], b
    rows = counts.filter(binned >= lowest).collect() if lowest is not None else []
    return {bytes(r["token"]): r["c"] for r in rows}, sum(n for b, (_, n) in bins.items() if lowest is None or b < lowest)


class Code:
    """Prefix code of end, escape and the head words: the decisions of each symbol and their log odds."""

    def __init__(self, head: dict[bytes, int], documents: int, others: int):
        ordered = sorted(head.items(), key=lambda x: (-x[1], x[0]))
        self.words = pa.array([word for word, _ in ordered], pa.binary())
        weights = [max(documents, 1), max(others, 1)] + [c for _, c in ordered]
        self.hashes = np.array([0, 0] + [xxhash.xxh3_64_intdigest(word) for word, _ in ordered], np.uint64)
        self.log_counts = np.log10(np.array([documents, 0] + [c for _, c in ordered], float) + 1)
        n = len(weights)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        total, parent, side = list(weights), [0] * (2 * n - 1), [0] * (2 * n - 1)
        while len(heap) > 1:
            (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
            node = len(total)
            total.append(wa + wb)
            parent[a] = parent[b] = node
            side[b] = 1
            heapq.heappush(heap, (wa + wb, node))
        odds = np.zeros(len(total), np.float32)
        for child in range(len(total) - 1):
            if side[child]:
                odds[parent[child]] = math.log(total[child] / (total[parent[child]] - total[child]))
        nodes, bits, start = [], [], np.zeros(n + 1, np.int64)
        for i in range(n):
            at = i
            while at != len(total) - 1:
                nodes.append(parent[at])
                bits.append(side[at])
                at = parent[at]
            start[i + 1] = len(nodes)
        self.start, self.count = start[:-1], np.diff(start)
        # By place in the codes of all symbols: as small as can be, so that they stay in the cache. By node: odds and share of the slot.
        self.node, self.bit = np.array(nodes, np.min_scalar_type(len(total))), np.array(bits, np.uint8)
        self.odds, self.slot = odds, np.arange(len(total), dtype=np.uint64) * _NODE * _SLOT

    def encode(self, words: pa.BinaryArray) -> np.ndarray:
        """The head's words from 2 on, all others ``_ESCAPE``."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), _ESCAPE - 2).to_numpy() + np.int32(2)

    def decisions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of decisions of each symbol, and of all decisions the nodes and outcomes."""
        count = self.count.take(symbols)
        at = np.repeat(self.start.take(symbols) - np.cumsum(count) + count, count)
        at += np.arange(len(at))
        return count, self.node.take(at).astype(np.int64), self.bit.take(at)


def _contexts(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Hashes of the last word and the last two words before each symbol, times the slots' multiplier.

    The documents stand one behind the other, each from ``first`` to its end sign, which has hash 0.
    """
    zero = np.zeros(1, np.uint64)
    one = np.concatenate([zero, hashes[:-1]])
    two = np.concatenate([zero, one[:-1]])
    two[first] = 0
    return [mixed(one + np.uint64(1)) * _SLOT, mixed(one * np.uint64(0x9E3779B97F4A7C15) + two + np.uint64(2)) * _SLOT]


def _slots(context: np.ndarray, count: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Slots of decisions: the high bits of (context + node * ``_NODE``) * ``_SLOT``, multiplied out."""
    out = np.repeat(context, count)
    out += slot
    out >>= np.uint64(64 - TABLE_BITS)
    return out.view(np.int64)


class Group:
    """Some documents in a row, whose texts have no nulls.

    ``sizes`` are symbols by document, end sign included; ``symbols`` and ``contexts`` those of all;
    ``rare`` are the words outside the head and ``holder`` the document of each.
    """

    def __init__(self, texts: pa.BinaryArray, code: Code):
        words, lengths = words_in(texts)
        encoded = code.encode(words)
        self.sizes = lengths + 1
        ends = np.cumsum(self.sizes) - 1
        inside = np.ones(len(words) + len(texts), bool)
        inside[ends] = False
        self.symbols = np.full(len(inside), _END, np.int32)
        self.symbols[inside] = encoded
        places = np.flatnonzero(encoded == _ESCAPE)
        self.rare = listed(words.take(pa.array(places)))
        self.holder = np.repeat(np.arange(len(texts)), lengths)[places]
        # Only words outside the head are hashed here.
        hashes = code.hashes.take(self.symbols)
        hashes[places + self.holder] = np.fromiter(map(xxhash.xxh3_64_intdigest, self.rare), np.uint64, len(self.rare))
        self.contexts = _contexts(hashes, ends - lengths)


# --- tables ------------------------------------------------------------------

def _learned(code):
    size = 1 << TABLE_BITS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(code)
        counts = np.zeros((ORDERS, 2, size), np.uint32)
        flat = [counts[order].reshape(-1) for order in range(ORDERS)]
        seen = np.uint32(1)
        for texts in _parts((batch.column(0) for batch in batches)):
            group = Group(texts, own)
            for low in range(0, len(group.symbols), _CHUNK):
                count, node, bit = own.decisions(group.symbols[low:low + _CHUNK])
                slot, outcome = own.slot.take(node), bit.astype(np.int64) * size
                for order in range(ORDERS):
                    np.add.at(flat[order], _slots(group.contexts[order][low:low + _CHUNK], count, slot) + outcome, seen)
        width = 1 << _SEGMENT_BITS
        for order in range(ORDERS):
            for segment in range(size >> _SEGMENT_BITS):
                part = counts[order, :, segment * width:(segment + 1) * width]
                if part.any():
                    yield pa.RecordBatch.from_arrays([
                        pa.array([order * (size >> _SEGMENT_BITS) + segment], pa.int32()),
                        pa.array([part.astype(np.uint16 if part.max() < 65536 else np.uint32).tobytes()], pa.binary())], names=["segment", "counts"])

    return scan


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Log odds of each slot in sixteenths, 0 where nothing was seen."""
    width = 1 << _SEGMENT_BITS
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(counts, np.uint16 if len(counts) == 4 * width else np.uint32).reshape(2, width)
            if segment in totals:
                totals[segment] += part
            else:
                totals[segment] = part.astype(np.float64)
    odds = []
    for total in totals.values():
        value = np.clip(np.rint(16 * np.log((total[1] + 0.4) / (total[0] + 0.4))), -127, 127)
        odds.append(np.where(total.sum(axis=0) > 0, value, 0).astype(np.int8).tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(odds, pa.binary())], names=["segment", "odds"])


def tables(training: DataFrame, code) -> np.ndarray:
    """Log odds by order and slot: ``ORDERS`` times 2^``TABLE_BITS`` bytes."""
    partial = training.select("text").mapInArrow(_learned(code), "segment int, counts binary")
    out = np.zeros((ORDERS << (TABLE_BITS - _SEGMENT_BITS), 1 << _SEGMENT_BITS), np.int8)
    for row in partial.repartition("segment").mapInArrow(_summed, "segment int, odds binary").toLocalIterator():
        out[row["segment"]] = np.frombuffer(row["odds"], np.int8)
    return out.reshape(ORDERS, 1 << TABLE_BITS)


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the words and their closing zeros, after a hash of the two bytes before it.

    Two zeros stand between words, so a word's first byte does not depend on the word that happens to stand before it.
    """
    joined = np.frombuffer(b"\0\0" + b"\0\0".join(words) + b"\0", np.uint8).astype(np.int32)
    before = (joined[:-2] * 57 + joined[1:-1] * 2609) % _PAIRS
    # The second zero after each word but the last is not coded.
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)[:-1] - 1
    coded = np.ones(len(before), bool)
    coded[ends] = False
    return before[coded], joined[2:][coded]


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((_PAIRS, 256), np.int64)
    for batch in batches:
        words = list(texts_of(batch.column(0)))
        if words:
            before, byte = _letters(words)
            times = np.repeat(batch.column(1).to_numpy(), [len(w) + 1 for w in words])
            counts += np.bincount(before * 256 + byte, times, _PAIRS * 256).astype(np.int64).reshape(_PAIRS, 256)
    first, second = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), pa.array(counts[first, second])],
                                     names=["before", "byte", "n"])


def spelling(counts: DataFrame, floor: int) -> np.ndarray:
    """Bits of a byte after two others, from the words that are not in the head."""
    rows = counts.filter(F.col("c") < floor).mapInArrow(_spelled, "before int, byte int, n long").groupBy("before", "byte").agg(F.sum("n").alias("n"))
    table = np.full((_PAIRS, 256), 0.02)
    # At most 4,096 times 256 sums.
    for r in rows.toLocalIterator():
        table[r["before"], r["byte"]] += r["n"]
    return -np.log2(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


# --- scoring -----------------------------------------------------------------

def mixed_bits(group: Group, code: Code, odds: np.ndarray) -> np.ndarray:
    """Bits of each document of a group.

    Block by block over all documents at once; a block is coded with what the
    document's earlier blocks have taught.
    """
    documents = len(group.sizes)
    doc = np.repeat(np.arange(documents), group.sizes)
    block = (np.arange(len(doc)) - np.repeat(np.cumsum(group.sizes) - group.sizes, group.sizes)) // BLOCK
    order = np.argsort(block, kind="stable")
    doc, block, symbols = doc[order], block[order], group.symbols[order]
    contexts = [c[order] for c in group.contexts]
    inputs = ORDERS + 1
    weights = np.repeat(np.array([[0.6]] + [[0.3]] * ORDERS, np.float32), documents * 4, axis=1)
    correction = np.zeros(documents * _BUCKETS, np.float32)
    bits = np.zeros(documents)
    edges = np.searchsorted(block, np.arange(block[-1] + 2)).tolist()
    for low, high in zip(edges[:-1], edges[1:]):
        # Of a long block row, part after part with the same weights, learnt at its end.
        gradient, late = np.zeros(weights.shape), np.zeros(len(correction))
        for a in range(low, high, _CHUNK):
            b = min(a + _CHUNK, high)
            count, node, bit = code.decisions(symbols[a:b])
            owner = np.repeat(doc[a:b], count)
            slot, side = code.slot.take(node), 1 - 2 * bit.astype(np.float32)
            x = [code.odds.take(node)]
            seen = np.zeros(len(node), np.uint8)
            for k in range(ORDERS):
                value = odds[k].take(_slots(contexts[k][a:b], count, slot))
                seen |= (value != 0).view(np.uint8) << np.uint8(k)
                x.append(value * np.float32(1 / 16))
            gate = owner * 4
            gate += seen
            mix = weights[0].take(gate)
            mix *= x[0]
            for k in range(1, inputs):
                mix += weights[k].take(gate) * x[k]
            # Both logistic functions of a decision by one exponential each, on its own side.
            bucket = owner * _BUCKETS
            bucket += np.clip(mix + np.float32(_BUCKETS / 2), 0, _BUCKETS - 1).astype(np.int8)
            wrong = _exp(side, mix + correction.take(bucket))
            first = np.flatnonzero(np.concatenate([[True], doc[a + 1:b] != doc[a:b - 1]]))
            bits[doc[a:b][first]] += np.add.reduceat(np.log1p(wrong), (np.cumsum(count) - count)[first], dtype=np.float64) / math.log(2)
            error = _error(side, _exp(side, mix))
            for k, value in enumerate(x):
                gradient[k] += np.bincount(gate, error * value, weights.shape[1])
            late += np.bincount(bucket, _error(side, wrong), len(correction))
        weights += (RATE * gradient).astype(np.float32)
        correction += (CORRECTION_RATE * late).astype(np.float32)
    return bits


def _exp(side: np.ndarray, mix: np.ndarray) -> np.ndarray:
    out = side * mix
    np.minimum(out, 60, out=out)
    return np.exp(out, out=out)


def _error(side: np.ndarray, odds: np.ndarray) -> np.ndarray:
    out = odds / (1 + odds)
    out *= side
    return np.negative(out, out=out)


class Model:
    def __init__(self, code: Code, odds: np.ndarray, bytes_bits: np.ndarray):
        self.code, self.odds, self.bytes_bits = code, odds, bytes_bits

    def spell(self, group: Group) -> np.ndarray:
        """Bits of the rare words of each document."""
        if not group.rare:
            return np.zeros(len(group.sizes))
        before, byte = _letters(group.rare)
        owner = np.repeat(group.holder, np.fromiter(map(len, group.rare), np.int64, len(group.rare)) + 1)
        return np.bincount(owner, self.bytes_bits.take(before * 256 + byte), len(group.sizes))


def _scored(model):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(model)
        code = own.code
        for batch in (part for whole in batches for part in _slices(whole, 2, _SCORED)):
            n = batch.num_rows
            tokens, known = np.zeros(n, np.int64), np.zeros(n, np.int64)
            base, bits = np.zeros(n), np.zeros(n)
            high, low = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            # The other words of each text, in the order of ``order``: Arrow arrays, as objects of all texts would fill the memory.
            sizes, parts = np.zeros(n, np.int64), []
            # Documents of like length learn side by side.
            lengths = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy().astype(np.int64)
            order = np.argsort(lengths, kind="stable")
            done = 0
            for texts in _parts([batch.column(2).take(pa.array(order))]):
                group = Group(texts, code)
                at = order[done:done + len(texts)]
                for row, text in zip(at.tolist(), texts_of(texts)):
                    digest = xxhash.xxh3_128_intdigest(text)
                    high[row], low[row] = digest >> 64, digest & 0xFFFFFFFFFFFFFFFF
                edge = np.searchsorted(group.holder, np.arange(len(at) + 1))
                tokens[at], known[at] = group.sizes, group.sizes - np.diff(edge)
                base[at] = np.add.reduceat(code.log_counts[group.symbols], np.cumsum(group.sizes) - group.sizes)
                bits[at] = own.spell(group) + mixed_bits(group, code, own.odds)
                names, times = [], []
                for k, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist()), done):
                    counted = Counter(group.rare[a:b])
                    names.extend(counted)
                    times.extend(counted.values())
                    sizes[k] = len(counted)
                parts.append((pa.array(names, pa.binary()), pa.array(times, pa.int64())))
                done += len(at)
            columns = [pa.concat_arrays([p[i] for p in parts]) if parts else pa.array([], kind) for i, kind in enumerate((pa.binary(), pa.int64()))]
            others = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.StructArray.from_arrays(columns, names=["token", "n"]))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(tokens), pa.array(known),
                pa.array(lengths), pa.array(base), pa.array(bits), others.take(pa.array(np.argsort(order)))],
                names=["doc_id", "held_out", "high", "low", "n_tokens", "known", "size", "base", "bits", "others"])

    return scan


def scored(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """Per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
                       F.col("text").cast("binary").alias("text"))
    training = rows.filter(~F.col("held_out"))
    counts = word_counts(training)
    documents = training.count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    train_tokens, vocabulary = sums[0] + documents, sums[1] + (documents > 0)
    common, rest = _head(counts, head)
    floor = min(common.values(), default=1 << 62)
    code = Code(common, documents, rest)
    odds = tables(training, sent(docs.sparkSession, code))
    model = sent(docs.sparkSession, Model(code, odds, spelling(counts, floor)))
    done = stored(rows.mapInArrow(_scored(model), (
        "doc_id long, held_out boolean, high long, low long, n_tokens long, known long, size long, base double, bits double, "
        "others array<struct<token:binary,n:long>>")), "scored")

    # The other words of each text meet their counts; a text held by m rows is summed m times and divided by m.
    rare = done.select("high", "low", F.explode("others").alias("o")).select("high", "low", "o.token", "o.n")
    met = rare.join(counts.filter(F.col("c") < floor), "token")
    sums_by_text = met.groupBy("high", "low").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log"), F.sum("n").alias("met"))
    held_by = done.filter(F.size("others") > 0).groupBy("high", "low").agg(F.count(F.lit(1)).alias("m"))
    by_text = stored(sums_by_text.join(held_by, ["high", "low"]).select(
        "high", "low", (F.col("log") / F.col("m")).alias("log"), F.expr("met div m").alias("met")), "rare")
    per_token = math.log10(train_tokens + vocabulary + 1) if train_tokens + vocabulary else 0.0
    return done.drop("others").join(by_text, ["high", "low"], "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known") if documents else F.lit(0).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("log", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"),
        (-F.col("bits") * math.log10(2)).alias("score"), (F.col("bits") / F.greatest("size", F.lit(1))).alias("bits_per_byte"))
