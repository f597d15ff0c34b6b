"""Conversation repair, SimHash near-duplicates and vector codes against brute force, SQL and odd rows."""

import hashlib
import heapq
import math
import random
import re

import numpy as np
import pytest
import xxhash

from docloom.llm import conversation_repair, simhash_dedup, vector_codes
from tests.llm.conftest import ODD

# --- 11 ----------------------------------------------------------------------


def cheapest(rows):
    """Cost and audit by uniform-cost search over (rows used, output state); ``rows`` has (initial, fault)."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit
        for new in after[last].values():
            if new in "ua":
                heapq.heappush(heap, (cost + 2, audit + "I", i, new))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if initial in after[last]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, initial))
                for new in after[last].values():
                    if new in "ua":
                        heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, new))
    raise AssertionError


def repaired_by_hand(rows):
    """Figures and repaired lines of one conversation of (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        stripped = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    cost, audit = cheapest(list(zip(initials, faults)))
    edits = iter(rows)
    lines = []
    odd = sum(e != "D" for e in audit) % 2
    for edit in audit:
        row = None if edit == "I" else next(edits)
        if edit != "D":
            role = row[1] if edit == "K" else ("user", "assistant")[(len(lines) - odd) % 2]
            lines.append(f"{role}:{row[2] if row else ''}")
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, lines)


def conversations(seed, count, longest):
    rng = random.Random(seed)
    out = []
    for conv in range(count):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "unknown"])
            text = rng.choice([f"Text {turn}.", f"Text {turn}", "Same!", "Same!", "", " \n", None, "no end. \t", "Why? ..a"])
            out.append((conv if conv else None, rng.choice([None, turn, turn, turn + 1, turn * 2]), role, text, "x"))
    return out


@pytest.mark.parametrize("segment,longest", [(512, 9), (2, 9), (5, 60)])
def test_repairs_are_the_cheapest(spark, monkeypatch, segment, longest):
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    table = conversations(segment, 120, longest)
    rows = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, sig string").repartition(5)
    faults, lines = conversation_repair.repairs(rows)
    text = {}
    for r in sorted(lines.collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.place)):
        text.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    by_conv = {}
    for conv, *row, _ in table:
        by_conv.setdefault(conv, []).append(tuple(row))
    got = {r.conv_id: r for r in faults.collect()}
    assert set(got) == set(by_conv)
    for conv, own in by_conv.items():
        gaps, blank, duplicate, truncated, illegal, cost, audit, wanted = repaired_by_hand(own)
        r = got[conv]
        assert (r.gaps or 0, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (gaps, blank, duplicate, truncated, illegal, cost, audit)
        assert text.get(conv, []) == wanted


def test_suffixes_are_computed_once():
    nodes = conversation_repair.Suffixes([[(0, ""), (4, "II"), (2, "I"), (0, "")]])
    rng = random.Random(3)
    signatures = {"".join(rng.choices("suaoSUAx", k=rng.randint(1, 9))) for _ in range(400)}
    for signature in sorted(signatures, key=lambda s: s[::-1]):
        cost, audit = nodes.of(signature)[0][0]
        rows = [("s" if c == "x" else c.lower(), "blank" if c == "x" else "truncated" if c.isupper() else "") for c in signature]
        assert (cost, audit) == cheapest(rows)
    assert nodes.nodes == len({s[i:] for s in signatures for i in range(len(s))})


def test_repair_of_one_long_conversation_and_many_equal_rows(spark):
    rows = [(7, t, ("user", "assistant")[t % 2], f"Answer {t}.") for t in range(3000)] + [(7, 3000, "user", "Again.")] * 1500 + [(8, None, "user", "Hi.")]
    faults, lines = conversation_repair.repairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in faults.collect()}
    assert got[7].duplicate == 1499 and got[7].illegal == 1499 and got[7].cost == 3 * 1499 + 2
    assert got[7].audit == "K" * 3001 + "D" * 1499 + "I" and lines.filter("conv_id = 7").count() == 3002
    assert got[8].audit == "KI" and got[8].gaps is None


def test_summary_of_damaged_conversations_matches_sql(spark, duck, tmp_path):
    table = [(c, t, r, x) for c, t, r, x, _ in conversations(11, 80, 12)] + [(None, None, None, None)] * 3 + [(500, 0, "user", None)]
    # Rows of one turn that differ are told apart by role and digest in both engines.
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    frame.write.parquet(str(tmp_path / "c"))
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    got = conversation_repair.summary(spark.read.parquet(str(tmp_path / "c")))
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({conversation_repair.ORACLE})").fetchall()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_repair_of_empty_tables(spark):
    assert conversation_repair.summary(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- 12 ----------------------------------------------------------------------


def fingerprint_by_hand(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, documents, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CHUNK", 7)
    rng = random.Random(5)
    words = [f"W{i}é" for i in range(50)]
    rows = [(i, rng.choice(["  ", "\n"]).join(rng.choices(words, k=i % 40)), "en", "a") for i in range(200)] + ODD
    got = simhash_dedup.near_duplicates(documents(rows))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in got.collect()) == sorted(
        (d is None, d or 0, f"{fingerprint_by_hand(t):016x}") for d, t, _, _ in rows)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_connect_what_differs_in_two_bits(spark):
    rng = random.Random(9)
    centres = [0, (1 << 64) - 1] + [rng.getrandbits(64) for _ in range(20)]
    prints = {c for c in centres}
    for c in centres:
        for _ in range(40):
            x = c
            for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    want = {}
    for p in prints:
        want.setdefault(find(p), set()).add(signed(p))
    from docloom.llm.components import components
    found = simhash_dedup.links(spark.createDataFrame([(signed(p),) for p in prints], "print long")).collect()
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 2 for r in found)
    placed = dict(map(tuple, components(spark.createDataFrame([(r.a, r.b) for r in found], "a long, b long")).collect()))
    got = {}
    for p in map(signed, prints):
        got.setdefault(placed.get(p, p), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_rows_of_one_id_and_without_id(spark, documents):
    a, b, c = "one two three four five", "six seven eight nine ten", "red green blue black white"
    rows = [(3, a, "en", "s"), (5, a, "en", "s"), (5, b, "en", "s"), (9, b, "en", "s"), (None, b, "en", "s"), (None, c, "en", "s"), (None, a, "de", None)]
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(documents(rows)).collect())
    fa, fb, fc = (f"{fingerprint_by_hand(t):016x}" for t in (a, b, c))
    assert got == sorted([("3", fa, 3), ("5", fa, 3), ("5", fb, 3), ("9", fb, 3), ("None", fb, 3), ("None", fc, None), ("None", fa, 3)])
    assert simhash_dedup.near_duplicates(documents([(1, "x", "en", "a")]).limit(0)).count() == 0


# --- 13 ----------------------------------------------------------------------


def coded_by_hand(rows):
    """Rows of (vec_id, vector, label), every part compared with all entries in whole numbers."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    length = len(kept[0][1]) // 8
    cut = [[v[p * length:(p + 1) * length] for p in range(8)] for _, v, _ in kept]
    starts = {}
    for (i, v, _), parts in zip(kept, cut):
        if i is not None and (i not in starts or v < sum(starts[i], [])):
            starts[i] = parts
    books = [[starts[i][p] for i in sorted(starts)[:16]] for p in range(8)]

    def nearest():
        return [[min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p])) for p, part in enumerate(parts)] for parts in cut]

    for _ in range(6):
        best = nearest()
        for p in range(8):
            for k in range(len(books[p])):
                own = [parts[p] for parts, b in zip(cut, best) if b[p][1] == k]
                if own:
                    books[p][k] = [sum(column) // len(own) for column in zip(*own)]
    best = nearest()
    errors = [sum(d for d, _ in b) for b in best]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in b), e, by_label[label], sha) for (i, _, label), b, e in zip(kept, best, errors)]


VECTORS = "vec_id long, embedding array<float>, label int, codes string, row int"


@pytest.mark.parametrize("dim,count,grid", [(16, 300, 8), (8, 9, 4), (24, 200, 3)])
def test_codes_equal_plain_rounds(spark, dim, count, grid):
    rng = random.Random(dim)

    def vector():
        # A coarse grid gives many equal distances.
        return [float(np.float32(rng.randint(-grid, grid) / 4096 * rng.choice([1, 1, 300]))) for _ in range(dim)]

    rows = [(i, vector(), rng.choice([0, 1, None])) for i in range(count)]
    rows += rows[:3] + [(None, vector(), 1), (2, vector(), 0), (count, rows[0][1], 5)]
    bad = [(-1, None, 1), (-2, [None] + [0.0] * (dim - 1), 1), (-3, [math.nan] + [0.0] * (dim - 1), 1), (-4, [math.inf] * dim, 0), (-5, [], 0)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], VECTORS).repartition(3)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, vector_codes.coded(table).collect()), key=key) == sorted(coded_by_hand(rows), key=key)


def test_active_entries_give_what_a_full_scan_gives():
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (500, 4))
    book = rng.integers(-3, 4, (16, 4))
    code, dist = vector_codes.assigned(x, book)
    for _ in range(20):
        moved = rng.random(16) < rng.choice([0, 0.1, 0.5])
        book = np.where(moved[:, None], rng.integers(-3, 4, (16, 4)), book)
        code, dist = vector_codes.assigned(x, book, moved, code, dist)
        full = vector_codes.assigned(x, book)
        assert (code == full[0]).all() and (dist == full[1]).all()


def test_codes_without_ids_or_rows(spark):
    table = spark.createDataFrame([(None, [1.0] * 8, 1, "x", 1)], VECTORS)
    assert [tuple(r)[:4] for r in vector_codes.coded(table).collect()] == [(None, None, None, None)]
    assert vector_codes.coded(table.limit(0)).count() == 0
    assert vector_codes.coded(spark.createDataFrame([(1, [1.0] * 7, 1, "x", 1), (2, None, None, None, None)], VECTORS)).count() == 0
