"""Cheapest repair of conversations' role order over one automaton of all role and fault signatures.

A row of a conversation is a symbol: the initial of its role (s, u, a or other),
a capital if the text is truncated, x if the row must go (blank, or role and text
were seen before). Edits are Keep, Rerole (to user or assistant), Delete and
Insert (an empty text of user or assistant); what remains must have the role
initials (s?(ua)+)?. Of the cheapest edits the ASCII-least initials are taken.

The cheapest way on from a row depends on the signature's suffix and the grammar
state only. Distinct signatures are sorted by their reversal and dealt by range,
so those with a common ending are neighbours, and the automaton is built from the
end: a node is a symbol and the node after it, the path of the last signature is
kept, and a new one adds the nodes before the shared suffix. Each node has its
cost to go and best audit suffix for every grammar state computed once, however
many conversations pass it (a path cut by two ranges is computed in both).

A conversation may hold any share of all rows. Rows shrink to runs (equal rows
of a turn, counted) before any shuffle but the last; runs are dealt by range over
conversation and turn, and a signature is cut into segments of 512 symbols. A
segment of a longer conversation gets a table of cost and edits from each state
to each state; a pass over the segments, in order, picks the states between. All
edits of a segment end with an edit of a row, so none is the beginning of
another, and ties can be settled segment by segment. At the end the rows go, by
conversation, through a stream that applies the edits row by row: the repaired
text of one conversation is hashed in one task, as SHA-256 must, but not held.

Defined results: nulls count as one space, except for the conversation and the
turn, where a null is a value of its own (turns: first, left out of gaps). Rows of
one turn are taken by role, then by the MD5 digest of their text. An empty role
has no legal initial. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACE, stored

SEGMENT = 512
# Grammar states: nothing yet, after the system row, after a user row, after an assistant row.
STATES = range(4)
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
# The only role that an insertion or a change of role can add, by the state it leads to.
ADDED = {0: 2, 1: 2, 2: 3, 3: 2}
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
# What is left to insert when the rows are used up.
TAIL = {0: "", 1: "II", 2: "I", 3: ""}
LEGAL = ("su", "ua", "au")
NONE = 1 << 60

Best = tuple[int, str]


def _row_edits(symbol: str) -> list[list[tuple[int, str, int]]]:
    """For each state the ways (cost, edits, next state) over one row, insertions before it included; the best one to each next state."""
    kind, cut = symbol.lower(), int(symbol.isupper())
    ways = []
    for start in STATES:
        best: dict[int, Best] = {}
        state, before = start, ""
        for _ in range(3):
            options = [("D", state, COST["D"])]
            if kind != "x":
                options.append(("R", ADDED[state], COST["R"] + cut))
                if (state, kind) in KEEP:
                    options.append(("K", KEEP[state, kind], COST["K"] + cut))
            for edit, after, cost in options:
                way = (cost + COST["I"] * len(before), before + edit)
                best[after] = min(best.get(after, (NONE, "")), way)
            state, before = ADDED[state], before + "I"
        ways.append([(cost, edits, after) for after, (cost, edits) in best.items()])
    return ways


WAYS = {symbol: _row_edits(symbol) for symbol in "suaoSUAOx"}


def _ahead(symbol: str, after: list[Best]) -> list[Best]:
    """Cost and edits from each state over a row and on, given those behind the row."""
    return [min((cost + after[state][0], edits + after[state][1]) for cost, edits, state in ways if after[state][0] < NONE)
            if any(after[state][0] < NONE for _, _, state in ways) else (NONE, "") for ways in WAYS[symbol]]


class Suffixes:
    """The automaton's nodes on the path of the last signature; signatures come sorted by their reversal.

    ``ends`` holds a list per goal: cost and edits from each state when no row is left.
    """

    def __init__(self, ends: list[list[Best]]):
        self.symbols: list[str] = []
        self.values = [ends]
        self.nodes = 0

    def of(self, signature: str) -> list[list[Best]]:
        reverse = signature[::-1]
        shared = 0
        for old, new in zip(self.symbols, reverse):
            if old != new:
                break
            shared += 1
        del self.symbols[shared:], self.values[shared + 1:]
        for symbol in reverse[shared:]:
            self.symbols.append(symbol)
            self.values.append([_ahead(symbol, goal) for goal in self.values[-1]])
            self.nodes += 1
        return self.values[-1]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and audit of signatures of whole conversations."""
    nodes = Suffixes([[(COST["I"] * len(TAIL[s]), TAIL[s]) for s in STATES]])
    for batch in batches:
        best = [nodes.of(signature)[0][0] for signature in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.string())],
                                         names=["sig", "cost", "audit"])


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For segments: cost, rank among the exits, and edits, from each state to each state."""
    nodes = Suffixes([[(0, "") if s == goal else (NONE, "") for s in STATES] for goal in STATES])
    for batch in batches:
        costs, ranks, edits = [], [], []
        for signature in batch.column(0).to_pylist():
            goals = nodes.of(signature)
            table = [goals[goal][s] for s in STATES for goal in STATES]
            costs.append([c for c, _ in table])
            edits.append([e for _, e in table])
            order = [sorted(e for _, e in table[4 * s:4 * s + 4]) for s in STATES]
            ranks.append([order[i // 4].index(e) for i, (_, e) in enumerate(table)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int64())),
                                          pa.array(edits, pa.list_(pa.string()))], names=["sig", "costs", "ranks", "edits"])


def _by_suffix(signatures: DataFrame) -> DataFrame:
    """Distinct signatures, neighbours in a task where they end alike."""
    distinct = stored(signatures.select("sig").distinct(), "signatures")
    return distinct.repartitionByRange(F.reverse("sig")).sortWithinPartitions(F.reverse("sig"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the sorted runs of a task into segments of one conversation each.

    Gives the signature, the first and last initial and the illegal neighbours inside.
    """
    conv, known, symbols, ends, illegal, part, count = None, False, "", ["", ""], 0, 0, 0
    out: list[tuple] = []

    def close() -> None:
        nonlocal symbols, illegal, count
        if symbols:
            out.append((conv, (part << 40) + count, symbols, *ends, illegal))
            count += 1
        symbols, illegal = "", 0

    for batch in batches:
        for own, initial, symbol, n, part in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if not known or own != conv:
                close()
                conv, known = own, True
            while n:
                if len(symbols) == SEGMENT:
                    close()
                if symbols:
                    illegal += ends[1] + initial not in LEGAL
                else:
                    ends = [initial, initial]
                take = min(n, SEGMENT - len(symbols))
                # Equal initials are never legal neighbours; only a run's first row may stay.
                illegal += take - 1
                symbols += symbol + "x" * (take - 1)
                ends = [ends[0], initial]
                symbol, n = "x", n - take
        if len(out) >= 4096:
            yield _record(out)
            out.clear()
    close()
    yield _record(out)


def _record(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)],
                                      names=["conv_id", "at", "sig", "head", "tail", "illegal"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments come by conversation from the last to the first; gives the states at the ends of each.

    Of a conversation 12 bytes per segment of 512 rows are held.
    """
    conv, places, exits, cost, illegal, first = None, array("q"), bytearray(), [], 0, ""
    out: list[tuple] = []

    def close() -> None:
        state, crossing = 0, illegal
        total = cost[0] if places else 0
        for i in range(len(places) - 1, -1, -1):
            after = exits[4 * i + state]
            out.append((conv, places[i], 4 * state + after, TAIL[after] if i == 0 else "", total, crossing))
            state, total, crossing = after, 0, 0
        del places[:], exits[:]

    for batch in batches:
        for own, at, head, tail, costs, ranks in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if not places or own != conv:
                close()
                conv, cost, illegal = own, [COST["I"] * len(TAIL[s]) for s in STATES], 0
            else:
                illegal += tail + first not in LEGAL
            first = head
            best = [min((costs[4 * s + q] + cost[q], ranks[4 * s + q], q) for q in STATES) for s in STATES]
            places.append(at)
            exits.extend(q for _, _, q in best)
            cost = [c for c, _, _ in best]
        if len(out) >= 4096:
            yield _choice(out)
            out.clear()
    close()
    yield _choice(out)


def _choice(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)],
                                      names=["conv_id", "at", "way", "end", "cost", "crossing"])


def _spaced(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that CRC-32 of ``conv_id:turn`` deals to each row."""
    rows = _spaced(conversations)

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    hit = rows.withColumn("kind", kind).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return hit.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                      F.explode(copies).alias("copy")).drop("copy")


def _digest() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def runs(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one: ``conv_id, turn, role, digest, n, blank, cut`` and ``first``, whether the first is no duplicate."""
    blank = ~F.col("text").rlike(SPACE.replace("[", "[^"))
    cut = ~F.col("text").rlike(rf"[.!?]{SPACE}*\z")
    slim = rows.select("conv_id", "turn", "role", _digest().alias("digest"), blank.alias("blank"), cut.alias("cut"))
    slim = stored(slim.groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.count(F.lit(1)).alias("n")), "runs")
    place = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    again = slim.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("start"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "start")
    same = slim["conv_id"].eqNullSafe(again["_conv"]) & (slim["role"] == again["_role"]) & (slim["digest"] == again["_digest"])
    return slim.join(again, same, "left").select(
        "conv_id", "turn", "role", "digest", "n", "blank", (F.col("cut") & ~F.col("blank")).alias("cut"),
        (F.col("start").isNull() | (F.col("start") == place)).alias("first"))


def audits(found: DataFrame) -> DataFrame:
    """``conv_id, cost, audit, illegal`` of the conversations of ``runs``."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("blank") | ~F.col("first"), "x").when(F.col("cut"), F.upper(kind)).otherwise(kind)
    dealt = found.repartitionByRange("conv_id", "turn", "role", "digest").sortWithinPartitions("conv_id", "turn", "role", "digest")
    cut = stored(dealt.select("conv_id", initial.alias("initial"), symbol.alias("symbol"), "n", F.spark_partition_id().cast("long").alias("part")).mapInArrow(
        _segments, "conv_id long, at long, sig string, head string, tail string, illegal long"), "segments")
    counts = stored(cut.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("illegal").alias("illegal"), F.min("at").alias("only")), "counts")

    short = cut.join(counts.filter("n = 1").select(F.col("only").alias("at")), "at", "left_semi")
    best = stored(_by_suffix(short).mapInArrow(_whole, "sig string, cost long, audit string"), "whole")
    single = short.join(best, "sig").select("conv_id", "cost", "audit", "illegal")

    long_ = counts.filter("n > 1").select(F.col("conv_id").alias("_conv"), F.col("illegal").alias("inside"))
    pieces = cut.join(long_, F.col("conv_id").eqNullSafe(F.col("_conv")))
    tables = stored(_by_suffix(pieces).mapInArrow(_tables, "sig string, costs array<long>, ranks array<long>, edits array<string>"), "tables")
    pieces = stored(pieces.join(tables, "sig").select("conv_id", "at", "head", "tail", "costs", "ranks", "edits", "inside"), "pieces")
    ordered = pieces.select("conv_id", "at", "head", "tail", "costs", "ranks").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("at"))
    ways = ordered.mapInArrow(_chosen, "conv_id long, at long, way int, end string, cost long, crossing long")
    named = ways.drop("conv_id").join(pieces.select("conv_id", "at", "edits", "inside"), "at").select(
        "conv_id", "at", F.concat(F.col("edits")[F.col("way")], F.col("end")).alias("edits"), "cost", "crossing", "inside")
    several = named.groupBy("conv_id").agg(
        F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "edits"))), lambda x: x["edits"]), "").alias("audit"),
        (F.max("inside") + F.sum("crossing")).alias("illegal"))
    return single.unionByName(several)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation, its audit first, then its rows in order; gives the rows after the edits."""
    conv, audit, at, made, odd = None, "", 0, 0, 0
    out: list[tuple] = []

    def added() -> str:
        # Users and assistants alternate after the system row.
        return "user" if (made - odd) % 2 == 0 else "assistant"

    def inserted() -> None:
        nonlocal at, made
        while at < len(audit) and audit[at] == "I":
            out.append((conv, made, "I", added(), ""))
            at, made = at + 1, made + 1

    for batch in batches:
        for own, given, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if given is not None:
                inserted()
                conv, audit, at, made = own, given, 0, 0
                odd = (len(audit) - audit.count("D")) % 2
                continue
            inserted()
            edit = audit[at]
            at += 1
            if edit != "D":
                out.append((conv, made, edit, role if edit == "K" else added(), text))
                made += 1
            if len(out) >= 1024:
                yield _lines(out)
                out.clear()
    inserted()
    yield _lines(out)


def _lines(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)],
                                      names=["conv_id", "place", "edit", "role", "text"])


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The conversations after the edits: ``conv_id, place, edit, role, text``, each conversation in order within one task.

    ``found`` has ``conv_id, audit``.
    """
    head = found.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                        F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("digest"))
    body = _spaced(rows).select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", _digest().alias("digest"))
    ordered = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "digest")
    return ordered.select("conv_id", "audit", "role", "text").mapInArrow(_applied, "conv_id long, place long, edit string, role string, text string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state, out = None, None, []
    for batch in batches:
        for own, place, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
            if place == 0:
                if state:
                    out.append((conv, state.hexdigest()))
                conv, state = own, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
    if state:
        out.append((conv, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], names=["conv_id", "sha"])


def repairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per conversation ``conv_id``, its faults, ``cost`` and ``audit``; and the ``repaired`` rows."""
    rows = _spaced(rows)
    found = stored(runs(rows), "faults")
    best = stored(audits(found), "audits")
    fresh = F.col("first") & ~F.col("blank")
    counts = found.groupBy("conv_id").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - fresh.cast("long"))).alias("duplicate"),
        F.sum((fresh & F.col("cut")).cast("long")).alias("truncated"),
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    nothing = {name: F.lit(None).cast(kind) for name, kind in (("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("gaps", "long"))}
    both = counts.select("conv_id", *nothing, *(F.lit(None).cast(k).alias(n) for n, k in (("illegal", "long"), ("cost", "long"), ("audit", "string")))).unionByName(
        best.select("conv_id", *(v.alias(n) for n, v in nothing.items()), "illegal", "cost", "audit"))
    names = [*nothing, "illegal", "cost", "audit"]
    return both.groupBy("conv_id").agg(*(F.max(n).alias(n) for n in names)), repaired(rows, best)


def summary(conversations: DataFrame) -> DataFrame:
    """Damages the conversations, repairs them, and gives one row of figures and the digest of the repaired rows per original conversation."""
    faults, lines = repairs(damaged(conversations))
    hashes = lines.mapInArrow(_hashed, "conv_id long, sha string")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = [
        conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), faults, hashes.withColumnRenamed("sha", "repaired_sha256")]
    every = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return every.groupBy("conv_id").agg(
        *(F.coalesce(F.max(n), F.lit(0)).cast("long").alias(n) for n in names), F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


# The same in DuckDB: the grammar row by row from the end, for all conversations at once.
ORACLE = r"""
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM conversations, crc),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, range(2) AS twice(i) WHERE kind <> 0 AND (i = 0 OR kind = 3)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM d),
f AS MATERIALIZED (
  SELECT *, left(role, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM p),
ins(p, n, r) AS (VALUES (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (0, 1, 2), (1, 1, 2), (2, 1, 3), (3, 1, 2), (0, 2, 3), (1, 2, 3), (2, 2, 2), (3, 2, 3)),
keep(p, c, r) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
way AS (
  SELECT conv_id, i, ins.p, 2 * n + e.cost AS cost, repeat('I', n) || e.e AS edits, e.r
  FROM f, ins, LATERAL (
    SELECT 3 AS cost, 'D' AS e, ins.r AS r
    UNION ALL SELECT 2 + CAST(fault = 'truncated' AS INT), 'R', CASE ins.r WHEN 2 THEN 3 ELSE 2 END WHERE fault NOT IN ('blank', 'duplicate')
    UNION ALL SELECT CAST(fault = 'truncated' AS INT), 'K', keep.r FROM keep WHERE keep.p = ins.r AND keep.c = f.c AND fault NOT IN ('blank', 'duplicate')) e),
n AS (SELECT conv_id, max(i) AS n FROM f GROUP BY conv_id),
go AS (
  SELECT conv_id, n + 1 AS i, s AS p, struct_pack(cost := CAST(t.cost AS BIGINT), audit := t.a) AS best
  FROM n, (VALUES (0, 0, ''), (1, 4, 'II'), (2, 2, 'I'), (3, 0, '')) AS t(s, cost, a)
  UNION ALL
  SELECT w.conv_id, w.i, w.p, min(struct_pack(cost := CAST(w.cost + go.best.cost AS BIGINT), audit := w.edits || go.best.audit))
  FROM go JOIN way w ON w.conv_id IS NOT DISTINCT FROM go.conv_id AND w.i = go.i - 1 AND w.r = go.p
  GROUP BY w.conv_id, w.i, w.p),
a AS (SELECT conv_id, best.cost AS cost, best.audit AS audit FROM go WHERE i = 1 AND p = 0),
e AS (
  SELECT conv_id, j, e, sum(CAST(e <> 'I' AS INT)) OVER up AS i, sum(CAST(e <> 'D' AS INT)) OVER up AS o, sum(CAST(e <> 'D' AS INT)) OVER (PARTITION BY conv_id) AS m
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS j FROM a)
  WINDOW up AS (PARTITION BY conv_id ORDER BY j)),
r AS (
  SELECT e.conv_id, sha256(string_agg(CASE e WHEN 'K' THEN role ELSE CASE WHEN (o - m % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' ||
                                      CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha
  FROM e JOIN f ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND greatest(e.i, 1) = f.i WHERE e <> 'D' GROUP BY e.conv_id),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN g ON o.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN a ON o.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
"""
