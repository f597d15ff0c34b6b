"""Secret scans: fixed patterns, then a battery of randomness tests. DataFrame code only.

Patterns give the base spans. Other long tokens whose symbols are those of an
encoding (hex, base32, base36, base64) are tested for what a random secret would
be: an even use of the alphabet (chi-squared), the alphabet's shares of capitals,
vowels, consonants and digits (chi-squared, which tells short ones apart), no
excess of runs above or below its middle, no correlation of neighbours. Fisher's
method combines the four.

Random tokens have evenly spread p-values, structured ones small ones. How small
is known from a fixed set of structured tokens (words and identifiers in several
spellings) that go through the same tests. How many tokens are random is told,
per encoding and length class over all documents, by the p-values above one
half, drawn towards the neighbouring lengths, the whole encoding and one half
where there are few. The acceptance limit is the smallest at which the expected
share of structured tokens among the accepted is at most ``FDR``; a lone token
is accepted at any p-value that structured ones hardly reach.

Defined results: a null text is empty and has no spans; rows are scanned one by
one, so repeated ids and rows are all reported; positions are code points.
"""

from __future__ import annotations

import random
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import stored

KINDS = ("assign", "access", "hex", "random")
# Patterns fixed by the query's contract; the length limits of assignments are tested on the value.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
MIN_VALUE = 6
FDR = 0.05
_BINS = 50
# Tokens whose evidence a wider pool of tokens counts for.
_WEIGHT = 10.0
# Ordinary words of the structured tokens (fixed list), and how many tokens there are per encoding and length.
_WORDS = ("account address amount archive article backup balance branch buffer cache calendar category channel client cluster column "
          "comment company config contact content context counter country customer data default delivery department detail device "
          "document domain download driver editor element employee error event export factory feature field file filter folder format "
          "function garden group handler header history image import index invoice item journal key language layer letter level library "
          "line list location manager market member message method model module monitor name network node number object option order "
          "package page parameter partner pattern payment person picture planet policy position price process product profile project "
          "property provider quality query record reference region release report request resource response result river school search "
          "section server service session setting shipment signal source status storage store stream street string student summary "
          "supplier system table target task template thread time title token total traffic transfer type update upload user value "
          "version village water weather window winter worker").split()
_HEX_WORDS = "dead beef cafe babe face feed fade decade added bead deed facade 0000 0001 00ff ffff 1234 2024 abcd 0123 cdef 89ab 4567".split()
_STRUCTURED, _STRUCTURED_LENGTHS = 150, (16, 18, 20, 22, 24, 28, 32, 40, 48, 64)
# Matches per step of a running sum inside a row.
_PAGE = 128

_SPAN = "struct<start:bigint,kind:int,end:bigint>"


def _starts(lengths: Column) -> Column:
    """Running sums before each of ``lengths``, by pages, so that long arrays stay cheap."""
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def page(i: Column) -> Column:
        return F.floor(i / _PAGE).cast("int")

    pages = F.transform(F.sequence(F.lit(0), page(F.size(lengths))), lambda k: total(F.slice(lengths, k * _PAGE + 1, F.lit(_PAGE))))
    return F.transform(lengths, lambda x, i: total(F.slice(pages, F.lit(1), page(i))) + total(F.slice(lengths, page(i) * _PAGE + 1, i % _PAGE)))


def _lengths(text: Column, pattern: str, found: Column) -> Column:
    """Lengths of the pieces between matches, each added to the match before it."""
    pieces = F.split(text, pattern, -1)
    return F.transform(F.slice(pieces, 1, F.size(found)), lambda p, i: (
        F.length(p) + F.coalesce(F.length(F.get(found, i - 1)), F.lit(0))).cast("long"))


def scanned(docs: DataFrame) -> DataFrame:
    """``row``, ``base`` (spans of the fixed patterns in order) and ``tokens`` (other long tokens with start)."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": CANDIDATE}
    found = docs.select(F.struct("*").alias("row")).select("row", text.alias("t"), *[
        F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"{k}_found") for k, p in patterns.items()],
        F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1)).alias("values"))
    # Lengths, then their running sums: the starts, but for the own piece.
    gaps = found.select("row", "values", *[f"{k}_found" for k in patterns], *[
        F.when(F.size(f"{k}_found") > 0, _lengths(F.col("t"), p, F.col(f"{k}_found"))).alias(f"{k}_gap") for k, p in patterns.items()])
    summed = gaps.select("row", "values", *[f"{k}_found" for k in patterns], *[f"{k}_gap" for k in patterns], *[
        F.when(F.size(f"{k}_found") > 0, _starts(F.col(f"{k}_gap"))).alias(f"{k}_sum") for k in patterns])

    def spans(kind: str) -> Column:
        at = KINDS.index(kind)

        def span(match: Column, i: Column) -> Column:
            start = F.get(f"{kind}_sum", i) + F.get(f"{kind}_gap", i)
            return F.struct(start.cast("long").alias("start"), F.lit(at).alias("kind"), (start + F.length(match)).cast("long").alias("end"))

        return F.coalesce(F.transform(f"{kind}_found", span), F.array().cast(f"array<{_SPAN}>"))

    assign = F.filter(spans("assign"), lambda s, i: F.length(F.get("values", i)) >= MIN_VALUE)
    placed = summed.select("row", F.sort_array(F.concat(assign, spans("access"), spans("hex"))).alias("base"),
                           F.arrays_zip(spans("random").alias("span"), F.col("random_found").alias("token")).alias("tokens"))
    return placed.select("row", "base", F.filter("tokens", lambda c: ~F.exists("base", lambda b: (
        b["start"] < c["span"]["end"]) & (c["span"]["start"] < b["end"]))).alias("tokens"))


def _normal(z: Column) -> Column:
    """Distribution function of the standard normal, to 2e-4."""
    return 1 / (1 + F.exp(-F.greatest(F.least(1.5976 * z + 0.070566 * z * z * z, F.lit(300.0)), F.lit(-300.0))))


def _two_sided(z: Column) -> Column:
    return 2 * (1 - _normal(F.abs(z)))


def _alphabet(body: Column) -> Column:
    """Size of the alphabet of the inferred encoding; null for words, numbers and anything else."""
    def all_of(symbols: str) -> Column:
        return F.rlike(body, F.lit(f"^[{symbols}]+$"))

    mixed = F.rlike(body, F.lit("[0-9]")) & F.rlike(body, F.lit("[A-Za-z]"))
    return F.when(~mixed, F.lit(None).cast("int")).when(all_of("0-9a-f") | all_of("0-9A-F"), 16).when(all_of("A-Z2-7"), 32).when(
        all_of("a-z0-9"), 36).when(all_of("A-Za-z0-9+/_-"), 64)


def _symbol(c: Column, size: Column) -> Column:
    """Place of a character in the alphabet."""
    code = F.ascii(c)
    digit, lower = (code >= 48) & (code <= 57), (code >= 97) & (code <= 122)
    letter = F.when(lower, code - 97).otherwise(code - 65)
    return (F.when(size == 16, F.when(digit, code - 48).otherwise(letter + 10))
            .when(size == 32, F.when(digit, code - 24).otherwise(letter))
            .when(size == 36, F.when(digit, code - 22).otherwise(letter))
            .otherwise(F.when(digit, code + 4).when(lower, code - 71).when((code >= 65) & (code <= 90), code - 65)
                       .when(c.isin("+", "-"), 62).otherwise(63))).cast("int")


# Symbols of each kind in the alphabets of 64, 36, 32 and 16; of 64, capitals are a kind, of 16, letters are one.
_SHARES = {"capital": (26, 0, 0, 0), "vowel": (5, 5, 5, 0), "consonant": (21, 21, 21, 6), "other": (12, 10, 6, 10)}


def _by_size(of: tuple[int, int, int, int]) -> Column:
    return F.when(F.col("size") == 64, of[0]).when(F.col("size") == 36, of[1]).when(F.col("size") == 32, of[2]).otherwise(of[3])


def _share(code: Column, size: Column) -> Column:
    """The kind of a symbol, by its place in the alphabet."""
    letter = F.when(size == 64, code - 26).otherwise(code)
    return (F.when(size == 16, F.when(code < 10, "other").otherwise("consonant")).when(letter < 0, "capital")
            .when(letter >= 26, "other").when(letter.isin(0, 4, 8, 14, 20), "vowel").otherwise("consonant"))


def _is_share(kind: str):
    return lambda c: _share(c, F.col("size")) == kind


def tested(tokens: DataFrame) -> DataFrame:
    """Adds ``size`` (alphabet), ``length_class`` and ``p``; tokens of no encoding are left out. ``tokens`` has ``token``."""
    body = F.regexp_replace("token", "=+$", "")
    known = tokens.withColumn("body", body).withColumn("size", _alphabet(F.col("body"))).filter("size is not null and length(body) >= 16")
    codes = known.withColumn("codes", F.transform(F.filter(F.split("body", ""), lambda c: c != ""), lambda c: _symbol(c, F.col("size"))))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    n = F.col("n")
    counted = codes.withColumn("n", F.size("codes").cast("double")).select("*", total(F.transform(
        F.sequence(F.lit(0), F.col("size") - 1), lambda s: F.pow(F.size(F.filter("codes", lambda c: c == s)).cast("double"), F.lit(2.0)))).alias("squares"),
        F.size(F.filter("codes", lambda c: c * 2 >= F.col("size"))).cast("double").alias("high"),
        *[F.size(F.filter("codes", _is_share(kind))).cast("double").alias(kind) for kind in _SHARES],
        *[_by_size(of).cast("double").alias(f"{kind}_of") for kind, of in _SHARES.items()],
        total(F.transform("codes", lambda c, i: F.when((c * 2 >= F.col("size")) != (F.get("codes", i + 1) * 2 >= F.col("size")), 1.0).otherwise(0.0))).alias("changes"),
        (total(F.transform("codes", lambda c: c.cast("double"))) / n).alias("mean"))
    moments = counted.select(
        "*", total(F.transform("codes", lambda c: F.pow(c - F.col("mean"), F.lit(2.0)))).alias("variance"),
        total(F.transform("codes", lambda c, i: F.coalesce((c - F.col("mean")) * (F.get("codes", i + 1) - F.col("mean")), F.lit(0.0)))).alias("lagged"))
    df = F.col("size") - 1
    chi = F.greatest(F.col("squares") * F.col("size") / n - n, F.lit(0.0))
    # Wilson and Hilferty: the cube root of a chi-squared value is nearly normal.
    uneven = 1 - _normal((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    low = n - F.col("high")
    cross = 2 * F.col("high") * low
    runs = F.when((cross > n), _two_sided((F.col("changes") - cross / n) / F.sqrt(cross * (cross - n) / (n * n * (n - 1))))).otherwise(0.0)
    of = {kind: F.col(kind) - n * F.col(f"{kind}_of") / F.col("size") for kind in _SHARES}
    shares = sum((F.when(F.col(f"{kind}_of") > 0, of[kind] * of[kind] * F.col("size") / (n * F.col(f"{kind}_of"))).otherwise(0.0) for kind in _SHARES), F.lit(0.0))
    kinds = F.when(F.col("size") == 64, 3.0).when(F.col("size") == 16, 1.0).otherwise(2.0)
    unlike = 1 - _normal((F.pow(shares / kinds, F.lit(1 / 3)) - (1 - 2 / (9 * kinds))) / F.sqrt(2 / (9 * kinds)))
    serial = F.when(F.col("variance") > 0, _two_sided((F.col("lagged") / F.col("variance") + 1 / n) * F.sqrt(n))).otherwise(0.0)
    tiny = F.lit(1e-100)
    t = -(F.log(F.greatest(uneven, tiny)) + F.log(F.greatest(unlike, tiny)) + F.log(F.greatest(runs, tiny)) + F.log(F.greatest(serial, tiny)))
    return moments.withColumn("t", t).select(
        *tokens.columns, "size", F.floor(F.log2("n") * 2).cast("int").alias("length_class"),
        (F.exp(-F.col("t")) * (1 + F.col("t") + F.pow("t", F.lit(2.0)) / 2 + F.pow("t", F.lit(3.0)) / 6)).alias("p"))


def structured_tokens() -> list[str]:
    """The fixed structured tokens: words, identifiers and counters in the spellings of each encoding."""
    rng, tokens = random.Random(20), []

    def filled(n: int, words: list[str], joiner: str, change) -> str:
        # A number stands after one of the words.
        parts, number = [], str(rng.choice((1, 2, 7, 10, 24, 42, 64, 100, 256, 2023, 2024)))
        while len(joiner.join(parts)) < n:
            parts.append(change(rng.choice(words), len(parts)))
        parts.insert(rng.randrange(1, len(parts) + 1), number)
        text = joiner.join(parts)[:n]
        return text if any(c.isdigit() for c in text) else text[:-1] + number[0]

    for n in _STRUCTURED_LENGTHS:
        for i in range(_STRUCTURED):
            tokens.append(filled(n, _WORDS, "", lambda w, k: w))
            tokens.append(filled(n, _WORDS, "-_/"[i % 3], lambda w, k: w) if i % 2 else filled(n, _WORDS, "", lambda w, k: w.capitalize() if k else w))
            upper = filled(n, _WORDS, "", lambda w, k: w.upper())
            tokens.append("".join("234567"[int(c) % 6] if c.isdigit() else c for c in upper))
            tokens.append(filled(n, _HEX_WORDS, "", lambda w, k: w) if i % 2 else f"{rng.randrange(160, 1 << 20):X}".rjust(n - 1, "0") + "A")
    return tokens


def structured_null(spark: SparkSession) -> dict[tuple[int, int], tuple[float, float]]:
    """Per alphabet and length class: centre and spread of the structured tokens' p-values as normal deviates."""
    tokens = spark.createDataFrame([(t,) for t in structured_tokens()], "token string")
    found: dict[tuple[int, int], list[float]] = {}
    for row in tested(tokens).select("size", "length_class", "p").collect():
        deviate = NormalDist().inv_cdf(min(max(row["p"], 1e-15), 1 - 1e-15))
        found.setdefault((row["size"], row["length_class"]), []).append(deviate)
    null = {}
    for cell, values in found.items():
        values.sort()
        # The upper half only: how far down the plainly structured ones lie does not matter.
        middle, high = values[len(values) // 2], values[len(values) * 19 // 20]
        null[cell] = middle, max((high - middle) / NormalDist().inv_cdf(0.95), 0.5)
    return null


def _passing(null: dict[tuple[int, int], tuple[float, float]], cell: tuple[int, int], p: float) -> float:
    """Share of structured tokens of a cell with a p-value above ``p``; longer ones than the fixed set has are taken for its longest."""
    lengths = [length for size, length in null if size == cell[0]]
    middle, spread = null[cell[0], min(max(cell[1], min(lengths)), max(lengths))]
    return 1 - NormalDist(middle, spread).cdf(NormalDist().inv_cdf(p))


def limits(tests: DataFrame, fdr: float = FDR, null: dict[tuple[int, int], tuple[float, float]] | None = None) -> dict[tuple[int, int], float]:
    """Smallest accepted p-value per alphabet and length class; at most a few hundred of them come to the driver."""
    counts = tests.groupBy("size", "length_class").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("p") >= 0.5, 1)).alias("upper"))
    cells = {(r["size"], r["length_class"]): (r["n"], min(2 * r["upper"], r["n"])) for r in counts.collect()}
    if not cells:
        return {}
    null = structured_null(tests.sparkSession) if null is None else null

    def pooled(own: list[tuple[int, int]], towards: float) -> float:
        return (sum(r for _, r in own) + _WEIGHT * towards) / (sum(n for n, _ in own) + _WEIGHT)

    found = {}
    for size, length in cells:
        whole = pooled([c for (s, _), c in cells.items() if s == size], 0.5)
        near = pooled([cells[size, k] for k in (length - 1, length, length + 1) if (size, k) in cells], whole)
        share = pooled([cells[size, length]], near)
        for at in [0.001, 0.002, 0.005, 0.01] + [k / _BINS for k in range(1, _BINS)]:
            wrong = (1 - share) * _passing(null, (size, length), at)
            if wrong <= fdr * (wrong + share * (1 - at)):
                found[size, length] = at
                break
    return found


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """Per document: ``doc_id, n_assign, n_access, n_hex, base, spans`` (text) and ``found`` (array of spans)."""
    hits = stored(scanned(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"), "base", "tokens", F.monotonically_increasing_id().alias("at")), "hits")
    tests = stored(tested(hits.select("at", F.explode("tokens").alias("c")).select("at", "c.span", "c.token")).select(
        "at", "span", "size", "length_class", "p"), "tests")
    accepted = F.lit(False)
    for (size, length_class), limit in sorted(limits(tests, fdr).items()):
        accepted = accepted | ((F.col("size") == size) & (F.col("length_class") == length_class) & (F.col("p") >= limit))
    # Tokens of one document, by the number its row had when stored.
    extra = tests.filter(accepted).groupBy("at").agg(F.collect_list("span").alias("extra"))
    every = hits.join(extra, "at", "left").select("doc_id", "base", F.sort_array(
        F.concat("base", F.coalesce("extra", F.array().cast(f"array<{_SPAN}>")))).alias("found"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return every.select("doc_id", count("assign"), count("access"), count("hex"), _shown(F.col("base")).alias("base"),
                        _shown(F.col("found")).alias("spans"), "found")
