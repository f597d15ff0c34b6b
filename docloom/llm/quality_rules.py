"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Each document has a vector of transformed shares. Per language and source, the
minimum-covariance-determinant estimate takes the three quarters of the
documents whose scatter is smallest; documents far from its centre by the
Mahalanobis distance are rejected. Everything is DataFrame code.

The estimate starts at medians and quartiles and repeats concentration steps:
distances to the present centre are counted in narrow logarithmic bins, and the
moments of the bins up to the wanted share give the next centre and scatter.
Vectors are whole numbers, so that sums do not depend on the order of rows.

Defined results: a null text has no words and fails the word limit; a null
language or source is a value of its own; sources with fewer than ``min_group``
documents of a language are judged by the estimate of the whole language, and
those of a language with fewer than that by the estimate of all documents, so
every document is tested; equal rows get equal verdicts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACE, stored

WINDOW = 5
FEATURES = ("length", "symbols", "capitals", "marks", "repeats")
P = len(FEATURES)
# Steps of a vector's components: 1/256.
_UNIT = 256
# Words of average text mixed into each document, so that a short one is not far off by chance.
_PRIOR_WORDS = 60
# Smallest standard deviation of each component, in steps; shares that are mostly 0 have no scatter of their own.
_FLOORS = (10.0, 12.0, 12.0, 12.0, 24.0)
# Chi-squared distribution with five degrees of freedom (fixed values): its 0.975 and 0.999 quantiles, and what the
# scatter of the inner 0.75 or 0.975 of the points must be multiplied by to be that of all.
_CHI2_975, _CHI2_999, _INNER_75, _INNER_975 = 12.8325, 20.515, 1.413, 1.056
# Squared distance beyond which a document is rejected.
CUTOFF = _CHI2_999
_BINS_PER_OCTAVE = 16


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def text_statistics(docs: DataFrame) -> DataFrame:
    """``row`` (all of the document's columns) and its counts, one projection per level of arrays."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    words = docs.select(F.struct("*").alias("row")).select(
        "row", text.alias("t"),
        F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "").alias("w"),
        F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(f"[^{SPACE[1:-1]}]"))).alias("lines"))
    n = F.size("w")
    # A window is compared by the 64-bit hash of its five words.
    hashed = words.select(
        "row", n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", ""))).cast("long").alias("n_capitals"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[!?.,;:\"'()\[\]{}=_/\\-]+", ""))).cast("long").alias("n_marks"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(n >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))),
            lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)]))).alias("h"))
    repeated = F.size("h") > F.size(F.array_distinct("h"))
    ordered = hashed.withColumn("s", F.when(repeated, F.sort_array(
        F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = ordered.withColumn("p", F.sort_array(F.transform(F.filter("s", lambda e, j: (
        e["x"] == F.get("s", j - 1)["x"]) | (e["x"] == F.get("s", j + 1)["x"])), lambda e: e["i"])))
    gaps = F.transform("p", lambda x, j: F.least(F.coalesce(F.get("p", j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
    return same.select(
        "row", "n_words", "word_chars", "n_symbols", "n_capitals", "n_marks", "n_dup_lines", "n_lines",
        F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def _vector() -> list[Column]:
    """Whole-number components; logarithms and square roots spread the shares evenly."""
    words, chars = F.col("n_words") + _PRIOR_WORDS, F.col("word_chars") + 5 * _PRIOR_WORDS

    def root(count: Column, of: Column) -> Column:
        return F.sqrt(count / of)

    parts = [
        F.log2(chars / words),
        root(F.col("n_symbols"), chars),
        root(F.col("n_capitals") + 0.03 * 5 * _PRIOR_WORDS, chars),
        root(F.col("n_marks") + 0.03 * 5 * _PRIOR_WORDS, chars),
        root(F.col("n_repeat_words") + F.col("n_dup_lines"), words),
    ]
    return [F.round(p * _UNIT).cast("long").alias(f"x{i}") for i, p in enumerate(parts)]


def with_vectors(statistics: DataFrame) -> DataFrame:
    """Adds the group key (language and source) and the vector."""
    return statistics.select(
        "*", F.to_json(F.struct(F.col("row.lang").cast("string").alias("l"))).alias("lang_key"),
        F.to_json(F.struct(F.col("row.lang").cast("string").alias("l"), F.col("row.source").cast("string").alias("s"))).alias("key"),
        *_vector())


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i + 1)]


def _cholesky(moments: DataFrame, keys: list[str], scale: Column) -> DataFrame:
    """Centre ``m*`` and lower triangle ``l*`` from ``n``, sums ``s*`` and sums of products ``q*``."""
    mean = [F.col(f"s{i}") / F.col("n") for i in range(P)]
    out = moments.select(*keys, *[mean[i].alias(f"m{i}") for i in range(P)], *[
        (scale * (F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j]) + F.lit(_FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}")
        for i, j in _pairs()])
    for i, j in _pairs():
        rest = F.col(f"c{i}{j}") - _sum([F.lit(0.0)] + [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)])
        value = F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}")
        out = out.withColumn(f"l{i}{j}", value)
    return out.select(*keys, *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in _pairs()])


def with_distance(rows: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance, by forward substitution."""
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"m{i}") - _sum([F.lit(0.0)] + [F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)])
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", _sum([F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)]))


def _moments() -> list[Column]:
    return ([F.count(F.lit(1)).alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)]
            + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _pairs()])


def _totals() -> list[Column]:
    names = ["n"] + [f"s{i}" for i in range(P)] + [f"q{i}{j}" for i, j in _pairs()]
    return [F.sum(name).alias(name) for name in names]


def estimates(vectors: DataFrame, steps: int = 4, min_group: int = 50, share: float = 0.75) -> DataFrame:
    """Per judged group: centre and scatter. ``vectors`` has ``lang_key, key, x*``."""
    counts = vectors.groupBy("lang_key", "key").agg(F.count(F.lit(1)).alias("_n"))
    languages = counts.groupBy("lang_key").agg(F.sum("_n").alias("_of"))
    own, language, every = F.concat(F.lit("s"), "key"), F.concat(F.lit("l"), "lang_key"), F.lit("a")
    # By which estimate a key's documents are judged: their own group's, their language's, or that of all.
    placed = stored(counts.join(languages, "lang_key").select("lang_key", "key", F.when(F.col("_n") >= min_group, own).when(
        F.col("_of") >= min_group, language).otherwise(every).alias("grp")), "groups")
    # A document counts in each of these groups by which some document is judged.
    members = stored(placed.select("key", F.explode(F.array(own, language, every)).alias("grp")).join(
        placed.select("grp").distinct(), "grp", "left_semi"), "members")
    rows = stored(vectors.select("key", *[f"x{i}" for i in range(P)]).join(members, "key").drop("key"), "vectors")

    quartiles = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *[
        F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p{i}") for i in range(P)])
    spread = [F.greatest((F.get(f"p{i}", F.lit(2)) - F.get(f"p{i}", F.lit(0))) / 1.349, F.lit(_FLOORS[i])) for i in range(P)]
    centre = stored(quartiles.select(
        "grp", *[F.get(f"p{i}", F.lit(1)).cast("double").alias(f"m{i}") for i in range(P)],
        *[(spread[i] if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in _pairs()]), "start")

    for _ in range(steps):
        # Bin counts and moments per group: a few hundred rows each, whatever the number of documents.
        distance = with_distance(rows.join(centre, "grp"))
        bins = distance.withColumn("b", F.floor(F.log2(F.greatest("d2", F.lit(1e-6))) * _BINS_PER_OCTAVE)).groupBy("grp", "b").agg(*_moments())
        packed = bins.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("counts"), F.sum("n").alias("total"))
        # The first bin at which the wanted share is reached.
        reached = F.aggregate(
            "counts", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")),
            lambda a, c: F.struct(
                (a["seen"] + c["n"]).alias("seen"),
                F.coalesce(a["at"], F.when(a["seen"] + c["n"] >= F.ceil(F.col("total") * share), c["b"])).alias("at")),
            lambda a: a["at"])
        inner = bins.join(packed.select("grp", reached.alias("at")), "grp").filter(F.col("b") <= F.col("at"))
        moments = inner.groupBy("grp").agg(*_totals())
        centre = stored(_cholesky(moments, ["grp"], F.lit(_INNER_75)), "step")

    kept = with_distance(rows.join(centre, "grp")).filter(F.col("d2") <= _CHI2_975)
    final = _cholesky(kept.groupBy("grp").agg(*_moments()), ["grp"], F.lit(_INNER_975))
    return stored(placed.join(final, "grp").drop("grp", "lang_key"), "estimates")


def judged(vectors: DataFrame, cutoff: float = CUTOFF, **options) -> DataFrame:
    """``vectors`` with ``base_failed``, ``d2`` and ``kept``."""
    centres = estimates(vectors.filter(~base_failed()).select("lang_key", "key", *[f"x{i}" for i in range(P)]), **options)
    far = F.coalesce(F.col("d2") > cutoff, F.lit(False))
    return with_distance(vectors.join(centres, "key", "left")).select(
        *vectors.columns, "d2", base_failed().alias("base_failed"), (~base_failed() & ~far).alias("kept"))


def verdicts(docs: DataFrame, **options) -> DataFrame:
    """One row per document: its counts, whether it fails the limits, and whether it is kept."""
    vectors = with_vectors(text_statistics(docs.select("doc_id", "text", "lang", "source")))
    slim = stored(vectors.withColumn("row", F.struct("row.doc_id")), "statistics")
    return judged(slim, **options).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "d2")


def filtered(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with all their columns."""
    vectors = stored(with_vectors(text_statistics(docs)), "measured")
    return judged(vectors, **options).filter("kept").select("row.*")
