"""Mixing sources to target weights by hash thresholds.

Every document has a fixed hash. A source's budget is met by taking the
documents whose hash is below the source's threshold, so nothing is sorted.
Words are summed by source and by the leading bits of the hash; the bucket in
which the budget is reached is the boundary, and only its documents are summed
again by the next bits, until it holds a single hash. Thresholds are nested: a
larger budget takes the same documents and more.

Defined results: a null text has size 0; a null source is a source of its own,
after all others; documents without id share one hash, and so do repeated rows,
which are taken or left together; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import WORD, fresh, stored

HASH_BITS = 60
LEVEL_BITS = 10
WEIGHTS = (3, 1, 2)


def _hash(doc_id: Column) -> Column:
    """The first 60 bits of the md5 of the id as text."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       _hash(F.col("doc_id")).alias("hash"))


def ranked_sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, weight``; weights repeat in code-point order of the sources, null last.

    Sources are ranked by range partitions and partition offsets, not in one task.
    """
    order = F.col("source").asc_nulls_last()
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = stored(totals.repartitionByRange(order).sortWithinPartitions(order)
                      .withColumn("_id", F.monotonically_increasing_id()), "sources")
    parts = numbered.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1))
    # One row per partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = (F.col("_at") + F.col("_offset")) % len(weights)
    return stored(parts.join(offsets, "_part").select(
        "source", "source_size", F.get(F.array(*[F.lit(w) for w in weights]), rank.cast("int")).cast("long").alias("weight")), "weights")


def targets(sources: DataFrame, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Adds ``target``: ``share`` of all words, dealt by weight, no source above ``repeats`` times its size.

    A round caps the sources that the present level lifts above their limit and
    deals what they leave to the others; the level only rises, until no source
    is above. A round brings two sums to the driver.
    """
    limit = F.col("source_size") * repeats
    words, weight = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    budget = share * words
    level = budget / weight if weight else 0.0
    while weight:
        above = F.lit(level) * F.col("weight") > limit
        capped, weight = sources.agg(F.coalesce(F.sum(F.when(above, limit)), F.lit(0)),
                                     F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        raised = (budget - capped) / weight if weight else level
        if raised == level:
            break
        level = raised
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), limit.cast("double")))


def _located(histogram: DataFrame) -> DataFrame:
    """The boundary bucket of each source: the one in which the rest of its budget is reached."""
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return (
        histogram.withColumn("_upto", F.sum("words").over(upto))
        .filter((F.col("_upto") > F.col("rest")) & (F.col("_upto") - F.col("words") <= F.col("rest")))
        .select("source", "bucket", (F.col("rest") - (F.col("_upto") - F.col("words"))).alias("rest"), "words", "low", "high"))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, below``: documents with a smaller hash meet the source's ``rest`` words most nearly.

    A source without a row takes all of its documents.
    """
    rows, found, open_ = sizes.filter(F.col("size") > 0), None, budgets.select("source", "rest")
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        here = rows.join(open_, rows["source"].eqNullSafe(open_["source"])).select(
            rows["source"], "hash", "size", "rest", F.shiftright("hash", shift).alias("bucket"))
        histogram = here.groupBy("source", "bucket").agg(
            F.sum("size").alias("words"), F.first("rest").alias("rest"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        boundary = stored(_located(histogram), "boundary")
        # A single hash is taken if that comes nearer to the budget.
        single = F.col("low") == F.col("high")
        done = boundary.filter(single).select(
            "source", F.when(F.col("words") - F.col("rest") < F.col("rest"), F.col("low") + 1).otherwise(F.col("low")).alias("below"))
        found = done if found is None else found.unionByName(done)
        left = boundary.filter(~single).select("source", "bucket", "rest")
        if left.isEmpty():
            break
        open_ = left.select("source", "rest")
        inside = (rows["source"].eqNullSafe(left["source"])) & (F.shiftright(rows["hash"], shift) == left["bucket"])
        rows = stored(rows.join(left, inside, "left_semi"), "inside")
    return stored(found, "thresholds")


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Per source: ``_source, source_size, target, passes`` (whole ones) and ``below``, the hash under which a document is taken once more."""
    sources = stored(targets(ranked_sources(sizes, weights), share, repeats), "targets")
    # Whole passes over the source first, then a part of one more.
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    planned = sources.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    cut = thresholds(sizes, planned)
    return planned.join(cut, planned["source"].eqNullSafe(cut["source"]), "left").select(
        planned["source"].alias("_source"), "source_size", "target", "passes",
        # No threshold: the rest is not reached by any bucket, only possible with nothing left to take.
        F.coalesce("below", F.lit(0)).alias("below"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, taken`` (words taken, repeats counted)."""
    sizes = stored(sized(docs), "sizes")
    planned = plan(sizes, weights, share, repeats)
    return sizes.join(planned, sizes["source"].eqNullSafe(planned["_source"])).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * (F.col("passes") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0))).alias("taken"))


def corpus(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """The documents that the mix takes, with all their columns and ``passes``, how often each is taken.

    Documents of which nothing is taken, those without words among them, are left out. The plan has
    a row per source and is stored, so it travels to the documents where its size allows.
    """
    name = fresh(docs, "passes")
    planned = stored(plan(stored(sized(docs), "sizes"), weights, share, repeats).select(
        *(F.col(c).alias(f"_plan_{c.strip('_')}") for c in ("_source", "passes", "below"))), "plan")
    passes = F.col("_plan_passes") + F.when(_hash(docs["doc_id"]) < F.col("_plan_below"), 1).otherwise(0)
    some = F.coalesce(docs["text"], F.lit("")).rlike(WORD)
    return docs.join(planned, docs["source"].eqNullSafe(planned["_plan_source"])).filter(some & (passes > 0)).select(
        *(docs[c] for c in docs.columns), passes.alias(name))


# The same selection in DuckDB: sums in hash order instead of histograms.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, ((SELECT sum(source_size) FROM s) * CAST(1.5 AS DOUBLE) - coalesce(sum(2 * source_size) OVER before, 0))
         / ((SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER before, 0)) AS level, row_number() OVER before AS place
  FROM s WINDOW before AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, place) AS level FROM r WHERE level * weight <= 2 * source_size),
t AS (SELECT source, source_size, least(level * weight, CAST(2 * source_size AS DOUBLE)) AS target FROM s, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
k AS (
  SELECT c.source, c.h, upto - words < target - passes * source_size
         AND (upto <= target - passes * source_size OR upto - (target - passes * source_size) < (target - passes * source_size) - (upto - words)) AS taken
  FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, d.size, p.source_size, p.target, d.size * (p.passes + CAST(k.taken AS BIGINT)) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""
