"""What happens to ranked lists: thresholds, fusion, reranking, context text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators.scaling import stored
from docloom.operators.similarity import DECIMALS, similarity_topk

# Fixed value: the constant of reciprocal rank fusion.
RRF_C = 60


def min_score(hits: DataFrame, threshold: float) -> DataFrame:
    return hits.filter(F.col("score") >= threshold)


def with_index_columns(hits: DataFrame, index: DataFrame, columns: list[str]) -> DataFrame:
    """Brings index columns to the hits; only the needed ones are read.

    The hits are stored first: their size is then known when the join is planned, and
    they travel to the index if Spark's own limit allows, whose rows then stay where they are.
    """
    return index.select("chunk_id", *columns).join(stored(hits, "hits"), "chunk_id")


def to_documents(hits: DataFrame, text: str, uri: str, metadata: list[str]) -> DataFrame:
    """Hits as ``page_content`` and a ``metadata`` map with the key, URI, score and further columns."""
    names = ["chunk_id", "similarity_score", "doc_uri", *metadata]
    values = [F.col("chunk_id"), F.col("score"), F.col(uri), *[F.col(m) for m in metadata]]
    pairs = [x for n, v in zip(names, values) for x in (F.lit(n), v.cast("string"))]
    return hits.select("query_id", "rank", F.col(text).alias("page_content"),
                       F.create_map(*pairs).alias("metadata"), F.lit("Document").alias("type"))


def reciprocal_rank_fusion(lists: list[DataFrame], k: int, c: int = RRF_C) -> DataFrame:
    """Best k by the sum of ``1 / (c + rank)`` over the lists that hold a chunk."""
    together = lists[0].select("query_id", "chunk_id", "rank")
    for other in lists[1:]:
        together = together.unionByName(other.select("query_id", "chunk_id", "rank"))
    fused = together.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1 / (F.lit(float(c)) + F.col("rank"))), 9).alias("score"),
        F.count(F.lit(1)).alias("n_lists"))
    return rerank(fused, F.desc("score"), k)


def rerank(hits: DataFrame, by: Column, n: int, rank: str = "rank") -> DataFrame:
    """The best n hits of each query by any sort expression; ties go to the lower chunk id."""
    order = Window.partitionBy("query_id").orderBy(by, F.asc("chunk_id"))
    return hits.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n)


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the distinct query words found in the text, case ignored."""
    words = F.array_distinct(tx.tokens(F.lower(query)))
    found = F.array_intersect(words, tx.tokens(F.lower(text)))
    return F.coalesce(F.try_divide(F.size(found).cast("double"), F.size(words)), F.lit(0.0))


_SCORERS: dict[str, Callable[[Column, Column], Column]] = {"overlap": overlap_score}


def register_scorer(name: str, scorer: Callable[[Column, Column], Column]) -> None:
    """Add a reranking score: any function of the query and the chunk text columns."""
    _SCORERS[name] = scorer


def rerank_by_scorer(hits: DataFrame, scorer: str, query: str, text: str, n: int) -> DataFrame:
    if scorer not in _SCORERS:
        raise ValueError(f"unknown scorer {scorer!r}, known: {sorted(_SCORERS)}")
    scored = hits.withColumn("rerank_score", F.round(_SCORERS[scorer](F.col(query), F.col(text)), DECIMALS))
    return rerank(scored, F.desc("rerank_score"), n)


def rerank_by_model(hits: DataFrame, load: Callable[[], Callable[[pd.Series, pd.Series], pd.Series]],
                    query: str, text: str, n: int) -> DataFrame:
    """Rerank with a Python model, loaded once per partition."""
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in batches:
            yield model(q, t)

    return rerank(hits.withColumn("rerank_score", score(query, text)), F.desc("rerank_score"), n)


def two_step(candidates: DataFrame, query: str, text: str, k: int, weight: float) -> DataFrame:
    """Best k of semantic candidates by ``weight`` x score + (1 - ``weight``) x word overlap."""
    mixed = candidates.withColumn("keyword_score", F.round(overlap_score(F.col(query), F.col(text)), DECIMALS))
    both = F.lit(weight) * F.col("score") + F.lit(1 - weight) * F.col("keyword_score")
    # Halves of two rounded numbers fall on a rounding edge, hence the further digits.
    return rerank(mixed.withColumn("combined_score", F.round(both, DECIMALS + 3)), F.desc("combined_score"), k)


def expand_topk(variants: DataFrame, search: Callable[[DataFrame, int], DataFrame], k: int, per_variant: int | None = None) -> DataFrame:
    """Search every variant of a question, keep a chunk's best score, then the best k.

    ``variants`` holds ``query_id, variant_id`` (unique) and a vector; ``search`` gives the hits of
    queries and a number of hits, as ``VectorIndex.search`` does.
    """
    found = search(variants.select(F.col("variant_id").alias("query_id"), "embedding"), per_variant or k)
    owners = variants.select("query_id", "variant_id")
    hits = found.withColumnRenamed("query_id", "variant_id").join(owners, "variant_id")
    best = hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_variants"))
    return rerank(best, F.desc("score"), k)


def extract_filters(df: DataFrame, text: str, patterns: dict[str, str], vocabulary: dict[str, list[str]]) -> DataFrame:
    """Filters named in a text: pattern matches, and vocabulary words as whole words, each once and sorted."""
    words = tx.tokens(F.lower(F.regexp_replace(F.col(text), r"[.,;:!?()]", " ")))
    found = {n: F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))))
             for n, p in patterns.items()}
    named = {n: F.array_sort(F.array_intersect(F.array(*map(F.lit, terms)), words)) for n, terms in vocabulary.items()}
    return df.withColumns({**found, **named})


def classify_intent(df: DataFrame, text: str, keywords: dict[str, list[str]], default: str = "other") -> DataFrame:
    """The category with the most keyword hits in a text; ties go to the earlier name."""
    words = tx.tokens(F.lower(F.regexp_replace(F.col(text), r"[.,;:!?()]", " ")))

    def hits(ws: Column, terms: list[str]) -> Column:
        return F.size(F.filter(ws, lambda w: w.isin(terms)))

    scores = tx.let(words, lambda ws: F.array(*[
        F.struct((-hits(ws, terms)).alias("less"), F.lit(name).alias("intent"))
        for name, terms in sorted(keywords.items())]))
    best = F.array_min(scores)
    return (
        df.withColumn("_best", best)
        .withColumn("intent", F.when(F.col("_best.less") < 0, F.col("_best.intent")).otherwise(default))
        .withColumn("n_hits", (-F.col("_best.less")).cast("long")).drop("_best")
    )


def assemble_context(hits: DataFrame, text: str, uri: str, template: str) -> DataFrame:
    """One context text per query: the template filled per hit, in rank order.

    ``template`` may hold ``{chunk_text}``, ``{doc_uri}`` and ``{metadata}``. A
    query has at most k hits, which bounds the list.
    """
    filled: Column = F.lit(template)
    fields = {"{chunk_text}": F.col(text), "{doc_uri}": F.col(uri)}
    if "metadata" in hits.columns:
        fields["{metadata}"] = F.to_json("metadata")
    for mark, value in fields.items():
        filled = F.replace(filled, F.lit(mark), value)
    listed = F.array_sort(F.collect_list(F.struct(F.col("rank"), filled.alias("passage"))))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(listed, lambda x: x["passage"]), "").alias("context"),
        F.count(F.lit(1)).alias("n_chunks"))


def group_by_document(hits: DataFrame, uri: str) -> DataFrame:
    """Hits of one document together: best score, first rank, its chunks in rank order (at most k)."""
    listed = F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("id"))))
    return hits.groupBy("query_id", uri).agg(
        F.max("score").alias("best_score"), F.min("rank").alias("first_rank"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.array_join(F.transform(listed, lambda x: x["id"]), ",").alias("chunk_ids"))
