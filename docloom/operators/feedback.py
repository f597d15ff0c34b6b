"""From a click log to labelled evaluation rows.

The log has one row per reviewer click, nested as in
``sources.inputs.assessment_log``. A request may have most of the clicks, so
clicks are reduced per map task before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.scaling import left_join_skewed

SPANS = "spans array<struct<span_type string, documents array<struct<doc_uri string, content string>>>>"


def latest_by(df: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` columns of each key.

    A maximum rather than a ranking window: each task keeps one row per key
    before the shuffle, whatever the number of rows a key has.
    """
    rest = [c for c in df.columns if c not in order]
    newest = F.max_by(F.struct(*rest, *order), F.struct(*order)).alias("_row")
    named = [k if isinstance(k, Column) else F.col(k) for k in keys]
    return df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(named)]).agg(newest).select("_row.*").select(*df.columns)


def dedup_text(log: DataFrame) -> DataFrame:
    """The latest answer rating of each reviewer on each request."""
    rated = log.filter(F.col("text_assessment").isNotNull())
    return latest_by(rated, ["request_id", F.col("source.id")], ["timestamp", "event_id"])


def dedup_retrieval(log: DataFrame) -> DataFrame:
    """The latest rating of each reviewer on each retrieved chunk of each step."""
    rated = log.filter(F.col("retrieval_assessment").isNotNull())
    keys = ["request_id", F.col("source.id"), F.col("retrieval_assessment.position"), F.col("retrieval_assessment.step_id")]
    return latest_by(rated, keys, ["timestamp", "event_id"])


def nest_retrieval(rated: DataFrame) -> DataFrame:
    """Chunk ratings of one reviewer on one step as an array by position.

    Ratings are one per position, so the array is no longer than the retrieved list.
    """
    return rated.groupBy("request_id", F.col("source.id").alias("source_id"), "step_id").agg(
        F.max("timestamp").alias("timestamp"),
        F.array_sort(F.collect_list("retrieval_assessment")).alias("retrieval_assessments"))


def merge_feedback(text: DataFrame, nested: DataFrame) -> DataFrame:
    """Answer and chunk ratings side by side, either of which may be missing.

    An answer rating stands next to each step the reviewer rated.
    """
    a = text.select("request_id", F.col("source.id").alias("source_id"), F.col("step_id").alias("_a_step"),
                    F.col("timestamp").alias("_a_time"), "text_assessment")
    b = nested.select("request_id", "source_id", F.col("step_id").alias("_b_step"),
                      F.col("timestamp").alias("_b_time"), "retrieval_assessments")
    return a.join(b, ["request_id", "source_id"], "full_outer").select(
        "request_id", "source_id", F.coalesce("_a_step", "_b_step").alias("step_id"),
        F.coalesce("_a_time", "_b_time").alias("timestamp"), "text_assessment", "retrieval_assessments")


def dedup_assessments(log: DataFrame) -> DataFrame:
    return merge_feedback(dedup_text(log), nest_retrieval(dedup_retrieval(log)))


def rated_requests(log: DataFrame) -> DataFrame:
    """Ids of the requests with a rating of either kind."""
    rated = F.col("text_assessment").isNotNull() | F.col("retrieval_assessment").isNotNull()
    return log.filter(rated).select("request_id").distinct()


def good_chunk_requests(log: DataFrame) -> DataFrame:
    """Ids of the requests with a positive chunk rating: no other request's trace reaches the evaluation set.

    A rating that a later click withdrew is among them, which only costs an unused trace.
    """
    return log.filter(is_positive(F.col("retrieval_assessment.ratings.answer_correct.value"))).select("request_id").distinct()


def attach_ground_truth(requests: DataFrame, feedback: DataFrame, rated_ids: DataFrame | None = None) -> DataFrame:
    """Requests with each reviewer's rating, edit and chunk ratings; unrated requests stay.

    ``rated_ids``, the ids that have feedback, spares working out the feedback a
    second time to find the others.
    """
    rated = feedback.select(
        "request_id",
        F.col("text_assessment.ratings.answer_correct.value").alias("is_correct"),
        F.nullif(F.col("text_assessment.suggested_output"), F.lit("")).alias("suggested_output"),
        F.col("source_id").alias("source_user"),
        "step_id", "retrieval_assessments")
    return left_join_skewed(requests, rated, "request_id", rated_ids)


def is_positive(rating: Column) -> Column:
    return F.coalesce(rating.isin("positive", "true"), F.lit(False))


def is_negative(rating: Column) -> Column:
    return F.coalesce(rating.isin("negative", "false"), F.lit(False))


def label_records(attached: DataFrame) -> DataFrame:
    """Adds ``source_tag``, ``expected_response`` and ``has_edit``.

    A thumbs-up expects the reviewer's edit or else the response, a thumbs-down
    the edit alone, and no or an undecided rating expects nothing.
    """
    up, down = is_positive(F.col("is_correct")), is_negative(F.col("is_correct"))
    edit = F.col("suggested_output")
    return attached.withColumns({
        "source_tag": F.when(up, "thumbs_up").when(down, "thumbs_down_edited").otherwise("no_feedback_provided"),
        "expected_response": F.when(up, F.coalesce(edit, F.col("response"))).when(down, edit),
        "has_edit": edit.isNotNull(),
    })


def union_of_classes(attached: DataFrame) -> DataFrame:
    """The same rows as ``label_records`` out of three filters and a union by name."""
    up, down = is_positive(F.col("is_correct")), is_negative(F.col("is_correct"))
    edit = F.col("suggested_output")

    def of(rows: DataFrame, tag: str, expected: Column) -> DataFrame:
        return rows.withColumns({"source_tag": F.lit(tag), "expected_response": expected, "has_edit": edit.isNotNull()})

    return (
        of(attached.filter(up), "thumbs_up", F.coalesce(edit, F.col("response")))
        .unionByName(of(attached.filter(down), "thumbs_down_edited", edit))
        .unionByName(of(attached.filter(~up & ~down), "no_feedback_provided", F.lit(None).cast("string"))))


def relevance_array(assessments: Column) -> Column:
    """Chunk ratings in chunk order."""
    return F.transform(assessments, lambda a: a["ratings"]["answer_correct"]["value"])


def trace_chunks(trace: Column) -> Column:
    """``array<struct<doc_uri, content>>`` of all retriever spans of a JSON trace."""
    spans = F.from_json(trace, SPANS)["spans"]
    retrievers = F.filter(spans, lambda s: s["span_type"] == "RETRIEVER")
    return F.flatten(F.transform(retrievers, lambda s: s["documents"]))


def expected_context(chunks: Column, assessments: Column) -> Column:
    """The retrieved chunks whose position has a positive rating; null where there is none or either side is missing.

    A reviewer may rate some positions only, so ratings are matched by position, not by their place in the array.
    """
    good = F.filter(chunks, lambda c, i: F.exists(
        assessments, lambda a: (a["position"] == i) & is_positive(a["ratings"]["answer_correct"]["value"])))
    return F.when(chunks.isNotNull() & assessments.isNotNull() & (F.size(good) > 0), good)


def create_evaluation_set(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Evaluation rows: one per request, reviewer and rated step; one for an unrated request.

    Requests without a ``trace`` column expect no context.
    """
    if "trace" not in requests.columns:
        requests = requests.withColumn("trace", F.lit(None).cast("string"))
    labelled = label_records(attach_ground_truth(requests, dedup_assessments(log), rated_requests(log)))
    return labelled.select(
        "request_id", "request", "response", "expected_response",
        expected_context(trace_chunks(F.col("trace")), F.col("retrieval_assessments")).alias("expected_retrieved_context"),
        "source_user", "step_id", "source_tag", "has_edit")


def one_row_per_request(evalset: DataFrame) -> DataFrame:
    """Of several reviewers' rows keep the most telling: positive, then negative, then the lowest names."""
    worth = F.when(F.col("source_tag") == "thumbs_up", 0).when(F.col("source_tag") == "thumbs_down_edited", 1).otherwise(2)
    ranked = evalset.withColumn("_order", F.struct(worth.alias("w"), F.coalesce("source_user", F.lit("")).alias("u"),
                                                   F.coalesce("step_id", F.lit("")).alias("s")))
    rest = evalset.columns
    return ranked.groupBy("request_id").agg(F.min_by(F.struct(*rest), "_order").alias("_row")).select("_row.*")


def split_eval_set(evalset: DataFrame, key: str = "request_id") -> DataFrame:
    """Adds ``split``: about 70/20/10, by a hash of the key and so the same on every run."""
    from docloom.functions.text import id_bucket

    bucket = id_bucket(F.col(key))
    return evalset.withColumn("split", F.when(bucket < 179, "train").when(bucket < 230, "test").otherwise("validation"))


def evalset_report(evalset: DataFrame, minimum: int = 30) -> DataFrame:
    """Rows, distinct requests and expected answers per tag, and whether the tag has enough rows."""
    per_request = evalset.groupBy("source_tag", "request_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("expected_response").alias("answered"))
    return per_request.groupBy("source_tag").agg(
        F.sum("n").cast("long").alias("n_rows"), F.count(F.lit(1)).alias("n_requests"),
        F.sum("answered").cast("long").alias("n_expected"),
    ).withColumn("enough", F.col("n_rows") >= minimum)


def agreement(log: DataFrame) -> DataFrame:
    """Per request: reviewers, their verdicts, and whether all reviewers say the same."""
    latest = dedup_text(log).select("request_id", F.col("text_assessment.ratings.answer_correct.value").alias("verdict"))
    return latest.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_reviewers"),
        F.count_if(F.col("verdict") == "positive").alias("n_positive"),
        F.count_if(F.col("verdict") == "negative").alias("n_negative"),
        F.coalesce(F.min("verdict") == F.max("verdict"), F.lit(True)).alias("unanimous"))
