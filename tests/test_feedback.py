import pytest
from pyspark.sql import functions as F

from docloom.operators import feedback
from docloom.operators.scaling import left_join_skewed
from docloom.sources import inputs
from tests.conftest import SF_DIR, rows

LOG = ("event_id long, request_id long, step_id string, timestamp timestamp, source struct<id string>, "
       "text_assessment struct<suggested_output string, ratings struct<answer_correct struct<value string>>>, "
       "retrieval_assessment struct<position int, step_id string, ratings struct<answer_correct struct<value string>>>")


def click(event, request, minute, reviewer="r", step="s", answer=None, edit=None, chunk=None):
    import datetime

    text = (edit, ((answer,),)) if answer is not None else None
    rated = (chunk[0], step, ((chunk[1],),)) if chunk else None
    return (event, request, step, datetime.datetime(2024, 1, 1, 0, minute), (reviewer,), text, rated)


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([
        click(1, 1, 5, answer="negative"), click(2, 1, 9, answer="positive", edit="better"), click(3, 1, 9, answer="positive", edit="best"),
        click(4, 1, 9, chunk=(1, "false")), click(5, 1, 1, chunk=(0, "true")), click(6, 1, 2, chunk=(0, "false")), click(7, 1, 3, chunk=(0, "true")),
        click(8, 2, 1, answer="negative", edit=""), click(9, 3, 1, answer="idk"), click(10, 4, 1, step="t", chunk=(2, "true")),
        click(11, 9, 1, answer="positive"), click(12, 2, 1, reviewer="q", answer="positive"),
    ], LOG)


@pytest.fixture(scope="module")
def requests(spark):
    trace = '{"spans":[{"span_type":"LLM"},{"span_type":"RETRIEVER","documents":[{"doc_uri":"a","content":"A"},{"doc_uri":"b","content":"B"}]}]}'
    return spark.createDataFrame([(i, f"q{i}", f"resp{i}", None if i == 4 else trace) for i in range(1, 6)],
                                 "request_id long, request string, response string, trace string")


def test_ties_go_to_the_later_event(log):
    assert rows(feedback.dedup_text(log).filter("request_id = 1"), "event_id") == [(3,)]


def test_chunk_ratings_are_in_position_order(log):
    nested = feedback.nest_retrieval(feedback.dedup_retrieval(log))
    got = nested.select("request_id", feedback.relevance_array(F.col("retrieval_assessments")).alias("r"), F.minute("timestamp").alias("m"))
    assert rows(got) == [(1, ["true", "false"], 9), (4, ["true"], 1)]


def test_evaluation_set(requests, log):
    got = feedback.create_evaluation_set(requests, log)
    context = F.transform("expected_retrieved_context", lambda c: c["doc_uri"])
    assert rows(got.withColumn("c", context), "request_id", "source_user", "source_tag", "expected_response", "has_edit", "c") == [
        # The edit of a thumbs-up is used, and only the chunk rated true is expected.
        (1, "r", "thumbs_up", "best", True, ["a"]),
        (2, "q", "thumbs_up", "resp2", False, None),
        # The tag says edited whether or not there is an edit; the flag tells.
        (2, "r", "thumbs_down_edited", None, False, None),
        (3, "r", "no_feedback_provided", None, False, None),
        (4, "r", "no_feedback_provided", None, False, None),
        (5, None, "no_feedback_provided", None, False, None)]
    assert rows(feedback.one_row_per_request(got), "request_id", "source_user") == [(1, "r"), (2, "q"), (3, "r"), (4, "r"), (5, None)]


def test_traces_of_requests_without_a_good_chunk_are_not_needed(requests, log):
    good = feedback.good_chunk_requests(log)
    assert rows(good, "request_id") == [(1,), (4,)]
    kept = requests.join(good, "request_id", "left_semi").unionByName(
        requests.drop("trace").join(good, "request_id", "left_anti"), allowMissingColumns=True)
    whole = feedback.create_evaluation_set(requests, log)
    assert sorted(map(str, feedback.create_evaluation_set(kept, log).collect())) == sorted(map(str, whole.collect()))
    bare = feedback.create_evaluation_set(requests.drop("trace"), log)
    assert bare.filter("expected_retrieved_context is not null").isEmpty()
    rest = [c for c in whole.columns if c != "expected_retrieved_context"]
    assert sorted(map(str, bare.select(rest).collect())) == sorted(map(str, whole.select(rest).collect()))


def test_ratings_of_some_positions_select_those_chunks(spark):
    documents = ",".join(f'{{"doc_uri":"d{i}","content":"c"}}' for i in range(5))
    trace = f'{{"spans":[{{"span_type":"RETRIEVER","documents":[{documents}]}}]}}'
    requests = spark.createDataFrame([(1, "q", "r", trace)], "request_id long, request string, response string, trace string")
    clicks = spark.createDataFrame([click(1, 1, 1, chunk=(3, "true")), click(2, 1, 2, chunk=(1, "true")), click(3, 1, 3, reviewer="x", chunk=(4, "false")),
                                    click(4, 1, 4, reviewer="y", chunk=(9, "true"))], LOG)
    got = feedback.create_evaluation_set(requests, clicks)
    context = F.transform("expected_retrieved_context", lambda c: c["doc_uri"])
    assert rows(got.withColumn("c", context), "source_user", "c") == [("r", ["d1", "d3"]), ("x", None), ("y", None)]


def test_classes_partition_the_requests(spark):
    events, conversations = (inputs.table(spark, SF_DIR, t) for t in ("events", "conversations"))
    attached = feedback.attach_ground_truth(inputs.request_log(conversations), feedback.dedup_assessments(inputs.assessment_log(events)))
    columns = ["request_id", "source_user", "step_id", "source_tag", "expected_response", "has_edit"]
    assert rows(feedback.label_records(attached), *columns) == rows(feedback.union_of_classes(attached), *columns)


def test_a_click_may_rate_answer_and_chunk(spark):
    both = spark.createDataFrame([(20, 7, "s", None, ("r",), ("e", (("positive",),)), (0, "s", (("true",),)))], LOG)
    got = feedback.dedup_assessments(both).first()
    assert got.text_assessment.suggested_output == "e" and len(got.retrieval_assessments) == 1


def test_both_spellings_of_ratings(spark):
    df = spark.createDataFrame([("true",), ("positive",), ("false",), ("negative",), ("idk",), (None,)], "is_correct string")
    df = df.withColumn("response", F.lit("r")).withColumn("suggested_output", F.lit(None).cast("string"))
    assert sorted(r.source_tag for r in feedback.label_records(df).collect()) == [
        "no_feedback_provided"] * 2 + ["thumbs_down_edited"] * 2 + ["thumbs_up"] * 2


def test_context_is_null_when_a_side_is_missing(spark):
    df = spark.createDataFrame([(None, ["true"]), ([("u", "c")], None), ([("u", "c")], ["false"]), ([("u", "c"), ("v", "d")], ["true"]), ([("u", "c")], ["false", "true"])],
                               "chunks array<struct<doc_uri string, content string>>, ratings array<string>")
    rated = F.transform("ratings", lambda r, i: F.struct(i.alias("position"), F.struct(F.struct(r.alias("value")).alias("answer_correct")).alias("ratings")))
    got = [r.e for r in df.select(feedback.expected_context(F.col("chunks"), rated).alias("e")).collect()]
    assert got[:3] == [None, None, None] and [c.doc_uri for c in got[3]] == ["u"] and got[4] is None


def test_bad_trace_is_null(spark):
    df = spark.createDataFrame([("{bad",), ('{"spans":[]}',)], "t string")
    assert [r.c for r in df.select(feedback.trace_chunks(F.col("t")).alias("c")).collect()] == [None, []]


def test_left_join_with_most_rows_under_one_key(spark):
    left = spark.range(10).withColumnRenamed("id", "k").withColumn("l", F.col("k") * 2)
    right = spark.range(600).select(F.when(F.col("id") % 3 > 0, 4).otherwise(F.col("id")).alias("k"), F.col("id").alias("r"))
    assert rows(left_join_skewed(left, right, "k"), "k", "l", "r") == rows(left.join(right, "k", "left"), "k", "l", "r")


def test_split_shares_and_report(spark):
    df = spark.range(4000).withColumnRenamed("id", "request_id")
    shares = {r.split: r["count"] / 4000 for r in feedback.split_eval_set(df).groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.7) < 0.03 and abs(shares["test"] - 0.2) < 0.03
    evalset = spark.createDataFrame([(1, "a", "x"), (1, "a", None), (2, "a", "y"), (3, "b", None)], "request_id int, source_tag string, expected_response string")
    assert rows(feedback.evalset_report(evalset, 3)) == [("a", 3, 2, 2, True), ("b", 1, 1, 0, False)]


def test_agreement(log):
    got = {r.request_id: (r.n_reviewers, r.n_positive, r.unanimous) for r in feedback.agreement(log).collect()}
    assert got[2] == (2, 1, False) and got[1] == (1, 1, True)
