import numpy as np
import pytest

from docloom.operators import diagnosis, experiments, metrics, settings
from docloom.operators.scaling import exact_percentiles, running_total
from tests.conftest import rows


def test_worked_example(spark):
    hits = spark.createDataFrame([(1, "d1", True), (1, "d2", True), (1, "x", False)], "query_id int, doc string, relevant boolean")
    truth = spark.createDataFrame([(1, d) for d in ("d1", "d2", "d3", "d4", "d4")], "query_id int, doc string")
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    assert [(r.query_id, round(r.precision, 2)) for r in metrics.precision(asked, hits).orderBy("query_id").collect()] == [(1, 0.67), (2, 0.0)]
    assert rows(metrics.document_recall(asked, hits, truth, ["query_id"], "doc")) == [(1, 2, 4, 0.5)]


def test_recall_is_zero_without_hits(spark):
    truth = spark.createDataFrame([(1, "d")], "query_id int, doc string")
    none = spark.createDataFrame([], "query_id int, doc string")
    assert rows(metrics.document_recall(truth.select("query_id"), none, truth, ["query_id"], "doc"), "recall") == [(0.0,)]


def test_rank_metrics_and_ndcg(spark):
    hits = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False)], "query_id int, rank int, relevant boolean")
    totals = spark.createDataFrame([(1, 4), (2, 1)], "query_id int, n_truth long")
    got = metrics.rank_metrics(hits, totals, [1, 2])
    assert rows(got) == [(1, 1, 0.0, 0.0), (1, 2, 0.5, 0.25), (2, 1, 0.0, 0.0), (2, 2, 0.0, 0.0)]
    assert rows(metrics.rank_metrics(hits.filter("query_id = 1"), totals, [1]), "query_id", "precision_at_k") == [(1, 0.0), (2, 0.0)]
    # Four items are relevant, so three hits could all have been; queries without a relevant hit or any hit have 0.
    more = totals.unionByName(spark.createDataFrame([(3, 2), (4, 0)], "query_id int, n_truth long"))
    ideal = 1 + 1 / np.log2(3) + 0.5
    assert rows(metrics.ndcg(hits, more, 3)) == [(1, round((1 / np.log2(3) + 0.5) / ideal, 6)), (2, 0.0), (3, 0.0), (4, None)]


@pytest.mark.parametrize("seed", range(4))
def test_exact_percentiles_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    data = {"a": np.round(rng.exponential(5, 900), 2).tolist() + [3.0] * 600, "b": [7.5], "c": rng.normal(size=50).tolist(), "d": [1.0, 1.0, 1e9, -5e-300, 0.0, float("inf")], "e": [-3.0, -2.0, -1e5, -2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("a", None)], "k string, v double")
    fractions = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    got = {(r.k, r.fraction): r.result for r in exact_percentiles(df, "k", "v", fractions).collect()}
    assert len(got) == len(data) * len(fractions)
    for k, vs in data.items():
        for p in fractions:
            if np.isfinite(np.quantile(vs, p)):
                assert got[k, p] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12)


def test_running_total_over_pages(spark):
    df = spark.createDataFrame([("hot", i, i % 7) for i in range(300)] + [("x", 5, 2)], "k string, p long, v long")
    up = {(r.k, r.p): r.t for r in running_total(df, "k", "p", "v", "t", page=16).collect()}
    down = {(r.k, r.p): r.t for r in running_total(df, "k", "p", "v", "t", descending=True, page=16).collect()}
    values = [i % 7 for i in range(300)]
    assert all(up["hot", i] == sum(values[:i + 1]) and down["hot", i] == sum(values[i:]) for i in range(300))
    assert up["x", 5] == 2


def judged(spark, *data):
    return spark.createDataFrame(list(data), "id int, chunk_relevance_precision double, groundedness string, correctness string, relevance_to_query string")


def test_root_causes(spark):
    df = judged(spark, (1, 0.2, "no", "yes", "no"), (2, 0.2, "yes", "yes", "no"), (3, 0.5, "no", "no", "yes"), (4, 0.9, "yes", "yes", "yes"),
                (5, None, "yes", "yes", "yes"), (6, 0.9, "maybe", "yes", "yes"), (7, 0.1, "yes", "no", "yes"), (8, 0.9, "yes", "yes", "no"))
    with_truth = diagnosis.root_cause(df, True)
    assert rows(with_truth, "id", "root_cause", "assessment") == [
        (1, "Improve Retrieval", "fail"), (2, "No root cause, record passed", "pass"), (3, "Improve Generation", "fail"),
        (4, "No root cause, record passed", "pass"), (5, None, None), (6, None, None), (7, "Improve Retrieval", "fail"), (8, None, None)]
    without = diagnosis.root_cause(df, False)
    # Poor retrieval with a grounded, relevant answer passes although its cause is retrieval.
    assert rows(without.filter("id in (2, 7)"), "root_cause", "assessment") == [("Improve Retrieval", "fail"), ("Improve Retrieval", "pass")]
    shares = {r.value: (r.n, r.percent) for r in diagnosis.cause_frequency(with_truth).collect()}
    assert shares == {"Improve Retrieval": (2, 40.0), "Improve Generation": (1, 20.0), "No root cause, record passed": (2, 40.0)}
    assert rows(diagnosis.drilldown(with_truth, diagnosis.GENERATION, ["id"])) == [(3,)]
    assert rows(diagnosis.suspects(df), "id", "reason") == [(3, "ungrounded_high_precision"), (7, "wrong_low_precision")]


def long(spark, *data):
    return spark.createDataFrame(list(data), "experiment string, metric string, value double, higher_is_better boolean")


def test_baseline_wins_ties(spark):
    df = long(spark, ("poc", "m1", 0.9, True), ("a", "m1", 0.9, True), ("poc", "m2", 10.0, False), ("a", "m2", 9.0, False),
              ("b", "m1", 0.1, True), ("b", "m2", 9.0, False))
    assert rows(experiments.metric_winners(df)) == [("m1", "poc", 0.9), ("m2", "a", 9.0)]
    assert rows(experiments.overall_winner(df)) == [("poc", 1)]
    assert rows(experiments.overall_winner(df.filter("metric = 'm2'"))) == [("a", 1)]


def test_relative_change_in_percent(spark):
    df = long(spark, ("poc", "cost", 200.0, False), ("a", "cost", 150.0, False), ("b", "cost", 201.0, False))
    assert rows(experiments.relative_change(df, ["cost"])) == [("a", "cost", -0.25, -25.0), ("b", "cost", 0.005, 0.5)]


def test_settings_merge_diff_and_grid(spark):
    schema = "strategy string, key_path string, val string"
    base = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2")], schema)
    over = spark.createDataFrame([("s", "b", "3"), ("s", "c", None), ("t", "a", "9")], schema)
    merged = settings.merge_settings(base, over)
    assert rows(merged) == [("s", "a", "1"), ("s", "b", "3"), ("s", "c", None), ("t", "a", "9")]
    assert rows(settings.diff_settings(base, merged)) == [("s", "b", "2", "3"), ("t", "a", None, "9")]
    grid = settings.strategy_grid(spark.createDataFrame([("html",)], "parser string"), "parser", ["w", "r"], ["e"])
    assert rows(grid, "strategy") == [("html__r__e",), ("html__w__e",)]


def test_summary_of_all_experiments_at_once(spark):
    df = spark.createDataFrame([("poc", "yes", 10, 1.0), ("poc", "no", 20, 3.0), ("a", "yes", 5, 2.0)],
                               "experiment string, correctness string, total_token_count int, latency_seconds double")
    assert rows(metrics.summary(df, "experiment")) == [("a", 1, 100.0, 5.0, 2.0), ("poc", 2, 50.0, 15.0, 2.0)]
    assert rows(metrics.latency(df, "experiment"), "experiment", "p50") == [("a", 2.0), ("poc", 2.0)]
