import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import vectors
from docloom.operators import encoding, keyword, keyword_blocks, ranking, similarity, vector_index
from docloom.plans import catalog
from tests.conftest import SF_DIR, rows


def unit_rows(n, dim, seed):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def vectors_small(spark):
    q, x = unit_rows(23, 8, 1), unit_rows(300, 8, 2)
    # A third of the index are copies of one vector.
    x[100:200] = x[100]
    queries = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    index = spark.createDataFrame([(f"c{i:03d}", [float(c) for c in v]) for i, v in enumerate(x)], "chunk_id string, embedding array<double>")
    want = []
    for i, v in enumerate(q):
        scored = sorted(((-round(float(s), 6), f"c{j:03d}") for j, s in enumerate(x @ v)))
        want += [(i, c, r + 1) for r, (_, c) in enumerate(scored[:7])]
    return queries, index.repartition(5), sorted(want)


def test_scan_is_exact_with_many_ties(vectors_small):
    queries, index, want = vectors_small
    assert rows(similarity.similarity_topk(queries, index, 7), "query_id", "chunk_id", "rank") == rows_like(want)


def rows_like(want):
    return sorted(want, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def test_small_blocks_give_the_same(vectors_small, monkeypatch):
    queries, index, want = vectors_small
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 8 * 8 * 10)
    assert rows(similarity.similarity_topk(queries, index, 7), "query_id", "chunk_id", "rank") == rows_like(want)


def test_unusable_vectors_have_no_score(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, embedding array<double>")
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [0.0, -1.0])],
                                  "chunk_id int, embedding array<double>")
    assert rows(similarity.similarity_topk(queries, index, 9), "query_id", "chunk_id", "score") == [(1, 1, 1.0), (1, 5, 0.0)]


def test_empty_sides(spark):
    queries = spark.createDataFrame([], "query_id int, embedding array<double>")
    index = spark.createDataFrame([(1, [1.0])], "chunk_id int, embedding array<double>")
    assert similarity.similarity_topk(queries, index, 3).count() == 0
    one = spark.createDataFrame([(1, [1.0])], "query_id int, embedding array<double>")
    assert similarity.similarity_topk(one, index.filter("false"), 3).count() == 0


@pytest.mark.parametrize("room", [32 * 1024 * 1024, 8 * 8 * 20])
def test_stored_lists_search_exactly(spark, vectors_small, tmp_path, monkeypatch, room):
    # The small room cuts lists into several blocks and the queries too.
    monkeypatch.setattr(vector_index, "BLOCK_BYTES", room)
    monkeypatch.setattr(similarity, "BLOCK_BYTES", room)
    queries, index, want = vectors_small
    built = vector_index.build(index.withColumn("list_no", F.lit(3)), str(tmp_path / "v"), lists=6, columns=["list_no"])
    opened = vector_index.VectorIndex(spark, str(tmp_path / "v"))
    assert len(built) == len(opened) == 300 and opened.vectors.count() == 300
    for found in (opened.search(queries, 7, columns=["list_no"]), opened.search(queries, 7, nprobe=6)):
        assert rows(found, "query_id", "chunk_id", "rank") == rows_like(want)
    assert vector_index.recall_against_exact(queries, index, opened.search(queries, 7, nprobe=6), 7) == 1.0


def test_search_with_a_filter_and_few_vectors(spark, vectors_small, tmp_path):
    queries, index, _ = vectors_small
    built = vector_index.build(index.withColumn("grp", F.substring("chunk_id", 4, 1)), str(tmp_path / "v"), lists=5, columns=["grp"])
    few = F.col("chunk_id").isin("c001", "c250")
    assert rows(built.search(queries, 7, where=few), "query_id", "chunk_id") == rows(
        similarity.similarity_topk(queries, index, 7, few), "query_id", "chunk_id")
    assert built.search(queries, 7, where=F.col("grp") == "x").count() == 0


def clustered(spark, n, groups, seed):
    """Vectors around few directions, as texts of few topics have."""
    rng = np.random.default_rng(seed)
    x = unit_rows(groups, 32, 77)[rng.integers(0, groups, n)] + rng.normal(size=(n, 32)) * 0.05
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "chunk_id int, embedding array<double>")


def test_lists_that_cannot_hold_a_hit_are_not_scored(spark, tmp_path):
    index = clustered(spark, 3000, 30, 3)
    queries = clustered(spark, 400, 30, 4).withColumnRenamed("chunk_id", "query_id")
    built = vector_index.build(index, str(tmp_path / "v"))
    assert rows(built.search(queries, 5), "query_id", "chunk_id", "rank") == rows(similarity.similarity_topk(queries, index, 5), "query_id", "chunk_id", "rank")
    cost = built.cost(queries, 5)
    assert cost["all"] == 400 * 3000 and cost["scored"] < 0.15 * cost["all"]
    near = built.search(queries, 5, nprobe=4)
    assert vector_index.recall_against_exact(queries, index, near, 5) >= 0.95


def test_registered_approximate_search_finds_nine_of_ten(spark):
    t = catalog.Tables(spark, SF_DIR)
    near = catalog.QUERIES["retrieve_ann"](spark, SF_DIR)
    exact = catalog.QUERIES["retrieve_topk"](spark, SF_DIR)
    both = exact.join(near.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    assert both.count() >= 0.9 * exact.count() and exact.count() == 5 * t.embeddings.count()


def test_only_probed_lists_are_read(spark, vectors_small, tmp_path):
    queries, index, _ = vectors_small
    built = vector_index.build(index, str(tmp_path / "v"), lists=6)
    plan = built.search(queries.filter("query_id = 0"), 3, nprobe=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list_id" in plan or "PartitionFilters: [list_id" in plan


def test_index_of_odd_rows(spark, tmp_path):
    rows_ = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [0.0, -1.0]), (None, [0.5, 0.0]), (7, [None, 1.0]), (8, [0.0, 0.0])]
    index = spark.createDataFrame(rows_, "chunk_id int, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0])], "query_id int, embedding array<double>")
    built = vector_index.build(index, str(tmp_path / "v"))
    assert rows(built.search(queries, 9), "query_id", "chunk_id", "score") == rows_like(
        [(1, 1, 1.0), (1, None, 0.5), (1, 5, 0.0), (1, 8, 0.0)] + [(4, c, 0.0) for c in (1, None, 5, 8)])
    empty = vector_index.build(index.limit(0), str(tmp_path / "e"))
    assert len(empty) == 0 and empty.search(queries, 3).count() == 0


DOCS = [(0, "the cat sat on the mat"), (1, "The dog"), (2, ""), (3, "cat cat dog"), (4, None), (5, "bird")] + [(i, "the cat") for i in range(6, 16)]
QUERIES = [(1, "cat the"), (2, "dog"), (3, "nothing here"), (4, "Cat CAT bird")]


def test_a_block_of_vectors_is_scored_in_little_memory():
    """Candidates below what a query has found already are not held, and few vectors lie side by side."""
    rng = np.random.default_rng(6)
    asked, x, k = rng.normal(size=(20_000, 64)), rng.normal(size=(2_000, 64)), 10
    best = similarity.Best(k, len(asked))
    tracemalloc.start()
    for at in range(0, len(x), 40):
        similarity.score_blocks(asked, x, np.arange(at, at + 40), np.arange(len(asked)), best)
    q, row = best.pairs()
    scores = similarity.exact_scores(asked, x, q, row)
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
    assert len(q) == k * len(asked) and np.allclose(scores, np.einsum("ij,ij->i", asked[q], x[row]), atol=0, rtol=1e-12)
    for i in (0, 7, 4096, 19_999):
        assert set(row[q == i]) == set(np.argsort(-(x @ asked[i]))[:k])


@pytest.mark.parametrize("scheme", ["bm25", "tfidf"])
def test_keyword_search_matches_brute_force(spark, scheme):
    docs = spark.createDataFrame(DOCS, "doc_id int, text string").repartition(3)
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    tokens = {i: (t or "").lower().split() for i, t in DOCS}
    n, average = len(DOCS), sum(map(len, tokens.values())) / len(DOCS)
    want = []
    for qid, q in QUERIES:
        scored = []
        for d, words in tokens.items():
            score, hit = 0.0, False
            for term in set(q.lower().split()):
                df = sum(term in w for w in tokens.values())
                tf = words.count(term)
                if tf:
                    hit = True
                    if scheme == "bm25":
                        score += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / average))
                    else:
                        score += tf * np.log(n / df)
            if hit:
                scored.append((-round(score, 6), d))
        want += [(qid, d, -s) for s, d in sorted(scored)[:4]]
    built = keyword.KeywordIndex.build(docs, f"kw_{scheme}", "doc_id", "text")
    assert built.terms.filter("term = 'the'").first().df == 12
    for got in (keyword.keyword_topk(queries, docs, 4, scheme), built.search(queries, 4, scheme)):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
        assert [(q, c, pytest.approx(s)) for q, c, s in sorted(want)] == sorted(tuple(r) for r in got.select("query_id", "chunk_id", "score").collect())


@pytest.mark.parametrize("scheme", ["bm25", "tfidf"])
@pytest.mark.parametrize("ids", ["long", "string"])
def test_keyword_blocks_equal_the_postings(spark, monkeypatch, scheme, ids):
    """Also where ids repeat or are missing on either side, texts are copies or missing, and a word of every text weighs nothing."""
    monkeypatch.setattr(keyword_blocks, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(keyword_blocks, "BLOCK_TERMS", 20)
    monkeypatch.setattr(keyword_blocks, "_TOKENS", 50)
    rng = np.random.default_rng(4)
    texts = ["The " + " ".join(f"w{int(j)}" for j in rng.zipf(1.4, n) % 50) for n in rng.integers(0, 40, 90)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, "the w1 w2 the"), (None, "the w1"), (None, "w2 the"), (700, None)]
    docs += [(100 + i, "the w1 w2 w3") for i in range(30)]
    asked = [(i, f"The w{i} w1 w2 x{i}") for i in range(40)] + [(3, "w3 w4"), (None, "w5 the"), (50, ""), (51, None), (52, "the")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(ids)).repartition(5)
    queries = spark.createDataFrame(asked, "query_id long, query string")
    index = keyword_blocks.BlockIndex.build(docs)
    assert index.blocks.count() > 5
    want = rows(keyword.keyword_topk(queries, docs, 4, scheme))
    got = index.search(queries, 4, scheme)
    assert rows(got) == want and len(want) > 150
    # What is shuffled are the best of each pair of blocks, not all pairs that share a word.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(query_id") > 0 and "HashAggregate" not in plan


def met_blocks(texts, asked, k, scheme, floors=None):
    """``{query: {document: score}}`` that a block of documents, numbered as they are listed, sends on for a block of queries."""
    docs = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), pa.array([0] * len(texts), pa.int32())],
                                      names=["chunk_id", "text", "number"])
    block = next(keyword_blocks._block_of_documents(iter([docs])))
    words = [(t or "").split() for t in texts]
    n, average, held = len(texts), sum(map(len, words)) / len(texts), Counter(w for ws in words for w in set(ws))
    rows = [(q, w, float(np.log(1 + (n - held[w] + 0.5) / (held[w] + 0.5)) if scheme == "bm25" else np.log(n / held[w])), average)
            for q, ws in enumerate(asked) for w in set(ws.split()) if w in held]
    rows += [(q, None, f, None) for q, f in (floors or {}).items()]
    queries = pa.RecordBatch.from_pylist([dict(zip(("query_id", "term", "rarity", "average"), r)) for r in rows], pa.schema(
        [("query_id", pa.int64()), ("term", pa.string()), ("rarity", pa.float64()), ("average", pa.float64())]))
    grouped = next(keyword_blocks._block_of_queries(iter([queries])))
    both = pa.RecordBatch.from_arrays([*block.columns, *grouped.columns], names=[*block.schema.names, *grouped.schema.names])
    found = {}
    for batch in keyword_blocks._meeting(k, scheme)(iter([both])):
        for r in batch.to_pylist():
            found.setdefault(r["query_id"], {})[r["chunk_id"]] = r["score"]
    return found


def every_score(texts, asked, scheme):
    words = [Counter((t or "").split()) for t in texts]
    n, average, held = len(texts), sum(w.total() for w in words) / len(texts), Counter(w for ws in words for w in ws)
    scores = {}
    for q, ws in enumerate(asked):
        for d, of in enumerate(words):
            tfs = [(of[w], held[w]) for w in set(ws.split()) if w in of]
            if tfs and scheme == "bm25":
                scores.setdefault(q, {})[d] = sum(np.log(1 + (n - h + 0.5) / (h + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * of.total() / average)) for tf, h in tfs)
            elif tfs:
                scores.setdefault(q, {})[d] = sum(tf * np.log(n / h) for tf, h in tfs)
    return scores


def many_texts(rng, n, words):
    return ["the " + " ".join(f"w{int(j) % words}" for j in rng.zipf(1.2, m)) for m in rng.integers(1, 60, n)]


@pytest.mark.parametrize("scheme", ["bm25", "tfidf"])
@pytest.mark.parametrize("tile,long,left", [(16_384, 8192, 0.4), (128, 12, 0.9), (1024, 8192, 0.0)])
def test_bounded_totals_find_the_best(monkeypatch, scheme, tile, long, left):
    """Whatever is left out at first, and with floors or without; copies, questions of one word and of very many among them."""
    monkeypatch.setattr(keyword_blocks, "_TILE", tile)
    monkeypatch.setattr(keyword_blocks, "_LONG", long)
    monkeypatch.setattr(keyword_blocks, "_LEFT", left)
    rng = np.random.default_rng(7)
    texts = many_texts(rng, 900, 300)
    texts += texts[:40] * 3 + ["", None, "only"]
    asked = [" ".join(f"w{int(j) % 330}" for j in rng.zipf(1.2, m)) for m in rng.integers(1, 30, 150)]
    asked += ["the", "only", "nothing", "the only", " ".join(f"w{j}" for j in range(300))] + texts[:20]
    every = every_score(texts, asked, scheme)
    best = {q: sorted(of, key=lambda d: (-round(of[d], 9), d))[:5] for q, of in every.items()}
    floors = {q: keyword_blocks.STEP * int(every[q][ds[-1]] / keyword_blocks.STEP) for q, ds in best.items() if len(ds) == 5 and q % 3}
    for least in (None, floors):
        found = met_blocks(texts, asked, 5, scheme, least)
        assert found.keys() == best.keys()
        for q, of in found.items():
            assert all(abs(of[d] - every[q][d]) < 1e-8 for d in of)
            assert sorted(of, key=lambda d: (-round(of[d], 9), d))[:5] == best[q]


def test_a_block_sends_on_only_what_reaches_the_floor():
    """Before, every block of documents sent on its k best, however many blocks there are."""
    texts, asked = many_texts(np.random.default_rng(1), 400, 100), ["w1 w2 w3 w40", "w5 w50", "w7"]
    every = every_score(texts, asked, "bm25")
    floors = {0: sorted(every[0].values())[-2] - 1e-6, 1: max(every[1].values()) + 1}
    found = met_blocks(texts, asked, 5, "bm25", floors)
    assert len(found[0]) == 2 and 1 not in found and len(found[2]) >= 5


def test_blocks_cut_words_as_the_postings_do(spark):
    texts = ["a\x0bb\fc\rd", " \n a  a\t", "x\u00a0y\u2003z\x1cw\x85v", "", " ", None, "\u0130 \u03a3\u03a3 B", "b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(2)
    block, posted = keyword_blocks.BlockIndex.build(docs), keyword.KeywordIndex.over(docs)
    assert rows(block.terms, "term", "df", "n", "average") == rows(posted.terms, "term", "df", "n", "average")
    words = sum(len([w for w in re.split("[ \\t\\n\\x0b\\f\\r]+", t or "") if w]) for t in texts)
    assert block.corpus.first()["total"] == words


def test_most_blocks_are_searched_with_floors(spark, monkeypatch):
    """The later blocks send on few of the pairs that are met, and the hits are the same."""
    monkeypatch.setattr(keyword_blocks, "BLOCK_TOKENS", 400)
    sent = spark.sparkContext.accumulator(0)
    meeting = keyword_blocks._meeting

    def counted(k, scheme):
        run = meeting(k, scheme)

        def counting(batches):
            for batch in run(batches):
                sent.add(batch.num_rows)
                yield batch
        return counting

    monkeypatch.setattr(keyword_blocks, "_meeting", counted)
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame(list(enumerate(many_texts(rng, 1500, 200))), "doc_id long, text string")
    queries = spark.createDataFrame(list(enumerate(many_texts(rng, 40, 200))), "query_id long, query string")
    index = keyword_blocks.BlockIndex.build(docs)
    n = index.blocks.count()
    got = rows(index.search(queries, 3))
    assert n >= 64 and got == rows(keyword.keyword_topk(queries, docs, 3))
    assert sent.value < 0.6 * 3 * 40 * n


def test_hashing_encoder_is_stable_and_unit_length():
    vectors_, statuses = encoding.HashingEncoder().encode(["a b a", "a b a", "", None])
    assert np.array_equal(vectors_[0], vectors_[1]) and np.isclose(vectors_[0] @ vectors_[0], 1)
    assert vectors_[2] is None and statuses[2:] == ["ERROR: no direction"] * 2


def test_a_filter_on_hashed_vectors_does_not_make_them_again(spark):
    found = encoding.embed_hashing(spark.createDataFrame([(1, "a b")], "id int, text string"), "text")
    plan = found.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1


def test_hashing_in_the_jvm_equals_the_encoder(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 40, n)) for n in (1, 3, 60, 700)] + ["", None, " \n", "é ü\tß", "a b a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    native = encoding.embed_hashing(df, "text")
    assert "Arrow" not in native._jdf.queryExecution().executedPlan().toString()
    want = {r.id: (r.embedding, r.embedding_status) for r in encoding.embed(df, "text").collect()}
    for r in native.collect():
        vector, status = want[r.id]
        assert r.embedding_status == status and (r.embedding is None) == (vector is None)
        if vector is not None:
            assert np.allclose(r.embedding, vector, atol=1e-12)


def test_remote_encoder_keeps_order_retries_and_reports(spark):
    calls = {}

    def call(text):
        calls[text] = calls.get(text, 0) + 1
        if text == "flaky" and calls[text] < 3:
            raise RuntimeError("try again")
        if text == "broken":
            raise RuntimeError("no")
        return [float(len(text))]

    vectors_, statuses = encoding.RemoteEncoder(call).encode(["a", "flaky", "broken", "ccc"])
    assert vectors_ == [[1.0], [5.0], None, [3.0]]
    assert statuses == ["SUCCESS", "SUCCESS", "ERROR: no", "SUCCESS"]
    assert calls["flaky"] == 3 and calls["broken"] == 5
    df = spark.createDataFrame([(1, "ab"), (2, "abc")], "id int, text string")
    encoding.register_encoder("length", lambda: encoding.RemoteEncoder(lambda t: [float(len(t))]))
    got = encoding.embed(df, "text", factory=encoding.encoder_factory("length"))
    assert rows(got, "id", "embedding") == [(1, [2.0]), (2, [3.0])]


def test_normalize_zero_and_null(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    assert [r.u for r in df.select(vectors.l2_normalize(F.col("v")).alias("u")).collect()] == [[0.6, 0.8], None, None]


def test_embedding_report_counts_problems(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0],), (None,)], "embedding array<double>")
    r = encoding.embedding_report(df).first()
    assert (r.n_rows, r.n_null, r.min_dim, r.max_dim, r.n_zero, r.max_norm) == (3, 1, 1, 2, 1, 5.0)


def hits(spark, *data):
    return spark.createDataFrame(list(data), "query_id int, chunk_id int, score double, rank int")


def test_rank_fusion(spark):
    a = hits(spark, (1, 10, 0.9, 1), (1, 11, 0.8, 2))
    b = hits(spark, (1, 11, 5.0, 1), (1, 12, 4.0, 2))
    got = ranking.reciprocal_rank_fusion([a, b], 2)
    assert rows(got, "chunk_id", "rank", "n_lists") == [(10, 2, 1), (11, 1, 2)]


def test_threshold_includes_its_value(spark):
    assert rows(ranking.min_score(hits(spark, (1, 1, 0.5, 1), (1, 2, 0.4, 2)), 0.5), "chunk_id") == [(1,)]


def test_rerank_by_model(spark):
    df = spark.createDataFrame([(1, 1, "q", "bbb"), (1, 2, "q", "a"), (1, 3, "q", "cccc")], "query_id int, chunk_id int, query string, text string")
    got = ranking.rerank_by_model(df, lambda: lambda q, t: t.str.len().astype(float), "query", "text", 2)
    assert rows(got, "chunk_id", "rank") == [(1, 2), (3, 1)]


def test_context_uses_rank_order_and_metadata(spark):
    df = spark.createDataFrame([(1, 2, "second", "u2"), (1, 1, "first", "u1")], "query_id int, rank int, text string, doc_uri string")
    docs = df.withColumn("metadata", F.create_map(F.lit("k"), F.lit("v")))
    got = ranking.assemble_context(docs, "text", "doc_uri", "[{doc_uri}] {chunk_text} {metadata};")
    assert got.first().context == '[u1] first {"k":"v"};[u2] second {"k":"v"};'


def test_unknown_scorer_and_custom_scorer(spark):
    df = spark.createDataFrame([(1, 1, "a b", "a"), (1, 2, "a b", "zz")], "query_id int, chunk_id int, query string, text string")
    with pytest.raises(ValueError):
        ranking.rerank_by_scorer(df, "none", "query", "text", 1)
    ranking.register_scorer("longest", lambda q, t: F.length(t).cast("double"))
    assert rows(ranking.rerank_by_scorer(df, "longest", "query", "text", 1), "chunk_id") == [(2,)]


def test_filters_and_intent(spark):
    df = spark.createDataFrame([(1, "Reports from 2019, and 1999 in Paris."), (2, "12019 nothing")], "id int, text string")
    got = ranking.extract_filters(df, "text", {"years": r"\b(?:19|20)[0-9]{2}\b"}, {"places": ["paris", "rome"]})
    assert rows(got, "id", "years", "places") == [(1, ["1999", "2019"], ["paris"]), (2, [], [])]
    intents = ranking.classify_intent(df, "text", {"when": ["2019", "1999"], "where": ["paris"]})
    assert rows(intents, "id", "intent", "n_hits") == [(1, "when", 2), (2, "other", 0)]
