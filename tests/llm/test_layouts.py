"""Results that must not depend on how rows lie or where workers start, and whole rows out of the filters."""

import os
import subprocess
import sys
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import context_mixing, mixing, near_dedup
from tests.conftest import ROOT, SF_DIR
from tests.llm.conftest import ODD
from tests.llm.test_llm import edited, prose


def test_language_model_scores_are_equal_over_two_layouts(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    one, other = ({r.doc_id: r for r in context_mixing.scored(d, head=64).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert set(one) == set(other)
    for i, r in one.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (other[i].n_tokens, other[i].n_known, other[i].train_tokens)
        assert r.score == pytest.approx(other[i].score, rel=1e-5) and r.base_score == pytest.approx(other[i].base_score, rel=1e-9)


def test_a_word_is_spelled_alike_behind_any_other():
    together = context_mixing._letters([b"ab", b"", b"cde", b"ab"])
    apart = [context_mixing._letters([w]) for w in (b"ab", b"", b"cde", b"ab")]
    for k in range(2):
        assert together[k].tolist() == [x for part in apart for x in part[k].tolist()]


def test_words_and_bits_of_documents_in_a_group_are_those_of_each_alone():
    texts = [b"", None, b"\x0bOne\ttwo\r\n", "Ünï two\x00 ONE\x1c three".encode(), b" \f ", b"three", prose(3, 300).encode(), b"two one " * 90]
    words = [(t or b"").lower().split() for t in texts]
    code = context_mixing.Code({b"one": 9, b"two": 8, b"three": 2, b"w7": 1}, 8, 400)
    odds = np.random.default_rng(0).integers(-90, 90, (context_mixing.ORDERS, 1 << context_mixing.TABLE_BITS)).astype(np.int8)
    model = context_mixing.Model(code, odds, np.random.default_rng(1).random((context_mixing._PAIRS, 256)))
    for most in (1, 40, 10_000):
        parts = list(context_mixing._parts([pa.array([b"a b", *texts], pa.binary()).slice(1), pa.array(texts, pa.binary())], most))
        cut = [context_mixing.words_in(p) for p in parts]
        assert [w for part, _ in cut for w in context_mixing.listed(part)] == [w for own in words + words for w in own]
        assert [n for _, sizes in cut for n in sizes.tolist()] == [len(own) for own in words + words]
        groups = [context_mixing.Group(p, code) for p in parts]
        got = np.concatenate([context_mixing.mixed_bits(g, code, odds) + model.spell(g) for g in groups])
        alone = [context_mixing.Group(pa.array([t or b""], pa.binary()), code) for t in texts]
        want = [float((context_mixing.mixed_bits(g, code, odds) + model.spell(g))[0]) for g in alone]
        assert got.tolist() == pytest.approx(want + want, rel=1e-6)
        # An end sign knows no word of the document before its own.
        assert len({int(g.contexts[1][0]) for g in alone if len(g.symbols) == 1}) == 1


def test_learning_holds_one_table_of_counts():
    """A group of documents is added into the table, not counted into a second one of its size."""
    code = context_mixing.Code({b"w%d" % i: 400 - i for i in range(300)}, 50, 500)
    table = context_mixing.ORDERS * 2 * 4 << context_mixing.TABLE_BITS
    batch = pa.RecordBatch.from_arrays([pa.array([prose(i, 200).encode() for i in range(50)], pa.binary())], names=["text"])
    tracemalloc.start()
    try:
        rows = sum(r.num_rows for r in context_mixing._learned(SimpleNamespace(value=cloudpickle.dumps(code)))(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows and table < peak < 1.5 * table


def test_one_row_of_each_group_stays(spark, documents):
    base = prose(1, 120)
    rows = [(5, base, "en", "a"), (3, edited(base, 2, 0.005), "en", "a"), (None, base, "en", "a"), (None, base, "en", "b"),
            # A repeated id: one text copies another document, the other does not.
            (7, base, "en", "a"), (7, prose(9, 120), "en", "a"), (None, prose(4, 120), "en", "a"), (None, prose(4, 120), "en", "a")]
    table = documents(rows + ODD).withColumns({name: F.lit(1) for name in ("_gone", "row_key", "taken", "key", "grp", "at", "hash")})
    kept = near_dedup.deduplicated(table)
    assert kept.columns == table.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.filter("doc_id is null or doc_id < 100").collect())
    assert got == sorted([(False, 3, rows[1][1]), (False, 7, rows[5][1]), (True, 0, rows[6][1]), (True, 0, ODD[5][1]), (True, 0, "")])
    # Rows without words are linked with nothing; the repeated row is one.
    assert kept.filter("doc_id between 9001 and 9003").count() == 3 and kept.filter("doc_id = 9004").count() == 1


def test_the_mix_is_a_corpus(spark, documents):
    table = documents([(i, prose(i, 40), "en", "abc"[i % 3] if i % 7 else None) for i in range(200)] + ODD).withColumn("passes", F.lit(8))
    taken = mixing.corpus(table)
    assert taken.columns == [*table.columns, "_passes"]
    want = {(r.doc_id, r.source): r.taken // r.size for r in mixing.mixed(table).filter("taken > 0 and size > 0").collect()}
    assert {(r.doc_id, r.source): r._passes for r in taken.collect()} == want
    text = {r.doc_id: r.text for r in table.collect()}
    assert all(r.text == text[r.doc_id] for r in taken.filter("doc_id is not null").collect())
    assert mixing.corpus(table.limit(0)).count() == 0


def test_pipeline_keeps_texts(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert out.columns == [*docs.columns, "passes"] and out.filter("passes < 1 or trim(text) = ''").count() == 0
    lines = {r.doc_id: set(r.text.split("\n")) for r in docs.collect()}
    assert all(set(r.text.split("\n")) <= lines[r.doc_id] for r in out.collect())


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.driver.host", "127.0.0.1").getOrCreate())
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name in {names!r}:
        print(name, query(spark, {folder!r}).count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    names = ["op1_decontamination", "op7_url_filters", "op8_context_mixing", "op13_vector_codes", "retrieve_topk", "pipeline"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, names=names, folder=SF_DIR)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
    assert sorted(line.split()[0] for line in run.stdout.splitlines() if line.split()[0] in names) == sorted(names)
