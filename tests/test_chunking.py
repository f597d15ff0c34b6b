import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import chunking, semantic, splitting
from docloom.operators.encoding import HashingEncoder
from docloom.plans import sweep
from tests.conftest import rows


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def in_order(df, doc_id=0):
    return [r.chunked_text for r in df.filter(F.col("doc_id") == doc_id).orderBy("chunk_pos").collect()]


@pytest.mark.parametrize("size, overlap", [(4, 0), (4, 1), (5, 4), (100, 10)])
@pytest.mark.parametrize("n", [0, 1, 4, 5, 17])
def test_token_windows_cover_every_token(spark, size, overlap, n):
    words = [f"w{i}" for i in range(n)]
    chunks = in_order(chunking.chunk_tokens(docs(spark, "  " + " \n".join(words)), "text", size, overlap, ["doc_id"]))
    rebuilt = []
    for i, chunk in enumerate(chunks):
        toks = chunk.split(" ")
        assert len(toks) <= size
        rebuilt += toks if i == 0 else toks[overlap:]
    assert rebuilt == words
    assert bool(chunks) == (n > 0)


def test_char_windows_cover_every_character(spark):
    text = "héllo wörld " * 9
    chunks = in_order(chunking.chunk_chars(docs(spark, text), "text", 20, 5, ["doc_id"]))
    assert chunks[0] + "".join(c[5:] for c in chunks[1:]) == text


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        chunking.chunk_tokens(docs(spark, "a"), "text", 4, 4, ["doc_id"])


def test_paragraphs_and_sentences(spark):
    df = docs(spark, " one. Two!\n\n \nthree? four ")
    assert in_order(chunking.chunk_paragraphs(df, "text", ["doc_id"])) == ["one. Two!", "three? four"]
    assert in_order(chunking.chunk_sentences(df, "text", ["doc_id"])) == ["one.", "Two!", "three?", "four"]


def test_markdown_headers_once_and_headless_sections_kept(spark):
    text = "intro\n# A\ntext a\n## B\ntext b\n### C\ntext c\n## D\ntext d\n# E\n### F\nlast\n#### not split"
    got = chunking.markdown_sections(docs(spark, text), "doc_id", "text")
    assert rows(got, "h1", "h2", "h3", "body") == sorted([
        (None, None, None, "intro"), ("A", None, None, "text a"), ("A", "B", None, "text b"), ("A", "B", "C", "text c"),
        ("A", "D", None, "text d"), ("E", None, "F", "last\n#### not split")],
        key=lambda t: tuple((x is None, str(type(x)), x or "") for x in t))
    texts = [r.chunked_text for r in chunking.chunk_markdown(docs(spark, text), "doc_id", "text").collect()]
    assert "A\nB\nC\ntext c" in texts and "intro" in texts


def split_by_hand(text, size, overlap, measure):
    """The recursive splitter in plain Python: slices before separators, then a greedy merge."""
    def pieces(part, level):
        if measure(part) <= size or len(part) <= 1:
            return [part]
        if level == 3:
            half = len(part) // 2
            return pieces(part[:half], 3) + pieces(part[half:], 3)
        mark, out, start = ["\n\n", "\n", " "][level], [], 0
        while start < len(part):
            cut = part.find(mark, start + 1)
            end = cut if cut >= 0 else len(part)
            out += pieces(part[start:end], level + 1)
            start = end
        return out

    chunks, held, fresh = [], [], False
    for piece in pieces(text, 0):
        n = measure(piece)
        if held and sum(map(measure, held)) + n > size:
            if fresh:
                chunks.append("".join(held).strip(" \t\n\v\f\r"))
            while held and (sum(map(measure, held)) > overlap or sum(map(measure, held)) + n > size):
                held.pop(0)
            fresh = False
        held.append(piece)
        fresh = fresh or measure(piece) > 0
    return chunks + (["".join(held).strip(" \t\n\v\f\r")] if fresh else [])


def n_words(text):
    return len([w for w in re.split("[ \t\n\v\f\r]+", text) if w])


@pytest.mark.parametrize("size, overlap", [(5, 0), (5, 2), (3, 1), (1, 0), (8, 7)])
def test_recursive_split_equals_the_plain_one(spark, size, overlap):
    rng = random.Random(size)
    texts = ["alpha beta gamma delta epsilon zeta.\n\nsecond paragraph here\nwith a line\n\n\nlast one two three four five six", "", " \n", "\n\n\n"]
    texts += ["".join(rng.choice(["a", "bb", " ", "  ", "\n", "\n\n", "\t", "é"]) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    df = docs(spark, *texts)
    got = df.select("doc_id", splitting.split_text(F.col("text"), size, overlap).alias("c")).collect()
    assert {r.doc_id: r.c for r in got} == {i: split_by_hand(t, size, overlap, n_words) for i, t in enumerate(texts)}


def test_recursive_split_cuts_words_when_measured_in_characters(spark):
    visible = lambda t: F.length(F.regexp_replace(t, "[ \t\n\x0B\f\r]", ""))
    chunks = docs(spark, "abcdefghij klm").select(splitting.split_text(F.col("text"), 4, 0, visible).alias("c")).first().c
    assert "".join(chunks).replace(" ", "") == "abcdefghijklm" and all(len(c.replace(" ", "")) <= 4 for c in chunks)


def test_folds_run_without_python_or_shuffle(spark):
    df = docs(spark, "One two. Three four.\n\n# Head\ntext.")
    for chunks in (splitting.chunk_recursive(df, "text", 3, 1, ["doc_id"]), semantic.chunk_semantic(df, "text", ["doc_id"]),
                   chunking.chunk_markdown(df, "doc_id", "text")):
        plan = chunks._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_recursive_chunks_in_spark(spark):
    df = docs(spark, "a b c\n\nd e f", "", None)
    got = splitting.chunk_recursive(df, "text", 3, 0, ["doc_id"])
    assert rows(got, "doc_id", "chunk_pos", "chunked_text") == [(0, 0, "a b c"), (0, 1, "d e f")]


def test_metadata_columns_keep_the_map(spark):
    df = spark.createDataFrame([(1, {"parsed_content": "t", "title": "x"}), (2, {"parsed_content": "u", "pages": "3"})],
                               "id int, doc_parsed_contents map<string,string>")
    wide = chunking.metadata_columns(df)
    assert wide.columns == ["id", "doc_parsed_contents", "pages", "title"]
    assert rows(wide, "id", "pages", "title") == [(1, None, "x"), (2, "3", None)]
    assert "parsed_content" in chunking.metadata_columns(df, keep_body=True).columns


def test_dedup_leaves_one_row_per_id_and_counts_copies(spark):
    df = docs(spark, *["same text"] * 50, "other")
    got = chunking.dedup_chunks(chunking.chunk_paragraphs(df, "text", ["doc_id"]), "doc_id")
    assert rows(got, "chunked_text", "doc_id", "n_copies") == [("other", 50, 1), ("same text", 0, 50)]


def test_chunk_spec(spark):
    assert chunking.check_chunk_spec(384, 128, "bge-large-en-v1.5") == 100.0
    for size, overlap, model in [(500, 100, "bge-large-en-v1.5"), (10, 20, "gte-large-en-v1.5"), (1, 0, "unknown")]:
        with pytest.raises(ValueError):
            chunking.check_chunk_spec(size, overlap, model)


def test_chunker_by_name(spark):
    chunking.register_chunker("whole", lambda df, text, keep: chunking.explode_chunks(df, F.array(F.col(text)), keep))
    assert in_order(chunking.chunk_by_name("whole", docs(spark, "a b"), "text", ["doc_id"])) == ["a b"]
    with pytest.raises(ValueError):
        chunking.chunk_by_name("none", docs(spark, "a"), "text", ["doc_id"])


def test_long_sentence_is_halved_until_it_fits(spark):
    sentence = " ".join(f"w{i}" for i in range(37))
    parts = docs(spark, sentence).select(semantic.halve_long(F.col("text"), 5).alias("p")).first().p
    assert "".join(p.part for p in parts) == sentence
    assert all(p.n <= 5 and p.n == len(p.part.split()) for p in parts) and len(parts) >= 8


def brute_groups(counts, gaps, limit, most, least):
    groups = []
    for i, n in enumerate(counts):
        if groups:
            held = groups[-1]
            if sum(counts[j] for j in held) + n <= most and not (len(held) % least == 0 and gaps[i - 1] > limit):
                held.append(i)
                continue
        groups.append([i])
    return [(g[0] + 1, len(g)) for g in groups]


def test_segments_follow_the_rule(spark):
    counts = [3, 4, 2, 9, 1, 1, 1, 1, 5, 2]
    gaps = [0.1, 0.2, 0.9, 0.3, 0.1, 0.1, 0.8, 0.2, 0.4, 0.0]
    for limit, most, least in [(0.5, 10, 3), (0.5, 100, 1), (2.0, 12, 2), (0.0, 100, 3)]:
        df = spark.createDataFrame([(counts, gaps, limit)], "c array<long>, g array<double>, t double")
        got = df.select(semantic.segment(F.col("c"), F.col("g"), F.col("t"), most, least).alias("s")).first().s
        assert [(g.start, g.len) for g in got] == brute_groups(counts, gaps, limit, most, least)


def test_hashed_gaps_equal_the_encoder(spark):
    rng = np.random.default_rng(3)
    spoken = [[" ".join(f"w{j}" for j in rng.integers(0, 30, rng.integers(0, 12))) for _ in range(n)] for n in (0, 1, 2, 9, 40)] + [None, [""], ["a", "a"]]
    df = spark.createDataFrame(list(enumerate(spoken)), "id int, s array<string>").coalesce(1)
    got, want = ({r.id: r.g for r in df.select("id", semantic.neighbour_distances(F.col("s"), f).alias("g")).collect()} for f in (None, HashingEncoder))
    assert got.pop(5) is None and want.pop(5) == []
    assert {i: pytest.approx(g, abs=2e-9) for i, g in want.items()} == got


@pytest.mark.parametrize("wanted", [lambda d: d.select(F.explode("groups").alias("g")).select("g.start"),
                                    lambda d: d.filter(F.col("threshold").isNotNull()).select("threshold")])
def test_a_filter_does_not_repeat_the_gaps(spark, wanted):
    """Filters, also those that Spark adds to an explode, once held the whole chain of sentences, gaps and groups several times."""
    plan = wanted(semantic.semantic_groups(docs(spark, "One. Two."), "text", 30))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(text#") == plan.count("md5(") == 1


def test_percentile_is_a_fraction(spark):
    df = spark.createDataFrame([([0.1, 0.5, 0.2, 0.9],), ([],)], "v array<double>")
    got = [r.p for r in df.select(semantic.array_percentile(F.col("v"), 0.95).alias("p")).collect()]
    assert got[0] == pytest.approx(0.84) and got[1] is None


def test_short_document_keeps_its_sentences(spark):
    got = semantic.chunk_semantic(docs(spark, "One. Two."), "text", ["doc_id"])
    assert in_order(got) == ["One.", "Two."]


def test_semantic_chunks_hold_every_sentence(spark):
    text = " ".join(f"Sentence {i} about topic {i // 5}." for i in range(40))
    chunks = in_order(semantic.chunk_semantic(docs(spark, text), "text", ["doc_id"], max_tokens=30))
    assert " ".join(chunks) == text and all(len(c.split()) <= 30 for c in chunks) and len(chunks) > 1


def test_sweep_equals_single_strategies(spark):
    df = docs(spark, " ".join(map(str, range(30))), "x y")
    swept = sweep.sweep_chunks(df, "text", ["doc_id"], {"a": (10, 2), "b": (4, 0)})
    for name, (size, overlap) in {"a": (10, 2), "b": (4, 0)}.items():
        alone = chunking.chunk_tokens(df, "text", size, overlap, ["doc_id"])
        columns = ["doc_id", "chunk_pos", "chunk_id", "chunked_text"]
        assert rows(swept.filter(F.col("strategy") == name), *columns) == rows(alone, *columns)
