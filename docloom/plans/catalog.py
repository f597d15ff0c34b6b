"""The registered queries: each operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import markup, vectors
from docloom.functions import text as tx
from docloom.operators import (
    chunking, cleaning, diagnosis, dialogue, encoding, experiments, feedback, indexing, keyword_blocks, metrics,
    parsing, ranking, responses, semantic, settings, splitting, vector_index,
)
from docloom.operators.scaling import spread
from docloom.plans import sweep
from docloom.sources import inputs
from docloom.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Tables whose rows are costly to work on.
TEXT_TABLES = {"documents", "pages"}


class Tables:
    """The given tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = inputs.table(self._spark, self._dir, name)
        return spread(df) if name in TEXT_TABLES else df


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    return build


# --- parsing ---------------------------------------------------------------

@query
def parse_pages(t: Tables) -> DataFrame:
    parsed = parsing.apply_parser(inputs.raw_pages(t.pages), "html")
    flat = parsed.withColumn("doc_uri", tx.doc_uri(F.col("path"))).filter(F.col("parsing.status") == parsing.SUCCESS)
    return flat.select("page_id", "doc_uri", F.col("parsing.output").alias("doc_content"),
                       F.col("parsing.status").alias("parser_status"))


@query
def parse_dispatch(t: Tables) -> DataFrame:
    parsed = parsing.parse_by_extension(inputs.raw_pages(t.pages))
    return parsed.select("page_id", "ext", F.col("parsing.status").alias("parser_status"),
                         F.coalesce(F.length("parsing.output"), F.lit(0)).cast("long").alias("n_chars"))


@query
def html_to_markdown(t: Tables) -> DataFrame:
    return t.pages.select("page_id", markup.html_to_markdown(F.col("html")).alias("markdown"))


@query
def collapse_blank_lines(t: Tables) -> DataFrame:
    spaced = F.regexp_replace("text", r"\n", "\n\n\n\n")
    return t.documents.select("doc_id", tx.collapse_blank_lines(spaced).alias("text"))


@query
def parse_json_doc(t: Tables) -> DataFrame:
    parsed = parsing.parse_json_doc(t.events, "props", "k")
    return parsed.select("event_id", F.col("doc_parsed_contents")["parsed_content"].alias("parsed_content"),
                         F.size("doc_parsed_contents").cast("long").alias("n_keys"), "parser_status")


@query
def pages_to_text(t: Tables) -> DataFrame:
    parsed = inputs.page_arrays(t.documents).withColumn("parsed", parsing.pages_to_text(F.col("pages")))
    return parsed.select("doc_id", F.col("parsed")["parsed_content"].alias("parsed_content"),
                         F.col("parsed")["num_pages"].alias("num_pages"))


@query
def elements_to_text(t: Tables) -> DataFrame:
    return inputs.element_arrays(t.documents).select(
        "doc_id", parsing.elements_to_text(F.col("elements")).alias("parsed_content"))


@query
def doc_uri(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.doc_uri(F.col("url")).alias("doc_uri"))


@query
def extract_metadata(t: Tables) -> DataFrame:
    docs = inputs.parsed_docs(t.documents)
    rule = parsing.contains_word(F.col("doc_content"), "tion", "mentions tion", "plain")
    return parsing.extract_metadata(docs, {"example_metadata": rule}).select("doc_id", "doc_uri", "example_metadata")


@query
def parse_report(t: Tables) -> DataFrame:
    return parsing.parse_report(inputs.parsed_docs(t.documents))


@query
def quarantine_split(t: Tables) -> DataFrame:
    good, bad = parsing.split_status(inputs.parsed_docs(t.documents), F.col("parser_status"))
    return (good.select(F.lit("parsed").alias("sink"), "doc_id", "parser_status")
            .unionByName(bad.select(F.lit("quarantine").alias("sink"), "doc_id", "parser_status")))


@query
def strip_boilerplate(t: Tables) -> DataFrame:
    return cleaning.strip_boilerplate(t.documents, "doc_id", "text", min_docs=3)


@query
def parse_sample(t: Tables) -> DataFrame:
    sample = parsing.parse_sample(inputs.parsed_docs(t.documents).select("source", "doc_uri"), "source", "doc_uri", 3)
    return sample.select("source", "doc_uri", F.col("sample_no").cast("long").alias("sample_no"))


@query
def document_metadata(t: Tables) -> DataFrame:
    return parsing.document_metadata(inputs.raw_pages(t.pages)).select(
        "page_id", "title", "language", "host", "url_path", "url_query")


@query
def corpus_report(t: Tables) -> DataFrame:
    return parsing.corpus_report(inputs.parsed_docs(t.documents), ["source", "lang"])


# --- chunking --------------------------------------------------------------

def _places(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "doc_id", F.col("chunk_pos").cast("long").alias("chunk_pos"),
                         tx.token_count(F.col("chunked_text")).alias("n_tokens"))


@query
def chunk_token_window(t: Tables) -> DataFrame:
    return _places(chunking.chunk_tokens(t.documents, "text", 384, 128, ["doc_id"]))


@query
def chunk_char_window(t: Tables) -> DataFrame:
    return _places(chunking.chunk_chars(t.documents, "text", 1500, 250, ["doc_id"]))


@query
def chunk_paragraph(t: Tables) -> DataFrame:
    return _places(chunking.chunk_paragraphs(t.documents, "text", ["doc_id"]))


@query
def chunk_sentence(t: Tables) -> DataFrame:
    return _places(chunking.chunk_sentences(t.documents, "text", ["doc_id"]))


@query
def chunk_markdown_headers(t: Tables) -> DataFrame:
    sections = chunking.markdown_sections(inputs.markdown_docs(t.documents), "doc_id", "markdown")
    whole = F.concat_ws("\n", "h1", "h2", "h3", "body")
    return sections.select("doc_id", "h1", "h2", "h3", tx.chunk_id(whole).alias("chunk_id"))


@query
def chunk_quarantine(t: Tables) -> DataFrame:
    """Documents that the heading chunker makes no chunk of."""
    docs = inputs.outline_docs(t.documents)
    chunks = chunking.chunk_by_name("markdown", docs, "markdown", ["doc_id"])
    return chunking.without_chunk(docs, chunks, "markdown", ["doc_id"], "doc_id")


@query
def chunk_id(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.chunk_id(F.col("text")).alias("chunk_id"))


@query
def chunk_propagate(t: Tables) -> DataFrame:
    chunks = chunking.chunk_paragraphs(inputs.parsed_docs(t.documents), "doc_content", ["doc_uri", "lang", "source"])
    return chunks.select("chunk_id", "doc_uri", "lang", "source", F.col("chunk_pos").cast("long").alias("chunk_pos"))


@query
def chunk_metadata_columns(t: Tables) -> DataFrame:
    html = F.col("html")
    contents = F.create_map(
        F.lit("parsed_content"), markup.html_to_markdown(html),
        F.lit("title"), markup.html_title(html), F.lit("language"), markup.html_language(html))
    docs = t.pages.select("page_id", contents.alias("doc_parsed_contents"))
    wide = chunking.metadata_columns(docs)
    body = wide.withColumn("body", F.col("doc_parsed_contents")["parsed_content"])
    chunks = chunking.chunk_paragraphs(body, "body", ["page_id", "title", "language"])
    return chunks.select("chunk_id", "page_id", F.col("chunk_pos").cast("long").alias("chunk_pos"), "title", "language")


# Chunk specs as (size, overlap), two of which do not suit every model.
SPECS = {"s384_128": (384, 128), "s512_256": (512, 256), "s1024_256": (1024, 256),
         "s4096_256": (4096, 256), "s8192_0": (8192, 0), "bad_overlap": (100, 200)}
GOOD_SPECS = {name: so for name, so in SPECS.items() if so[1] < so[0]}
MODELS = {"gte-large": 8192, "bge-large": 512, "text-embedding-small": 8192}


@query
def chunk_spec_check(t: Tables) -> DataFrame:
    """Per spec and model: what is wrong, and how many documents the spec keeps in one piece."""
    specs = F.array(*[F.struct(F.lit(n).alias("spec"), F.lit(s).alias("size"), F.lit(o).alias("overlap"))
                      for n, (s, o) in SPECS.items()])
    sized = t.documents.select(tx.token_count(F.col("text")).alias("n"), F.explode(specs).alias("s"))
    per_spec = sized.groupBy("s.spec", "s.size", "s.overlap").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("n") <= F.col("s.size")).alias("n_whole"))
    paired = per_spec.select("*", F.explode(chunking.model_rows(MODELS)).alias("m"))
    problem = chunking.spec_problem(F.col("size"), F.col("overlap"), F.col("m.context_window"))
    return paired.select("spec", F.col("m.model").alias("model"), "n_docs", "n_whole",
                         F.coalesce(problem, F.lit("ok")).alias("problem"))


@query
def chunk_context_fit(t: Tables) -> DataFrame:
    chunks = chunking.chunk_tokens(t.documents, "text", 1024, 256, ["doc_id"])
    return chunking.chunk_fit(chunks, windows=MODELS)


@query
def chunk_stats(t: Tables) -> DataFrame:
    text = F.col("text")
    chunks = sweep.chunk_all(t.documents, ["doc_id"], {
        "window": chunking.token_windows(text, 512, 256), "chars": chunking.char_windows(text, 1500, 250),
        "paragraph": tx.paragraphs(text), "sentence": tx.sentences(text)})
    return chunking.chunk_stats(chunks, ["strategy"])


@query
def chunk_prefix_metadata(t: Tables) -> DataFrame:
    chunks = chunking.chunk_paragraphs(inputs.parsed_docs(t.documents), "doc_content", ["doc_uri", "lang"])
    prefixed = chunking.prefix_metadata(chunks, ["doc_uri", "lang"])
    return prefixed.select("doc_uri", F.col("chunk_pos").cast("long").alias("chunk_pos"),
                           F.md5("prefixed_text").alias("prefixed_id"))


@query
def chunk_dedup(t: Tables) -> DataFrame:
    chunks = chunking.chunk_paragraphs(t.documents, "text", ["doc_id"])
    unique = chunking.dedup_chunks(chunks, "doc_id")
    return unique.select("chunk_id", "doc_id", F.col("chunk_pos").cast("long").alias("chunk_pos"), "n_copies",
                         F.length("chunked_text").cast("long").alias("n_chars"))


@query
def chunk_recursive(t: Tables) -> DataFrame:
    return _places(splitting.chunk_recursive(t.documents, "text", 256, 64, ["doc_id"]))


MAX_SENTENCE = 24
SEMANTIC_MAX = 128


@query
def split_oversize_sentence(t: Tables) -> DataFrame:
    parts = semantic.fitting_sentences(F.col("text"), MAX_SENTENCE)
    return t.documents.select("doc_id", F.posexplode(parts).alias("pos", "p")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.md5("p.part").alias("part_id"))


@query
def neighbour_cosine_distance(t: Tables) -> DataFrame:
    spoken = t.documents.select("doc_id", tx.sentences(F.col("text")).alias("sentences"))
    gaps = spoken.select("doc_id", F.posexplode(semantic.neighbour_distances(F.col("sentences"))).alias("pos", "distance"))
    return gaps.select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("distance", 6).alias("distance"))


@query
def distance_percentile(t: Tables) -> DataFrame:
    staged = semantic.semantic_groups(t.documents, "text", SEMANTIC_MAX)
    return staged.filter(F.col("threshold").isNotNull()).select("doc_id", F.round("threshold", 6).alias("threshold"))


@query
def segment_sentences(t: Tables) -> DataFrame:
    staged = semantic.semantic_groups(t.documents, "text", SEMANTIC_MAX)
    return staged.select("doc_id", F.explode("groups").alias("g")).select(
        "doc_id", F.col("g.start").cast("long").alias("first_sentence"), F.col("g.len").cast("long").alias("n_sentences"))


@query
def chunk_semantic(t: Tables) -> DataFrame:
    return _places(semantic.chunk_semantic(t.documents, "text", ["doc_id"], SEMANTIC_MAX))


# --- embedding -------------------------------------------------------------

@query
def embed_hashing(t: Tables) -> DataFrame:
    embedded = encoding.embed_hashing(t.documents.select("doc_id", "text"), "text")
    exploded = embedded.select("doc_id", F.posexplode("embedding").alias("bucket", "weight"))
    return exploded.filter(F.col("weight") != 0).select("doc_id", F.col("bucket").cast("long").alias("bucket"),
                                                        F.round("weight", 6).alias("weight"))


@query
def embedding_normalize(t: Tables) -> DataFrame:
    doubled = F.transform("embedding", lambda x: x * 2)
    unit = t.embeddings.select("vec_id", vectors.l2_normalize(doubled).alias("unit"))
    return unit.select("vec_id", F.posexplode("unit").alias("dim", "v")).select(
        "vec_id", F.col("dim").cast("long").alias("dim"), F.round("v", 5).alias("value"))


@query
def embedding_report(t: Tables) -> DataFrame:
    return encoding.embedding_report(t.embeddings)


# --- retrieval -------------------------------------------------------------

def _vectors(t: Tables) -> vector_index.VectorIndex:
    return vector_index.built_once(inputs.vector_index(t.embeddings), t.embeddings, "embeddings", ["label", "doc_id"])


def _topk(t: Tables, k: int = 5, where=None, nprobe: int | None = None) -> DataFrame:
    return _vectors(t).search(inputs.vector_queries(t.embeddings), k, nprobe, where, ["label", "doc_id"])


def _hits(t: Tables, k: int = 5) -> DataFrame:
    """Ranked hits with labels; a hit is relevant when its label is the query's."""
    asked = inputs.vector_queries(t.embeddings).select("query_id", F.col("label").alias("query_label"))
    return _topk(t, k).join(asked, "query_id").withColumn("relevant", F.col("label") == F.col("query_label"))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query
def retrieve_topk(t: Tables) -> DataFrame:
    return _shown(_topk(t))


# Share of the lists that an approximate search of the embeddings probes.
PROBED = 0.6


@query
def retrieve_ann(t: Tables) -> DataFrame:
    return _shown(_topk(t, nprobe=max(1, round(PROBED * len(_vectors(t).list_ids)))))


@query
def retrieve_ann_all_lists(t: Tables) -> DataFrame:
    """The approximate search with all lists probed, which is exact."""
    return _shown(_topk(t, nprobe=len(_vectors(t).list_ids)))


@query
def retrieve_threshold(t: Tables) -> DataFrame:
    return _shown(ranking.min_score(_topk(t), 0.4))


@query
def retrieve_filtered(t: Tables) -> DataFrame:
    return _shown(_topk(t, where=F.col("label").isin(1, 3, 5)))


@query
def retrieve_by_document(t: Tables) -> DataFrame:
    grouped = ranking.group_by_document(_topk(t, 10), "doc_id")
    return grouped.withColumn("first_rank", F.col("first_rank").cast("long"))


def _embedded_queries(t: Tables) -> DataFrame:
    return encoding.embed_hashing(inputs.text_queries(t.benchmark), "query")


def _document_vectors(t: Tables) -> vector_index.VectorIndex:
    docs = encoding.embed_hashing(t.documents.select(F.col("doc_id").alias("chunk_id"), "text"), "text")
    return vector_index.built_once(docs, t.documents, "documents")


def _semantic_hits(t: Tables, k: int) -> DataFrame:
    return _document_vectors(t).search(_embedded_queries(t), k)


def _keyword_hits(t: Tables, k: int, scheme: str = "bm25") -> DataFrame:
    return keyword_blocks.built_once(t.documents, "documents").search(inputs.text_queries(t.benchmark), k, scheme)


def _found(t: Tables, asked: DataFrame, k: int) -> DataFrame:
    """The k best keyword hits of ``query_id, query`` with ``doc_uri`` and ``content``."""
    hits = keyword_blocks.built_once(t.documents, "documents").search(asked, k)
    docs = inputs.parsed_docs(t.documents).select(F.col("doc_id").alias("chunk_id"), "doc_uri", F.col("doc_content").alias("content"))
    return ranking.with_index_columns(hits, docs, ["doc_uri", "content"])


def _with_texts(t: Tables, hits: DataFrame, columns: list[str]) -> DataFrame:
    docs = inputs.parsed_docs(t.documents).withColumnRenamed("doc_id", "chunk_id")
    return ranking.with_index_columns(hits, docs, columns).join(inputs.text_queries(t.benchmark), "query_id")


@query
def retrieve_documents(t: Tables) -> DataFrame:
    hits = _with_texts(t, _semantic_hits(t, 5), ["doc_content", "doc_uri", "lang", "source"])
    docs = ranking.to_documents(hits, "doc_content", "doc_uri", ["lang", "source"])
    m = F.col("metadata")
    return docs.select("query_id", F.col("rank").cast("long").alias("rank"), F.md5("page_content").alias("page_id"),
                       m["doc_uri"].alias("doc_uri"), m["lang"].alias("lang"), m["source"].alias("source"),
                       m["similarity_score"].cast("double").alias("score"), "type")


@query
def retrieve_bm25(t: Tables) -> DataFrame:
    return _shown(_keyword_hits(t, 10))


@query
def retrieve_tfidf(t: Tables) -> DataFrame:
    return _shown(_keyword_hits(t, 10, "tfidf"))


@query
def retrieve_hybrid_rrf(t: Tables) -> DataFrame:
    fused = ranking.reciprocal_rank_fusion([_semantic_hits(t, 20), _keyword_hits(t, 20)], 10)
    return _shown(fused)


@query
def retrieve_hybrid_two_step(t: Tables) -> DataFrame:
    candidates = _with_texts(t, _semantic_hits(t, 50).drop("rank"), ["doc_content"])
    best = ranking.two_step(candidates, "query", "doc_content", 10, 0.5)
    return best.select("query_id", "chunk_id", "keyword_score", "combined_score", F.col("rank").cast("long").alias("rank"))


@query
def rerank_overlap(t: Tables) -> DataFrame:
    hits = _with_texts(t, _keyword_hits(t, 20), ["doc_content"])
    best = ranking.rerank_by_scorer(hits.drop("rank"), "overlap", "query", "doc_content", 5)
    return best.select("query_id", "chunk_id", "rerank_score", F.col("rank").cast("long").alias("rank"))


@query
def rerank_recency(t: Tables) -> DataFrame:
    """The newest of the keyword hits, a later document having the higher number."""
    best = ranking.rerank(_keyword_hits(t, 20).drop("rank"), F.desc("chunk_id"), 5)
    return _shown(best)


@query
def retrieve_expanded(t: Tables) -> DataFrame:
    asked = inputs.text_queries(t.benchmark)
    variants = asked.select("query_id", F.posexplode(tx.sentences(F.col("query"))).alias("n", "variant"))
    named = variants.select("query_id", F.concat_ws("/", F.col("query_id").cast("string"), F.col("n").cast("string"))
                            .alias("variant_id"), "variant")
    best = ranking.expand_topk(encoding.embed_hashing(named, "variant"), _document_vectors(t).search, 5)
    return best.select("query_id", "chunk_id", "score", "n_variants", F.col("rank").cast("long").alias("rank"))


# What the filter and intent queries look for.
YEAR = r"\b(?:19|20)[0-9]{2}\b"
VOCABULARY = ["and", "der", "les", "los", "para", "the", "und", "une"]
INTENTS = {"en": ["and", "in", "of", "the", "to"], "fr": ["de", "elle", "le", "les", "que"],
           "de": ["der", "die", "ich", "und", "von"], "es": ["de", "el", "la", "los", "que"]}


@query
def extract_query_filters(t: Tables) -> DataFrame:
    found = ranking.extract_filters(t.documents, "text", {"years": YEAR}, {"terms": VOCABULARY})
    return found.select("doc_id", F.array_join("years", ",").alias("years"), F.array_join("terms", ",").alias("terms"))


@query
def classify_intent(t: Tables) -> DataFrame:
    return ranking.classify_intent(t.conversations, "text", INTENTS).select("conv_id", "turn", "intent", "n_hits")


@query
def assemble_context(t: Tables) -> DataFrame:
    hits = _with_texts(t, _semantic_hits(t, 3), ["doc_content", "doc_uri"])
    context = ranking.assemble_context(hits, "doc_content", "doc_uri", "Passage: {chunk_text}\nSource: {doc_uri}\n")
    return context.select("query_id", F.md5("context").alias("context_id"), F.length("context").cast("long").alias("n_chars"),
                          "n_chunks")


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    """An index of the documents not yet known to be good, and the same corpus without
    the toxic ones, good ones added and numbers masked."""
    docs = inputs.parsed_docs(t.documents).join(t.labels, "doc_id", "left")
    old = docs.filter(F.coalesce(F.col("quality"), F.lit(0)) == 0)
    new = docs.filter(F.coalesce(F.col("toxic"), F.lit(0)) == 0).withColumn(
        "doc_content", F.regexp_replace("doc_content", "[0-9]+", "#"))

    def chunks(df: DataFrame) -> DataFrame:
        parts = chunking.chunk_paragraphs(df, "doc_content", ["doc_uri"])
        return parts.withColumn("chunk_id", tx.positional_chunk_id(F.col("doc_uri"), F.col("chunk_pos"))).select(
            "chunk_id", "doc_uri", "chunked_text")

    return chunks(old), chunks(new)


@query
def index_sync_changes(t: Tables) -> DataFrame:
    return indexing.index_changes(*_snapshots(t))


@query
def index_sync_apply(t: Tables) -> DataFrame:
    """The index after a sync; ``origin`` is 0 where the row of before is kept."""
    old, new = _snapshots(t)
    synced = indexing.apply_changes(old.withColumn("origin", F.lit(0).cast("long")), new)
    return synced.select("chunk_id", "doc_uri", F.md5("chunked_text").alias("text_id"), "origin")


@query
def index_coverage(t: Tables) -> DataFrame:
    """Documents by source, and those whose only chunks are too short to be indexed."""
    docs = inputs.parsed_docs(t.documents)
    good = docs.filter(F.col("parser_status") == parsing.SUCCESS)
    indexed = chunking.chunk_paragraphs(good, "doc_content", ["doc_id"]).filter(tx.token_count(F.col("chunked_text")) >= 8)
    return indexing.index_coverage(docs, indexed, "doc_id", "source")


# --- conversations ---------------------------------------------------------

GROUNDED = "Answer from these passages only.\n\n"
REWRITE = "Make the last question stand alone.\n\nSo far:\n{history}\n\nQuestion: {question}\n"


@query
def conversation_messages(t: Tables) -> DataFrame:
    paged = dialogue.messages(inputs.turns(t.conversations))
    shown = F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"]))
    return paged.select("conv_id", "page", F.size("messages").cast("long").alias("n_messages"),
                        F.array_join(shown, "\n").alias("messages"))


@query
def conversation_last_query(t: Tables) -> DataFrame:
    return dialogue.last_query(inputs.turns(t.conversations))


@query
def conversation_history(t: Tables) -> DataFrame:
    return dialogue.history(inputs.turns(t.conversations)).select("conv_id", "turn", "role", "content")


@query
def conversation_format_history(t: Tables) -> DataFrame:
    return dialogue.format_history(inputs.turns(t.conversations))


@query
def conversation_history_messages(t: Tables) -> DataFrame:
    return dialogue.history_messages(inputs.turns(t.conversations)).select("conv_id", "turn", "role", "content")


@query
def conversation_rewrite_needed(t: Tables) -> DataFrame:
    return dialogue.rewrite_needed(inputs.turns(t.conversations))


@query
def rewrite_prompt(t: Tables) -> DataFrame:
    return dialogue.rewrite_prompt(inputs.turns(t.conversations), REWRITE)


@query
def condense_query(t: Tables) -> DataFrame:
    return dialogue.condense_query(inputs.turns(t.conversations), 3)


@query
def build_prompt(t: Tables) -> DataFrame:
    turns = inputs.turns(t.conversations)
    asked = dialogue.last_user_query(turns).select(F.col("conv_id").alias("query_id"), F.col("question").alias("query"))
    context = dialogue.retrieved_context(_found(t, asked, 3)).withColumnRenamed("query_id", "conv_id")
    return dialogue.build_prompt(turns, F.concat(F.lit(GROUNDED), "context"), context)


@query
def conversation_drop_system(t: Tables) -> DataFrame:
    return dialogue.drop_system(inputs.turns(t.conversations))


@query
def conversation_budget(t: Tables) -> DataFrame:
    return dialogue.prompt_budget(inputs.turns(t.conversations), 200).select(
        "conv_id", "turn", "tokens", "tokens_to_end", "fits")


# Formats and terms of the response checks.
FORMATS = {"is_object": r"^\{.*\}$", "ends_a_sentence": r"[.!?]$", "has_lines": r"\n"}
BLOCKED = ["casino", "password", "the", "une", "und"]
SORRY = "No answer can be given."


def _answers(t: Tables) -> DataFrame:
    return inputs.turns(t.conversations).filter(F.col("role") == "assistant").select("conv_id", "turn", "content")


def _supported(t: Tables) -> DataFrame:
    """Each answer with the share of its words that the passages found for its question hold."""
    asked = inputs.request_log(t.conversations)
    context = dialogue.retrieved_context(_found(t, asked.select(F.col("request_id").alias("query_id"), F.col("request").alias("query")), 5))
    answers = _answers(t).withColumn("query_id", inputs.request_id(F.col("conv_id"), F.col("turn") - 1))
    joined = answers.join(context, "query_id", "left").drop("query_id")
    share = responses.support(F.col("content"), F.coalesce("context", F.lit("")))
    return joined.withColumn("support", F.round(F.coalesce(share, F.lit(0.0)), 6))


@query
def response_format(t: Tables) -> DataFrame:
    return responses.check_format(_answers(t), "content", FORMATS).drop("content")


@query
def response_filter(t: Tables) -> DataFrame:
    terms = t.conversations.sparkSession.createDataFrame([(w,) for w in BLOCKED], "term string")
    return responses.content_filter(_answers(t), ["conv_id", "turn"], "content", terms).drop("content")


@query
def response_support(t: Tables) -> DataFrame:
    return _supported(t).select("conv_id", "turn", "support")


@query
def response_fallback(t: Tables) -> DataFrame:
    checks = [("empty", F.col("content") == ""), ("unsupported", F.col("support") < 0.05)]
    return responses.fallback(_supported(t), "content", checks, SORRY).select(
        "conv_id", "turn", "fallback_reason", "final_response")


# --- feedback --------------------------------------------------------------

def _log(t: Tables) -> DataFrame:
    return inputs.assessment_log(t.events)


def _requests(t: Tables) -> DataFrame:
    """The request log with the five best keyword hits of each request as its trace."""
    return _traced(t, inputs.request_log(t.conversations))


def _traced(t: Tables, asked: DataFrame) -> DataFrame:
    return inputs.with_trace(asked, _found(t, asked.select(F.col("request_id").alias("query_id"), F.col("request").alias("query")), 5))


def _judged_requests(t: Tables) -> DataFrame:
    """The request log with traces where a chunk was rated good; the other traces are never looked at."""
    asked, good = inputs.request_log(t.conversations), feedback.good_chunk_requests(_log(t))
    traced = _traced(t, asked.join(good, "request_id", "left_semi"))
    return traced.unionByName(asked.join(good, "request_id", "left_anti"), allowMissingColumns=True)


def _attached(t: Tables, requests: DataFrame | None = None) -> DataFrame:
    log = _log(t)
    asked = requests or inputs.request_log(t.conversations)
    return feedback.attach_ground_truth(asked, feedback.dedup_assessments(log), feedback.rated_requests(log))


def _ratings(column: str = "retrieval_assessments"):
    return F.array_join(feedback.relevance_array(F.col(column)), ",")


def _uris(column) -> F.Column:
    return F.array_join(F.transform(column, lambda c: F.concat_ws("=", c["doc_uri"], c["content"])), ",")


@query
def feedback_latest_text(t: Tables) -> DataFrame:
    return feedback.dedup_text(_log(t)).select(
        "event_id", "request_id", F.col("source.id").alias("source_id"), "step_id",
        F.col("text_assessment.ratings.answer_correct.value").alias("answer_rating"),
        F.col("text_assessment.suggested_output").alias("suggested_output"))


@query
def feedback_latest_retrieval(t: Tables) -> DataFrame:
    return feedback.dedup_retrieval(_log(t)).select(
        "event_id", "request_id", F.col("source.id").alias("source_id"), "step_id",
        F.col("retrieval_assessment.position").cast("long").alias("position"),
        F.col("retrieval_assessment.ratings.answer_correct.value").alias("chunk_rating"))


@query
def feedback_nest_retrieval(t: Tables) -> DataFrame:
    nested = feedback.nest_retrieval(feedback.dedup_retrieval(_log(t)))
    positions = F.array_join(F.transform("retrieval_assessments", lambda a: a["position"].cast("string")), ",")
    return nested.select("request_id", "source_id", "step_id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("ts_micros"),
                         positions.alias("positions"), _ratings().alias("ratings"))


@query
def feedback_merge(t: Tables) -> DataFrame:
    return feedback.dedup_assessments(_log(t)).select(
        "request_id", "source_id", "step_id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("ts_micros"),
        F.col("text_assessment.ratings.answer_correct.value").alias("answer_rating"), _ratings().alias("ratings"))


@query
def feedback_attach(t: Tables) -> DataFrame:
    return _attached(t).select("request_id", "is_correct", "suggested_output", "source_user", "step_id", _ratings().alias("ratings"))


@query
def evalset_label(t: Tables) -> DataFrame:
    return feedback.label_records(_attached(t)).select(
        "request_id", "source_user", "step_id", "source_tag", "expected_response", "has_edit")


@query
def evalset_union(t: Tables) -> DataFrame:
    return feedback.union_of_classes(_attached(t)).select(
        "request_id", "source_user", "step_id", "source_tag", "expected_response", "has_edit")


@query
def evalset_chunk_relevance(t: Tables) -> DataFrame:
    return _attached(t).filter(F.col("retrieval_assessments").isNotNull()).select(
        "request_id", "source_user", "step_id", _ratings().alias("chunk_relevance"))


@query
def trace_retrieved_chunks(t: Tables) -> DataFrame:
    chunks = feedback.trace_chunks(F.col("trace"))
    return _requests(t).select("request_id", F.posexplode(chunks).alias("pos", "c")).select(
        "request_id", F.col("pos").cast("long").alias("pos"), "c.doc_uri", "c.content")


@query
def evalset_expected_context(t: Tables) -> DataFrame:
    context = feedback.expected_context(feedback.trace_chunks(F.col("trace")), F.col("retrieval_assessments"))
    return _attached(t, _judged_requests(t)).select("request_id", "source_user", "step_id", context.alias("c")).filter(
        F.col("c").isNotNull()).select("request_id", "source_user", "step_id", _uris(F.col("c")).alias("expected_context"))


def _evaluation_set(t: Tables) -> DataFrame:
    """The evaluation set for those who ask for its rows and tags, not for the expected context."""
    return feedback.create_evaluation_set(inputs.request_log(t.conversations), _log(t))


@query
def evaluation_set(t: Tables) -> DataFrame:
    made = feedback.create_evaluation_set(_judged_requests(t), _log(t))
    return made.withColumn("expected_retrieved_context", _uris(F.col("expected_retrieved_context")))


@query
def evaluation_set_one_row(t: Tables) -> DataFrame:
    return feedback.one_row_per_request(_evaluation_set(t)).select("request_id", "source_user", "step_id", "source_tag")


@query
def evalset_split(t: Tables) -> DataFrame:
    return feedback.split_eval_set(_evaluation_set(t)).select("request_id", "source_user", "step_id", "split")


@query
def evalset_report(t: Tables) -> DataFrame:
    return feedback.evalset_report(_evaluation_set(t))


@query
def feedback_agreement(t: Tables) -> DataFrame:
    return feedback.agreement(_log(t))


# --- evaluation ------------------------------------------------------------

@query
def metric_precision(t: Tables) -> DataFrame:
    return metrics.precision(inputs.vector_queries(t.embeddings).select("query_id"), _hits(t))


@query
def metric_document_recall(t: Tables) -> DataFrame:
    asked = inputs.vector_queries(t.embeddings).select("query_id", "label")
    hits = _hits(t, 10).select("query_id", F.col("query_label").alias("label"), "doc_id")
    return metrics.document_recall(asked, hits, inputs.vector_index(t.embeddings), ["label"], "doc_id")


def _truth_sizes(t: Tables) -> DataFrame:
    sizes = t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n_truth"))
    return inputs.vector_queries(t.embeddings).join(sizes, "label").select("query_id", "n_truth")


@query
def metric_at_k(t: Tables) -> DataFrame:
    return metrics.rank_metrics(_hits(t, 10), _truth_sizes(t), [1, 3, 5, 10])


@query
def metric_ndcg(t: Tables) -> DataFrame:
    return metrics.ndcg(_hits(t, 10), _truth_sizes(t), 10)


@query
def metric_summary(t: Tables) -> DataFrame:
    return metrics.summary(inputs.runs(t.events), "experiment")


@query
def metric_token_counts(t: Tables) -> DataFrame:
    return metrics.token_counts(inputs.turns(t.conversations))


@query
def metric_latency(t: Tables) -> DataFrame:
    return metrics.latency(inputs.runs(t.events), "experiment")


def _diagnosed(t: Tables, truth: bool) -> DataFrame:
    return diagnosis.root_cause(inputs.judged(t.documents, t.labels), truth)


@query
def root_cause_truth(t: Tables) -> DataFrame:
    return _diagnosed(t, True).select("request_id", "root_cause", "assessment", "rationale")


@query
def root_cause_no_truth(t: Tables) -> DataFrame:
    return _diagnosed(t, False).select("request_id", "root_cause", "assessment", "rationale")


@query
def root_cause_frequency(t: Tables) -> DataFrame:
    """Of all documents, those without a label included: their cause is null."""
    found = _diagnosed(t, False)

    def shares(by: str, kind: str) -> DataFrame:
        return diagnosis.cause_frequency(found, by, with_missing=True).withColumn("kind", F.lit(kind))

    return shares("root_cause", "cause").unionByName(shares("rationale", "rationale"))


@query
def drilldown_retrieval(t: Tables) -> DataFrame:
    return diagnosis.drilldown(_diagnosed(t, False), diagnosis.RETRIEVAL, [
        "request_id", "chunk_relevance_precision", "groundedness", "relevance_to_query", "assessment", "rationale"])


@query
def drilldown_suspects(t: Tables) -> DataFrame:
    return diagnosis.suspects(inputs.judged(t.documents, t.labels)).select(
        "request_id", "chunk_relevance_precision", "groundedness", "correctness", "reason")


def _long_metrics(t: Tables) -> DataFrame:
    return experiments.long_metrics(metrics.summary(inputs.runs(t.events), "experiment"))


@query
def metric_winners(t: Tables) -> DataFrame:
    return experiments.metric_winners(_long_metrics(t))


@query
def overall_winner(t: Tables) -> DataFrame:
    return experiments.overall_winner(_long_metrics(t))


@query
def relative_change(t: Tables) -> DataFrame:
    return experiments.relative_change(_long_metrics(t), ["avg_token_count", "avg_latency_seconds"])


@query
def monitor_tumbling(t: Tables) -> DataFrame:
    windows = monitor.monitor(inputs.runs(t.events), "1 hour")
    start = F.unix_micros(F.col("window.start").cast("timestamp"))
    return windows.select(start.alias("start_micros"), "experiment", "n_rows", "n_errors", "correct_percent", "avg_latency", "alert")


# --- settings and sweeps ---------------------------------------------------

def _settings(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Chunk settings per source: a common base, and overrides by how long the source's documents are."""
    sources = t.documents.groupBy("source").agg(
        F.max(tx.token_count(F.col("text"))).alias("longest"), F.count(F.lit(1)).alias("n"))
    base = settings.settings_rows(sources, "source", {
        "parser/name": F.lit("html"), "chunker/name": F.lit("window"), "chunker/size": F.lit(1500), "chunker/overlap": F.lit(250)})
    long = sources.filter(F.col("longest") > 600)
    override = settings.settings_rows(long, "source", {
        "chunker/size": F.lit(512), "embedding/name": F.lit("gte-large"), "corpus/documents": F.col("n")})
    return base, override


@query
def config_merge(t: Tables) -> DataFrame:
    return settings.merge_settings(*_settings(t))


@query
def config_diff(t: Tables) -> DataFrame:
    base, override = _settings(t)
    return settings.diff_settings(base, settings.merge_settings(base, override))


@query
def strategy_grid(t: Tables) -> DataFrame:
    """Strategies per raw format, with the files and bytes each would work on."""
    formats = inputs.raw_pages(t.pages).groupBy(F.substr("ext", F.lit(2)).alias("parser")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").cast("long").alias("total_length"))
    grid = settings.strategy_grid(formats, "parser", ["window", "recursive", "semantic"], ["gte-large", "bge-large"])
    return grid.select("strategy", "parser", "chunker", "encoder", "n_files", "total_length")


@query
def sweep_chunk_stats(t: Tables) -> DataFrame:
    return chunking.chunk_stats(sweep.sweep_chunks(t.documents, "text", ["doc_id"], GOOD_SPECS), ["strategy"])
