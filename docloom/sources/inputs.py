"""Input frames of the registered queries, derived from the given tables.

The tables hold no click log, request trace, layout element or judge rating.
These views derive them, row by row, from the columns that are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parsed_docs(documents: DataFrame) -> DataFrame:
    """Parsed documents; the very short ones count as failed."""
    return documents.select(
        "doc_id",
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("doc_uri"),
        F.col("text").alias("doc_content"),
        "lang", "source", "n_chars",
        F.when(F.col("n_chars") < 100, "ERROR: too short").otherwise("SUCCESS").alias("parser_status"),
    )


def page_arrays(documents: DataFrame) -> DataFrame:
    """One row per document with its pages, one page per line."""
    pages = F.transform(lines(F.col("text")),
                        lambda t, i: F.struct(i.alias("page_number"), t.alias("parsed_content")))
    return documents.select("doc_id", pages.alias("pages"))


def element_arrays(documents: DataFrame) -> DataFrame:
    """One row per document with layout elements; every fifth is a table, half of those with HTML."""
    elements = F.transform(lines(F.col("text")), lambda t, i: F.struct(
        F.when(i % 5 == 4, "Table").otherwise("Text").alias("category"),
        t.alias("text"),
        F.when(i % 10 == 4, F.concat(F.lit("<b>"), t, F.lit("</b>"))).alias("text_as_html"),
    ))
    return documents.select("doc_id", elements.alias("elements"))


def markdown_docs(documents: DataFrame) -> DataFrame:
    """Documents with headings of levels 1-3 among their lines; the first line is never one."""
    marked = F.transform(lines(F.col("text")), lambda t, i: F.concat(
        F.when(i % 12 == 1, "# ").when(i % 12 == 4, "## ").when(i % 12 == 7, "### ").otherwise(""), t))
    return documents.select("doc_id", F.array_join(marked, "\n").alias("markdown"))


def raw_pages(pages: DataFrame) -> DataFrame:
    """Raw files; those cut off before their end have a format no parser knows."""
    return pages.select(
        "page_id", F.col("url").alias("path"), F.length("html").cast("long").alias("length"),
        F.col("html").alias("content"),
        F.when(F.contains("html", F.lit("</html>")), ".html").otherwise(".part").alias("ext"),
    )


def turns(conversations: DataFrame) -> DataFrame:
    """Conversation turns; some assistant turns are empty."""
    empty = (F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 11 == 0)
    return conversations.select("conv_id", "turn", "role", F.when(empty, "").otherwise(F.col("text")).alias("content"))


def outline_docs(documents: DataFrame) -> DataFrame:
    """As ``markdown_docs``, but documents of one or two lines are headings alone."""
    every = F.size(lines(F.col("text"))) <= 2
    marked = F.transform(lines(F.col("text")), lambda t, i: F.concat(
        F.when(every | (i % 12 == 1), "# ").when(i % 12 == 4, "## ").when(i % 12 == 7, "### ").otherwise(""), t))
    return documents.select("doc_id", F.array_join(marked, "\n").alias("markdown"))


def request_log(conversations: DataFrame) -> DataFrame:
    """One request per user turn with the assistant turn that follows it, if one does."""
    after = Window.partitionBy("conv_id").orderBy("turn")
    follows = F.when(F.lead("role").over(after) == "assistant", F.lead("text").over(after))
    return conversations.withColumn("response", follows).filter(F.col("role") == "user").select(
        request_id(F.col("conv_id"), F.col("turn")).alias("request_id"), F.col("text").alias("request"), "response")


def request_id(conversation: Column, turn: Column) -> Column:
    return F.concat_ws(":", conversation.cast("string"), turn.cast("string"))


def with_trace(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """Adds the JSON trace of the retrieval step; ``hits`` has ``query_id, rank, doc_uri, content``, a few per request."""
    found = hits.groupBy(F.col("query_id").alias("request_id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "doc_uri", "content"))).alias("found"))
    documents = F.transform(F.coalesce("found", F.array().cast("array<struct<rank:int,doc_uri:string,content:string>>")),
                            lambda h: F.struct(h["doc_uri"].alias("doc_uri"), h["content"].alias("content")))

    def span(kind: str, shown: Column) -> Column:
        return F.struct(F.lit(kind).alias("span_type"), shown.alias("documents"))

    spans = F.array(span("PARSER", F.slice(documents, 1, 0)), span("RETRIEVER", documents))
    return requests.join(found, "request_id", "left").select(
        *requests.columns, F.to_json(F.struct(spans.alias("spans"))).alias("trace"))


def assessment_log(events: DataFrame) -> DataFrame:
    """One row per reviewer click, in the nested shape of an assessment log."""
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int")
    kind = F.col("event_type")
    is_text = kind.isin("purchase", "error", "click")
    rating = F.when(kind == "purchase", "positive").when(kind == "error", "negative").when(kind == "click", "idk")
    edit = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("edit "), F.col("event_id").cast("string")))
    step = F.when(F.col("event_id") % 2 == 0, "step_a").otherwise("step_b")

    def ratings(value):
        return F.struct(F.struct(value.alias("value")).alias("answer_correct")).alias("ratings")

    text = F.struct(edit.alias("suggested_output"), ratings(rating))
    chunk = F.struct(
        (k % 5).alias("position"), step.alias("step_id"),
        ratings(F.when(kind == "view", "true").when(kind == "signup", "false")))
    return events.select(
        "event_id", request_id(F.col("user_id"), F.floor(k / 20)).alias("request_id"), step.alias("step_id"),
        F.col("ts").alias("timestamp"),
        F.struct(F.concat(F.lit("rev"), (F.col("event_id") % 3).cast("string")).alias("id")).alias("source"),
        F.when(is_text, text).alias("text_assessment"),
        F.when(kind.isin("view", "signup"), chunk).alias("retrieval_assessment"),
    )


def vector_queries(embeddings: DataFrame) -> DataFrame:
    """Every vector asks for its nearest neighbours, itself included."""
    return embeddings.select(F.col("vec_id").alias("query_id"), "embedding", "label")


def vector_index(embeddings: DataFrame) -> DataFrame:
    """Chunks of four to a document."""
    return embeddings.select(
        F.col("vec_id").alias("chunk_id"), "embedding", "label",
        F.floor(F.col("vec_id") / 4).cast("long").alias("doc_id"))


def text_queries(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per-request ratings out of the labels; a rating is null where the document has no label."""
    def yes(condition):
        return F.when(condition, "yes").when(~condition, "no")

    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("request_id"),
        ((F.col("n_chars") % 5).cast("double") / 4).alias("chunk_relevance_precision"),
        yes(F.col("quality") == 1).alias("groundedness"),
        yes(F.col("toxic") == 0).alias("relevance_to_query"),
        yes(F.col("doc_id") % 2 == 0).alias("correctness"),
    )


def runs(events: DataFrame) -> DataFrame:
    """Per-question results of several experiments, `poc` being the baseline."""
    group = F.col("user_id") % 5
    return events.select(
        "event_id", F.col("ts").alias("event_ts"),
        F.when(group == 0, "poc").otherwise(F.concat(F.lit("exp_"), group.cast("string"))).alias("experiment"),
        F.when(F.col("event_type") == "error", "no").otherwise("yes").alias("correctness"),
        F.regexp_extract("props", r"([0-9]+)", 1).cast("int").alias("total_token_count"),
        F.col("value").alias("latency_seconds"),
    )
