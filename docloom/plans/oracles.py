"""The registered queries as DuckDB SQL over the same tables.

Written apart from the Spark code: joins on dimension, recursive queries and
line-by-line windows where the library uses arrays and task-side kernels. The
Markdown steps, rule tables and word lists are imported, so they say nothing
about those being right; the tests check them against hand-written results.
"""

from __future__ import annotations

from docloom.functions.markup import ENTITIES, HTML_STEPS
from docloom.operators.diagnosis import RULES_WITH_TRUTH, RULES_WITHOUT_TRUTH
from docloom.plans.catalog import (
    BLOCKED, FORMATS, GOOD_SPECS, GROUNDED, INTENTS, MAX_SENTENCE, MODELS, REWRITE, SEMANTIC_MAX, SORRY, SPECS, VOCABULARY, YEAR,
)

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORD = r"'[^ \t\n\x0B\f\r]+'"


def s(text: str) -> str:
    """A SQL string literal, line breaks and all."""
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, {WORD})"


def n_words(x: str) -> str:
    return f"CAST(len({words(x)}) AS BIGINT)"


def sentences(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '[^.!?]+[.!?]*'), lambda p: {strip('p')}), lambda p: p <> '')"


def paragraphs(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '\\n+'), lambda p: {strip('p')}), lambda p: p <> '')"


def exploded(source: str, keep: str, array: str, item: str, pos: str = "pos") -> str:
    """Rows of a list with 0-based positions."""
    return (f"SELECT {keep}, CAST(unnest(range(len(_a))) AS BIGINT) AS {pos}, unnest(_a) AS {item} "
            f"FROM (SELECT {keep}, {array} AS _a FROM {source})")


def markdown(x: str) -> str:
    for pattern, replacement in HTML_STEPS:
        x = f"regexp_replace({x}, {s(pattern)}, {s(replacement.replace('$', chr(92)))}, 'g')"
    for entity, char in ENTITIES:
        x = f"replace({x}, {s(entity)}, {s(char)})"
    return strip(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


URI = r"regexp_replace(regexp_replace({x}, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?)?/*', '')"

DOCS = """docs_v AS (
  SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) AS doc_uri, text AS doc_content, lang, source, n_chars,
         CASE WHEN n_chars < 100 THEN 'ERROR: too short' ELSE 'SUCCESS' END AS parser_status
  FROM documents)"""

RAW = """raw_v AS (
  SELECT page_id, url AS path, length(html) AS length, html AS content,
         CASE WHEN contains(html, '</html>') THEN '.html' ELSE '.part' END AS ext FROM pages)"""

LINES = f"lines_v AS ({exploded('documents', 'doc_id', 'string_split(text, chr(10))', 'line')})"

TURNS = """turns_v AS (
  SELECT conv_id, turn, role,
         CASE WHEN role = 'assistant' AND (conv_id + turn) % 11 = 0 THEN '' ELSE text END AS content
  FROM conversations)"""

RUNS = """runs_v AS (
  SELECT event_id, ts AS event_ts,
         CASE WHEN user_id % 5 = 0 THEN 'poc' ELSE 'exp_' || CAST(user_id % 5 AS VARCHAR) END AS experiment,
         CASE WHEN event_type = 'error' THEN 'no' ELSE 'yes' END AS correctness,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS total_token_count, value AS latency_seconds
  FROM events)"""

JUDGE = """judge_v AS (
  SELECT d.doc_id AS request_id, CAST(d.n_chars % 5 AS DOUBLE) / 4 AS chunk_relevance_precision,
         CASE WHEN l.quality = 1 THEN 'yes' WHEN l.quality <> 1 THEN 'no' END AS groundedness,
         CASE WHEN l.toxic = 0 THEN 'yes' WHEN l.toxic <> 0 THEN 'no' END AS relevance_to_query,
         CASE WHEN d.doc_id % 2 = 0 THEN 'yes' ELSE 'no' END AS correctness
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

ORACLES: dict[str, str] = {}


def add(name: str, body: str, *ctes: str, recursive: bool = False) -> None:
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" if ctes else ""
    ORACLES[name] = head + body


# --- parsing ---------------------------------------------------------------

add("parse_pages", f"""SELECT page_id, {URI.format(x='path')} AS doc_uri, {markdown('content')} AS doc_content,
       'SUCCESS' AS parser_status FROM raw_v""", RAW)

add("parse_dispatch", f"""SELECT page_id, ext,
       CASE WHEN ext = '.html' THEN 'SUCCESS' ELSE 'ERROR: unsupported format ' || ext END AS parser_status,
       CASE WHEN ext = '.html' THEN length({markdown('content')}) ELSE 0 END AS n_chars FROM raw_v""", RAW)

add("html_to_markdown", f"SELECT page_id, {markdown('html')} AS markdown FROM pages")

add("collapse_blank_lines", r"""SELECT doc_id,
       regexp_replace(replace(text, chr(10), repeat(chr(10), 4)), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents""")

add("parse_json_doc", """SELECT event_id, json_extract_string(props, '$.k') AS parsed_content,
       CAST(len(json_keys(props)) AS BIGINT) AS n_keys, 'SUCCESS' AS parser_status FROM events""")

add("pages_to_text", """SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS parsed_content,
       CAST(count(*) AS VARCHAR) AS num_pages FROM lines_v GROUP BY doc_id""", LINES)

add("elements_to_text", f"""SELECT doc_id, {strip("string_agg(CASE WHEN pos % 5 = 4 THEN chr(10) || piece || chr(10) ELSE ' ' || line END, '' ORDER BY pos)")} AS parsed_content
FROM (SELECT doc_id, pos, line, CASE WHEN pos % 10 = 4 THEN {markdown("'<b>' || line || '</b>'")} ELSE line END AS piece FROM lines_v)
GROUP BY doc_id""", LINES)

add("doc_uri", f"SELECT page_id, {URI.format(x='url')} AS doc_uri FROM pages")

add("extract_metadata", """SELECT doc_id, doc_uri,
       CASE WHEN contains(doc_content, 'tion') THEN 'mentions tion' ELSE 'plain' END AS example_metadata FROM docs_v""", DOCS)

add("parse_report", f"""SELECT count(*) AS total, count(*) FILTER (WHERE parser_status <> 'SUCCESS') AS failed,
       count(*) FILTER (WHERE parser_status = 'SUCCESS' AND {strip('doc_content')} = '') AS empty FROM docs_v""", DOCS)

add("quarantine_split", """SELECT CASE WHEN parser_status = 'SUCCESS' THEN 'parsed' ELSE 'quarantine' END AS sink,
       doc_id, parser_status FROM docs_v""", DOCS)

add("strip_boilerplate", """SELECT doc_id,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT shared), '') AS clean_text,
       count(*) FILTER (WHERE shared) AS n_dropped
FROM (SELECT doc_id, pos, line, line IN (SELECT line FROM common_v) AS shared FROM lines_v) GROUP BY doc_id""",
    LINES, "common_v AS (SELECT line FROM lines_v GROUP BY line HAVING count(DISTINCT doc_id) >= 3)")

add("parse_sample", """SELECT source, doc_uri, sample_no FROM (
  SELECT source, doc_uri, row_number() OVER (PARTITION BY source ORDER BY md5(doc_uri), doc_uri) AS sample_no FROM docs_v)
WHERE sample_no <= 3""", DOCS)

add("document_metadata", r"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
       regexp_extract(html, '(?i)<html[^>]* lang="([A-Za-z-]+)"', 1) AS language,
       regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
       regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS url_path,
       regexp_extract(url, '\?([^#]*)', 1) AS url_query FROM pages""")

add("corpus_report", """SELECT source, lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS total_chars,
       count(*) FILTER (WHERE parser_status <> 'SUCCESS') AS n_failed FROM docs_v GROUP BY source, lang""", DOCS)


# --- chunking --------------------------------------------------------------

def token_chunks(size: int, overlap: int) -> str:
    """doc_id, pos, chunk: windows of tokens."""
    step = size - overlap
    return f"""SELECT doc_id, pos, array_to_string(toks[pos * {step} + 1 : pos * {step} + {size}], ' ') AS chunk
  FROM (SELECT doc_id, toks, unnest(range(greatest(1, CAST(ceil((len(toks) - {overlap}) / {float(step)}) AS BIGINT)))) AS pos
        FROM (SELECT doc_id, {words('text')} AS toks FROM documents) WHERE len(toks) > 0)"""


def char_chunks(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""SELECT doc_id, pos, substring(text, pos * {step} + 1, {size}) AS chunk
  FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil((length(text) - {overlap}) / {float(step)}) AS BIGINT)))) AS pos
        FROM documents WHERE length(text) > 0)"""


PARAGRAPHS = f"chunks_v AS ({exploded('documents', 'doc_id', paragraphs('text'), 'chunk')})"
SENTENCES = f"chunks_v AS ({exploded('documents', 'doc_id', sentences('text'), 'chunk')})"
PLACES = f"SELECT md5(chunk) AS chunk_id, doc_id, pos AS chunk_pos, {n_words('chunk')} AS n_tokens FROM chunks_v"

add("chunk_token_window", PLACES, f"chunks_v AS ({token_chunks(384, 128)})")
add("chunk_char_window", PLACES, f"chunks_v AS ({char_chunks(1500, 250)})")
add("chunk_paragraph", PLACES, PARAGRAPHS)
add("chunk_sentence", PLACES, SENTENCES)
add("chunk_id", "SELECT doc_id, md5(text) AS chunk_id FROM documents")

add("chunk_quarantine", f"""SELECT doc_id, CASE WHEN n IS NULL OR (n > 2 AND blank) THEN 'ERROR: no text' ELSE 'ERROR: no chunk' END AS chunker_status
FROM documents LEFT JOIN (
  SELECT doc_id, max(n) AS n, bool_and({strip('line')} = '' AND NOT (n <= 2 OR pos % 12 IN (1, 4, 7))) AS blank,
         bool_or({strip('line')} <> '' AND NOT (n <= 2 OR pos % 12 IN (1, 4, 7))) AS kept
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM lines_v) GROUP BY doc_id) USING (doc_id)
WHERE NOT coalesce(kept, FALSE)""", LINES)

add("chunk_markdown_headers", f"""SELECT doc_id, h1, h2, h3, md5(concat_ws(chr(10), h1, h2, h3, body)) AS chunk_id
FROM (SELECT doc_id, section, any_value(t1) AS h1, any_value(CASE WHEN p2 > coalesce(p1, -1) THEN t2 END) AS h2,
             any_value(CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN t3 END) AS h3,
             {strip("string_agg(CASE WHEN level = 0 THEN line END, chr(10) ORDER BY pos)")} AS body
      FROM carried GROUP BY doc_id, section) WHERE body <> ''""",
    LINES,
    f"""marked AS (SELECT doc_id, pos, level, {strip('title')} AS title, line FROM (
  SELECT doc_id, pos, CASE pos % 12 WHEN 1 THEN 1 WHEN 4 THEN 2 WHEN 7 THEN 3 ELSE 0 END AS level, line AS title, line FROM lines_v))""",
    """carried AS (SELECT doc_id, pos, level, line,
  sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER w AS section,
  max(CASE WHEN level = 1 THEN pos END) OVER w AS p1, max(CASE WHEN level = 2 THEN pos END) OVER w AS p2,
  max(CASE WHEN level = 3 THEN pos END) OVER w AS p3,
  last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS t1,
  last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER w AS t2,
  last_value(CASE WHEN level = 3 THEN title END IGNORE NULLS) OVER w AS t3
  FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))""")

add("chunk_propagate", """SELECT md5(chunk) AS chunk_id, d.doc_uri, d.lang, d.source, c.pos AS chunk_pos
FROM chunks_v c JOIN docs_v d ON c.doc_id = d.doc_id""", DOCS, PARAGRAPHS)

add("chunk_metadata_columns", "SELECT md5(chunk) AS chunk_id, page_id, pos AS chunk_pos, title, language FROM chunks_v",
    f"""md_v AS (SELECT page_id, {markdown('html')} AS body, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
       regexp_extract(html, '(?i)<html[^>]* lang="([A-Za-z-]+)"', 1) AS language FROM pages)""",
    f"chunks_v AS ({exploded('md_v', 'page_id, title, language', paragraphs('body'), 'chunk')})")


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else s(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


SPECS_V = f"specs_v AS (SELECT * FROM (VALUES {values([(n, a, b) for n, (a, b) in SPECS.items()])}) t(spec, size, overlap))"
MODELS_V = f"models_v AS (SELECT * FROM (VALUES {values(list(MODELS.items()))}) t(model, context_window))"

add("chunk_spec_check", f"""SELECT spec, model, n_docs, n_whole,
       CASE WHEN size + overlap > context_window THEN 'size plus overlap exceeds the context window'
            WHEN overlap > size THEN 'overlap exceeds size' ELSE 'ok' END AS problem
FROM (SELECT spec, size, overlap, count(*) AS n_docs, count(*) FILTER (WHERE n <= size) AS n_whole
      FROM specs_v, (SELECT {n_words('text')} AS n FROM documents) GROUP BY spec, size, overlap), models_v""", SPECS_V, MODELS_V)

add("chunk_context_fit", f"""SELECT model, context_window, count(*) AS n_chunks, max(n) AS max_tokens,
       count(*) FILTER (WHERE n > context_window) AS n_cut, round(avg(n / context_window) * 100, 4) AS avg_window_percent
FROM (SELECT {n_words('chunk')} AS n FROM chunks_v), models_v GROUP BY model, context_window""",
    f"chunks_v AS ({token_chunks(1024, 256)})", MODELS_V)

STATS = f"""SELECT strategy, count(*) AS n_chunks, min(n) AS min_tokens, max(n) AS max_tokens,
       CAST(sum(n) AS BIGINT) AS total_tokens, round(avg(n), 6) AS avg_tokens
FROM (SELECT strategy, {n_words('chunk')} AS n FROM all_v) GROUP BY strategy"""

add("chunk_stats", STATS, PARAGRAPHS, SENTENCES.replace("chunks_v", "sentences_v", 1), f"""all_v AS (
  SELECT 'window' AS strategy, chunk FROM ({token_chunks(512, 256)})
  UNION ALL SELECT 'chars', chunk FROM ({char_chunks(1500, 250)})
  UNION ALL SELECT 'paragraph', chunk FROM chunks_v
  UNION ALL SELECT 'sentence', chunk FROM sentences_v)""")

add("sweep_chunk_stats", STATS, "all_v AS (" + " UNION ALL ".join(
    f"SELECT {s(name)} AS strategy, chunk FROM ({token_chunks(a, b)})" for name, (a, b) in GOOD_SPECS.items()) + ")")

add("chunk_prefix_metadata", """SELECT d.doc_uri, c.pos AS chunk_pos,
       md5(concat_ws(chr(10), d.doc_uri, d.lang, c.chunk)) AS prefixed_id
FROM chunks_v c JOIN docs_v d ON c.doc_id = d.doc_id""", DOCS, PARAGRAPHS)

add("chunk_dedup", """SELECT md5(chunk) AS chunk_id, first.doc_id AS doc_id, first.pos AS chunk_pos, n_copies, length(chunk) AS n_chars
FROM (SELECT chunk, min({'doc_id': doc_id, 'pos': pos}) AS first, count(*) AS n_copies FROM chunks_v GROUP BY chunk)""", PARAGRAPHS)


def fitting(most: int) -> list[str]:
    """parts_v (doc_id, pos, part): sentences, halved until they fit."""
    return [
        SENTENCES.replace("chunks_v", "whole_v", 1),
        f"""halves AS (
  SELECT doc_id, pos, '' AS path, chunk AS part FROM whole_v
  UNION ALL
  SELECT doc_id, pos, path || side, CASE side WHEN '0' THEN substring(part, 1, CAST(length(part) // 2 AS BIGINT))
         ELSE substring(part, CAST(length(part) // 2 AS BIGINT) + 1) END
  FROM halves, (VALUES ('0'), ('1')) t(side) WHERE {n_words('part')} > {most})""",
        f"""parts_v AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, path) - 1 AS pos, part
  FROM halves WHERE {n_words('part')} <= {most})"""]


add("split_oversize_sentence", "SELECT doc_id, pos, md5(part) AS part_id FROM parts_v", *fitting(MAX_SENTENCE), recursive=True)


# The splitter: slices by level, numbered by their path; then one step per chunk over sums of slice lengths.
add("chunk_recursive", f"""SELECT md5(chunk) AS chunk_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_pos, {n_words('chunk')} AS n_tokens
FROM (SELECT doc_id, i, {strip("array_to_string(list_slice(parts, start + 1, i), '')")} AS chunk FROM jump JOIN listed USING (doc_id) WHERE pre[i + 1] > pre[prev + 1])""",
    f"""cut AS (
  SELECT doc_id, '' AS path, 0 AS level, text AS part FROM documents WHERE text <> ''
  UNION ALL
  SELECT doc_id, path || lpad(CAST(unnest(range(len(subs))) AS VARCHAR), 8, '0'), level + 1, unnest(subs) FROM (
    SELECT *, CASE level
        WHEN 0 THEN list_filter(string_split(regexp_replace(regexp_replace(replace(part, chr(10), chr(1) || chr(10)), '\\x01(\\n[^\\x01])', '\\1', 'g'), '\\x01(\\n)$', '\\1'), chr(1)), lambda x: x <> '')
        WHEN 1 THEN list_filter(string_split(replace(part, chr(10), chr(1) || chr(10)), chr(1)), lambda x: x <> '')
        WHEN 2 THEN list_filter(string_split(replace(part, ' ', chr(1) || ' '), chr(1)), lambda x: x <> '')
        ELSE [left(part, length(part) // 2), substr(part, length(part) // 2 + 1)] END AS subs
    FROM cut WHERE {n_words('part')} > 256 AND length(part) > 1))""",
    f"""slices AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY path) AS upto FROM (
  SELECT doc_id, path, part, {n_words('part')} AS n FROM cut WHERE NOT ({n_words('part')} > 256 AND length(part) > 1)))""",
    """listed AS MATERIALIZED (SELECT doc_id, list(part ORDER BY path) AS parts, list_prepend(0, list(CAST(upto AS BIGINT) ORDER BY path)) AS pre, count(*) AS cnt
  FROM slices GROUP BY doc_id)""",
    """jump AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS prev,
         coalesce(list_min(list_filter(range(1, cnt), lambda x: pre[x + 2] - pre[1] > 256)), cnt) AS i FROM listed
  UNION ALL
  SELECT doc_id, s, here, coalesce(list_min(list_filter(range(here + 1, cnt), lambda x: pre[x + 2] - pre[s + 1] > 256)), cnt) FROM (
    SELECT j.doc_id, j.i AS here, l.pre, l.cnt,
           list_min(list_filter(range(j.start, j.i + 1), lambda x: l.pre[j.i + 1] - l.pre[x + 1] <= least(64, 256 - (l.pre[j.i + 2] - l.pre[j.i + 1])))) AS s
    FROM jump j JOIN listed l USING (doc_id) WHERE j.i < l.cnt))""", recursive=True)


def hashed(source: str, key: str, text: str, name: str) -> list[str]:
    """<name> (key, bucket, n) and <name>_len (key, len): signed token counts per bucket."""
    digit = "instr('0123456789abcdef', substring(h, {}, 1)) - 1"
    return [f"""{name} AS (SELECT {key}, bucket, n FROM (
  SELECT {key}, ({digit.format(1)}) * 16 + {digit.format(2)} AS bucket,
         CAST(sum(CASE WHEN {digit.format(3)} < 8 THEN 1 ELSE -1 END) AS DOUBLE) AS n
  FROM (SELECT {key}, md5(unnest({words(text)})) AS h FROM {source}) GROUP BY {key}, bucket) WHERE n <> 0)""",
            f"{name}_len AS (SELECT {key}, sqrt(sum(n * n)) AS len FROM {name} GROUP BY {key})"]


def gaps(source: str, text: str) -> list[str]:
    """gaps_v (doc_id, pos, distance): to the next part, 0 for the last."""
    return [*hashed(source, "doc_id, pos", text, "vec"), f"""gaps_v AS (
  SELECT p.doc_id, p.pos, CASE WHEN p.pos = m.last THEN 0.0 ELSE round(1 - coalesce(d.dot / (a.len * b.len), 0), 9) END AS distance
  FROM {source} p JOIN (SELECT doc_id, max(pos) AS last FROM {source} GROUP BY doc_id) m ON p.doc_id = m.doc_id
  LEFT JOIN (SELECT a.doc_id, a.pos, sum(a.n * b.n) AS dot FROM vec a JOIN vec b
             ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 AND a.bucket = b.bucket GROUP BY a.doc_id, a.pos) d
    ON d.doc_id = p.doc_id AND d.pos = p.pos
  LEFT JOIN vec_len a ON a.doc_id = p.doc_id AND a.pos = p.pos
  LEFT JOIN vec_len b ON b.doc_id = p.doc_id AND b.pos = p.pos + 1)""",
            """limits_v AS (SELECT g.doc_id, quantile_cont(distance, 0.95) AS threshold FROM gaps_v g
  JOIN (SELECT doc_id, max(pos) AS last FROM gaps_v GROUP BY doc_id) m ON g.doc_id = m.doc_id AND g.pos < m.last GROUP BY g.doc_id)"""]


add("neighbour_cosine_distance", "SELECT doc_id, pos, round(distance, 6) AS distance FROM gaps_v",
    SENTENCES.replace("chunks_v", "said_v", 1), *gaps("said_v", "chunk"))

add("distance_percentile", "SELECT doc_id, round(threshold, 6) AS threshold FROM limits_v",
    *fitting(SEMANTIC_MAX), *gaps("parts_v", "part"), recursive=True)

SEGMENTS = [*fitting(SEMANTIC_MAX), *gaps("parts_v", "part"), f"""sized AS (
  SELECT p.doc_id, p.pos, p.part, {n_words('p.part')} AS n, g.distance AS before, coalesce(l.threshold, 0) AS threshold
  FROM parts_v p LEFT JOIN gaps_v g ON g.doc_id = p.doc_id AND g.pos = p.pos - 1
  LEFT JOIN limits_v l ON l.doc_id = p.doc_id)""",
    f"""walk AS (
  SELECT doc_id, pos, pos AS first, CAST(1 AS BIGINT) AS len, n AS total FROM sized WHERE pos = 0
  UNION ALL
  SELECT s.doc_id, s.pos,
         CASE WHEN w.total + s.n <= {SEMANTIC_MAX} AND NOT (w.len % 3 = 0 AND s.before > s.threshold) THEN w.first ELSE s.pos END,
         CASE WHEN w.total + s.n <= {SEMANTIC_MAX} AND NOT (w.len % 3 = 0 AND s.before > s.threshold) THEN w.len + 1 ELSE 1 END,
         CASE WHEN w.total + s.n <= {SEMANTIC_MAX} AND NOT (w.len % 3 = 0 AND s.before > s.threshold) THEN w.total + s.n ELSE s.n END
  FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.pos = w.pos + 1)"""]

add("segment_sentences", "SELECT doc_id, first + 1 AS first_sentence, max(len) AS n_sentences FROM walk GROUP BY doc_id, first",
    *SEGMENTS, recursive=True)

add("chunk_semantic", f"""SELECT md5(chunk) AS chunk_id, doc_id, chunk_pos, {n_words('chunk')} AS n_tokens FROM (
  SELECT w.doc_id, row_number() OVER (PARTITION BY w.doc_id ORDER BY w.first) - 1 AS chunk_pos,
         string_agg(z.part, ' ' ORDER BY z.pos) AS chunk
  FROM walk w JOIN sized z ON z.doc_id = w.doc_id AND z.pos = w.pos
  WHERE w.doc_id IN (SELECT doc_id FROM whole_v GROUP BY doc_id HAVING count(*) >= 3)
  GROUP BY w.doc_id, w.first
  UNION ALL
  SELECT doc_id, pos, chunk FROM whole_v WHERE doc_id IN (SELECT doc_id FROM whole_v GROUP BY doc_id HAVING count(*) < 3))""",
    *SEGMENTS, recursive=True)


# --- embedding and retrieval -----------------------------------------------

DOC_VEC = hashed("documents", "doc_id", "text", "dvec")
QUERY_VEC = hashed("benchmark", "item_id", "text", "qvec")

add("embed_hashing", "SELECT doc_id, CAST(bucket AS BIGINT) AS bucket, round(n / len, 6) AS weight FROM dvec JOIN dvec_len USING (doc_id)", *DOC_VEC)

add("embedding_normalize", """SELECT vec_id, dim, round(x / len, 5) AS value FROM (
  SELECT vec_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) * 2 AS x,
         sqrt(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * 2 * CAST(e AS DOUBLE) * 2))) AS len FROM embeddings)""")

add("embedding_report", """SELECT count(*) AS n_rows, count(*) FILTER (WHERE embedding IS NULL) AS n_null,
       CAST(min(len(embedding)) AS BIGINT) AS min_dim, CAST(max(len(embedding)) AS BIGINT) AS max_dim,
       count(*) FILTER (WHERE n = 0) AS n_zero, round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm, round(avg(n), 6) AS avg_norm
FROM (SELECT embedding, sqrt(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE)))) AS n FROM embeddings)""")


def topk(k: int, where: str = "TRUE") -> str:
    """hits_v (query_id, chunk_id, score, rank, label, query_label, doc_id) by brute force."""
    return f"""hits_v AS (SELECT * FROM (
  SELECT * REPLACE (round(score, 6) + 0.0 AS score), row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM (
    SELECT q.vec_id AS query_id, q.label AS query_label, i.vec_id AS chunk_id, i.label, i.vec_id // 4 AS doc_id,
           list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS score
    FROM embeddings q, embeddings i WHERE {where.replace('label', 'i.label')})) WHERE rank <= {k})"""


SHOWN = "SELECT query_id, chunk_id, score, rank FROM hits_v"
add("retrieve_topk", SHOWN, topk(5))
add("retrieve_ann_all_lists", SHOWN, topk(5))
add("retrieve_threshold", SHOWN + " WHERE score >= 0.4", topk(5))
add("retrieve_filtered", SHOWN, topk(5, "label IN (1, 3, 5)"))
add("retrieve_by_document", """SELECT query_id, CAST(doc_id AS BIGINT) AS doc_id, max(score) AS best_score, min(rank) AS first_rank, count(*) AS n_chunks,
       string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS chunk_ids FROM hits_v GROUP BY query_id, doc_id""", topk(10))


def ranked(name: str, scored: str, k: int, digits: int = 6) -> str:
    return f"""{name} AS (SELECT query_id, chunk_id, round(score, {digits}) + 0.0 AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM ({scored})) WHERE rank <= {k})"""


def semantic_hits(k: int, name: str = "sem") -> list[str]:
    # Every document with a direction competes, also at score 0.
    return [*DOC_VEC, *QUERY_VEC, ranked(name, """
    SELECT q.item_id AS query_id, d.doc_id AS chunk_id, coalesce(p.dot, 0) / (q.len * d.len) AS score
    FROM qvec_len q CROSS JOIN dvec_len d LEFT JOIN (
      SELECT a.item_id, b.doc_id, sum(a.n * b.n) AS dot FROM qvec a JOIN dvec b ON a.bucket = b.bucket GROUP BY a.item_id, b.doc_id) p
      ON p.item_id = q.item_id AND p.doc_id = d.doc_id""", k)]


TERMS = [
    f"qterm AS (SELECT DISTINCT item_id, unnest({words('lower(text)')}) AS term FROM benchmark)",
    f"dterm AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({words('lower(text)')}) AS term FROM documents) GROUP BY doc_id, term)",
    f"dlen AS (SELECT doc_id, {n_words('text')} AS dl FROM documents)",
    "corpus AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM dlen)",
    "dfreq AS (SELECT term, count(*) AS df FROM dterm GROUP BY term)"]

BM25 = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))"


def keyword_hits(k: int, weight: str = BM25, name: str = "kw") -> list[str]:
    """Weights are added in the order of their size: equal ones in any order would give sums that differ in their last bits."""
    return [*TERMS, ranked(name, f"""
    SELECT item_id AS query_id, doc_id AS chunk_id, sum({weight} ORDER BY {weight}) AS score
    FROM qterm JOIN dterm USING (term) JOIN dfreq USING (term) JOIN dlen USING (doc_id), corpus GROUP BY item_id, doc_id""", k)]


add("retrieve_bm25", "SELECT query_id, chunk_id, score, rank FROM kw", *keyword_hits(10))
add("retrieve_tfidf", "SELECT query_id, chunk_id, score, rank FROM kw", *keyword_hits(10, "tf * ln(n / df)"))

add("retrieve_documents", """SELECT query_id, rank, md5(doc_content) AS page_id, doc_uri, lang, source, score, 'Document' AS type
FROM sem JOIN docs_v ON doc_id = chunk_id""", DOCS, *semantic_hits(5))

add("retrieve_hybrid_rrf", "SELECT query_id, chunk_id, score, rank FROM fused", *semantic_hits(20), *keyword_hits(20),
    ranked("fused", """SELECT query_id, chunk_id, round(coalesce(1.0 / (60 + sem.rank), 0) + coalesce(1.0 / (60 + kw.rank), 0), 9) AS score
    FROM sem FULL OUTER JOIN kw USING (query_id, chunk_id)""", 10, 9))

OVERLAP = f"""round(len(list_intersect(list_distinct({words('lower(query)')}), list_distinct({words('lower(doc)')})))
          / len(list_distinct({words('lower(query)')})), 6)"""


def with_texts(hits: str) -> str:
    return f"""texts_v AS (SELECT h.*, b.text AS query, d.text AS doc FROM {hits} h
  JOIN benchmark b ON b.item_id = h.query_id JOIN documents d ON d.doc_id = h.chunk_id)"""


add("retrieve_hybrid_two_step", """SELECT query_id, chunk_id, keyword_score, combined_score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, keyword_score, round(0.5 * score + 0.5 * keyword_score, 9) AS combined_score FROM over_v))
WHERE rank <= 10""", *semantic_hits(50), with_texts("sem"),
    f"over_v AS (SELECT query_id, chunk_id, score, {OVERLAP} AS keyword_score FROM texts_v)")

add("rerank_overlap", """SELECT query_id, chunk_id, rerank_score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM over_v) WHERE rank <= 5""",
    *keyword_hits(20), with_texts("kw"), f"over_v AS (SELECT query_id, chunk_id, {OVERLAP} AS rerank_score FROM texts_v)")

add("rerank_recency", """SELECT query_id, chunk_id, score, place AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id DESC) AS place FROM kw) WHERE place <= 5""", *keyword_hits(20))

add("retrieve_expanded", """SELECT query_id, chunk_id, score, n_variants, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, max(round(score, 6) + 0.0) AS score, count(*) AS n_variants FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, pos ORDER BY round(score, 12) DESC, chunk_id) AS place FROM scored) WHERE place <= 5
    GROUP BY query_id, chunk_id)) WHERE rank <= 5""", *DOC_VEC,
    f"variants AS ({exploded('benchmark', 'item_id', sentences('text'), 'variant')})", *hashed("variants", "item_id, pos", "variant", "vvec"),
    """scored AS (SELECT q.item_id AS query_id, q.pos, d.doc_id AS chunk_id, coalesce(p.dot, 0) / (q.len * d.len) AS score
  FROM vvec_len q CROSS JOIN dvec_len d LEFT JOIN (
    SELECT a.item_id, a.pos, b.doc_id, sum(a.n * b.n) AS dot FROM vvec a JOIN dvec b ON a.bucket = b.bucket GROUP BY a.item_id, a.pos, b.doc_id) p
    ON p.item_id = q.item_id AND p.pos = q.pos AND p.doc_id = d.doc_id)""")


def listed(terms: list[str]) -> str:
    return "[" + ", ".join(map(s, terms)) + "]"


PLAIN = words("lower(regexp_replace({x}, '[.,;:!?()]', ' ', 'g'))")

add("extract_query_filters", f"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, {s(YEAR)}))), ',') AS years,
       array_to_string(list_sort(list_intersect({listed(VOCABULARY)}, {PLAIN.format(x='text')})), ',') AS terms FROM documents""")

add("classify_intent", f"""SELECT conv_id, turn, CASE WHEN hits > 0 THEN category ELSE 'other' END AS intent, hits AS n_hits FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY hits DESC, category) AS place FROM (
    SELECT conv_id, turn, category, CAST(len(list_filter(ws, lambda w: list_contains(terms, w))) AS BIGINT) AS hits
    FROM (SELECT conv_id, turn, {PLAIN.format(x='text')} AS ws FROM conversations),
         (VALUES {', '.join(f'({s(n)}, {listed(t)})' for n, t in INTENTS.items())}) t(category, terms))) WHERE place = 1""")

add("assemble_context", """SELECT query_id, md5(context) AS context_id, length(context) AS n_chars, n_chunks FROM (
  SELECT query_id, string_agg('Passage: ' || doc_content || chr(10) || 'Source: ' || doc_uri || chr(10), '' ORDER BY rank) AS context, count(*) AS n_chunks
  FROM sem JOIN docs_v ON doc_id = chunk_id GROUP BY query_id)""", DOCS, *semantic_hits(3))

SNAPSHOTS = [DOCS, """old_docs AS (SELECT doc_uri, doc_content AS t FROM docs_v d LEFT JOIN labels l USING (doc_id) WHERE coalesce(quality, 0) = 0)""",
             """new_docs AS (SELECT doc_uri, regexp_replace(doc_content, '[0-9]+', '#', 'g') AS t FROM docs_v d LEFT JOIN labels l USING (doc_id) WHERE coalesce(toxic, 0) = 0)""",
             f"old_v AS ({exploded('old_docs', 'doc_uri', paragraphs('t'), 'chunk')})",
             f"new_v AS ({exploded('new_docs', 'doc_uri', paragraphs('t'), 'chunk')})"]

add("index_sync_changes", """SELECT md5(doc_uri || '#' || CAST(pos AS VARCHAR)) AS chunk_id,
       CASE WHEN o.chunk IS NULL THEN 'insert' WHEN n.chunk IS NULL THEN 'delete' WHEN o.chunk <> n.chunk THEN 'update' ELSE 'same' END AS change
FROM old_v o FULL OUTER JOIN new_v n USING (doc_uri, pos)""", *SNAPSHOTS)

add("index_sync_apply", """SELECT md5(doc_uri || '#' || CAST(pos AS VARCHAR)) AS chunk_id, doc_uri, md5(n.chunk) AS text_id,
       CAST(CASE WHEN o.chunk = n.chunk THEN 0 ELSE 1 END AS BIGINT) AS origin
FROM new_v n LEFT JOIN old_v o USING (doc_uri, pos)""", *SNAPSHOTS)

add("index_coverage", f"""SELECT source, count(*) AS n_docs,
       count(*) FILTER (WHERE parser_status <> 'SUCCESS' OR doc_id NOT IN (SELECT doc_id FROM chunks_v WHERE {n_words('chunk')} >= 8)) AS n_missing
FROM docs_v GROUP BY source""", DOCS, PARAGRAPHS)


# --- conversations ---------------------------------------------------------

ENDS = """ends_v AS (SELECT conv_id, max(turn) AS last_turn, arg_max(content, turn) AS question, count(*) AS n FROM turns_v GROUP BY conv_id)"""
PAGE = "CAST(floor(turn / 1000) AS BIGINT)"
LINE = """CASE WHEN turn < last_turn THEN CASE WHEN role = 'user' THEN 'User: ' || content
          WHEN role = 'assistant' AND content <> '' THEN 'Assistant: ' || content END END"""
HISTORY = f"""history_v AS (SELECT conv_id, {PAGE} AS page, coalesce(string_agg({LINE}, chr(10) ORDER BY turn), '') AS history
  FROM turns_v JOIN ends_v USING (conv_id) GROUP BY conv_id, page)"""

add("conversation_messages", f"""SELECT conv_id, {PAGE} AS page, count(*) AS n_messages, string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS messages
FROM turns_v GROUP BY conv_id, page""", TURNS)
add("conversation_last_query", "SELECT conv_id, question FROM ends_v", TURNS, ENDS)
add("conversation_history", """SELECT conv_id, turn, role, content FROM turns_v
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 1""", TURNS)
add("conversation_history_messages", """SELECT conv_id, turn, role, content FROM (SELECT * FROM turns_v
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 1) WHERE role IN ('user', 'assistant')""", TURNS)
add("conversation_format_history", "SELECT conv_id, page, history FROM history_v", TURNS, ENDS, HISTORY)
add("conversation_rewrite_needed", "SELECT conv_id, count(*) > 1 AS needs_rewrite FROM turns_v GROUP BY conv_id", TURNS)

_HEAD, _REST = REWRITE.split("{history}")
_BETWEEN, _TAIL = _REST.split("{question}")
add("rewrite_prompt", f"""SELECT conv_id, page,
       (CASE WHEN page = min(page) OVER w THEN {s(_HEAD)} ELSE '' END) || history ||
       (CASE WHEN page = max(page) OVER w THEN {s(_BETWEEN)} || question || {s(_TAIL)} ELSE '' END) AS prompt
FROM history_v JOIN ends_v USING (conv_id) WHERE n > 1 WINDOW w AS (PARTITION BY conv_id)""", TURNS, ENDS, HISTORY)

add("condense_query", """SELECT conv_id, string_agg(content, ' ' ORDER BY turn) AS standalone_query, count(*) AS n_turns FROM (
  SELECT * FROM turns_v WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) GROUP BY conv_id""", TURNS)

add("build_prompt", f"""SELECT conv_id, CAST(-1 AS BIGINT) AS seq, 'system' AS role, {s(GROUNDED)} || coalesce(context, '') AS content
FROM ends_v LEFT JOIN (SELECT query_id AS conv_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context
                       FROM kw JOIN documents ON doc_id = chunk_id GROUP BY query_id) USING (conv_id)
UNION ALL SELECT conv_id, turn, role, content FROM turns_v JOIN ends_v USING (conv_id) WHERE turn < last_turn AND role IN ('user', 'assistant')
UNION ALL SELECT conv_id, turn, role, content FROM turns_v JOIN ends_v USING (conv_id) WHERE turn = last_turn""", TURNS, ENDS,
    f"""qterm AS (SELECT DISTINCT conv_id AS item_id, unnest({words('lower(q)')}) AS term FROM (
      SELECT conv_id, arg_max(content, turn) AS q FROM turns_v WHERE role = 'user' GROUP BY conv_id))""", *keyword_hits(3)[1:])

add("conversation_drop_system", "SELECT conv_id, turn, role, content FROM turns_v WHERE role <> 'system'", TURNS)

add("conversation_budget", f"""SELECT conv_id, turn, tokens, tokens_to_end, tokens_to_end <= 200 AS fits FROM (
  SELECT conv_id, turn, tokens, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tokens_to_end
  FROM (SELECT conv_id, turn, {n_words('content')} AS tokens FROM turns_v))""", TURNS)

ANSWERS = "answers_v AS (SELECT conv_id, turn, content FROM turns_v WHERE role = 'assistant')"
add("response_format", "SELECT conv_id, turn, " + ", ".join(
    f"regexp_matches(content, {s(p)}) AS {n}" for n, p in FORMATS.items()) + " FROM answers_v", TURNS, ANSWERS)

add("response_filter", f"""SELECT conv_id, turn, blocked_terms, blocked_terms <> '' AS blocked FROM (
  SELECT conv_id, turn, array_to_string(list_sort(list_intersect({listed(BLOCKED)}, {PLAIN.format(x='content')})), ',') AS blocked_terms FROM answers_v)""",
    TURNS, ANSWERS)

REQUESTS = """requests_v AS (
  SELECT conv_id || ':' || turn AS request_id, text AS request,
         CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS response
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY role = 'user')"""

TRACE = [REQUESTS, f"qterm AS (SELECT DISTINCT request_id AS item_id, unnest({words('lower(request)')}) AS term FROM requests_v)",
         *keyword_hits(5)[1:],
         """trace_v AS (SELECT query_id AS request_id, CAST(rank - 1 AS BIGINT) AS pos, source || '/' || doc_id AS doc_uri, text AS content
  FROM kw JOIN documents ON doc_id = chunk_id)"""]

SUPPORT = [TURNS, ANSWERS, *TRACE, """context_v AS (SELECT request_id, string_agg(content, chr(10) || chr(10) ORDER BY pos) AS context FROM trace_v GROUP BY request_id)""",
           f"""support_v AS (
  SELECT conv_id, turn, content, round(coalesce(len(list_intersect(ws, cs)) / nullif(len(ws), 0), 0.0), 6) AS support FROM (
    SELECT a.conv_id, a.turn, a.content, list_distinct({PLAIN.format(x='a.content')}) AS ws,
           list_distinct({PLAIN.format(x="coalesce(b.context, '')")}) AS cs
    FROM answers_v a LEFT JOIN context_v b ON b.request_id = a.conv_id || ':' || (a.turn - 1)))"""]
add("response_support", "SELECT conv_id, turn, support FROM support_v", *SUPPORT)
add("response_fallback", f"""SELECT conv_id, turn, reason AS fallback_reason, CASE WHEN reason IS NULL THEN content ELSE {s(SORRY)} END AS final_response FROM (
  SELECT *, CASE WHEN content = '' THEN 'empty' WHEN support < 0.05 THEN 'unsupported' END AS reason FROM support_v)""", *SUPPORT)


# --- feedback --------------------------------------------------------------

LOG = """log_v AS (
  SELECT event_id, user_id || ':' || CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) // 20 AS request_id, ts, 'rev' || CAST(event_id % 3 AS VARCHAR) AS source_id,
         CASE WHEN event_id % 2 = 0 THEN 'step_a' ELSE 'step_b' END AS step_id,
         CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'error' THEN 'negative' WHEN 'click' THEN 'idk' END AS answer_rating,
         CASE WHEN event_type IN ('purchase', 'error', 'click') THEN
              CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 4 WHEN 0 THEN '' WHEN 1 THEN 'edit ' || CAST(event_id AS VARCHAR) END
         END AS suggested_output,
         CASE WHEN event_type IN ('view', 'signup') THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 5 END AS position,
         CASE event_type WHEN 'view' THEN 'true' WHEN 'signup' THEN 'false' END AS chunk_rating
  FROM events)"""

TEXT = """text_v AS (SELECT * FROM log_v WHERE answer_rating IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY request_id, source_id ORDER BY ts DESC, event_id DESC) = 1)"""
CHUNK = """chunk_v AS (SELECT * FROM log_v WHERE chunk_rating IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY request_id, source_id, position, step_id ORDER BY ts DESC, event_id DESC) = 1)"""
NEST = """nest_v AS (SELECT request_id, source_id, step_id, max(ts) AS ts,
         string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS positions,
         string_agg(chunk_rating, ',' ORDER BY position) AS ratings,
         list(position) FILTER (WHERE chunk_rating = 'true') AS good_positions
  FROM chunk_v GROUP BY request_id, source_id, step_id)"""
MERGED = """merged_v AS (SELECT request_id, source_id, coalesce(t.step_id, n.step_id) AS step_id, coalesce(t.ts, n.ts) AS ts,
         t.answer_rating, t.suggested_output, n.ratings, n.good_positions
  FROM text_v t FULL OUTER JOIN nest_v n USING (request_id, source_id))"""
ATTACHED = """attached_v AS (SELECT r.*, m.answer_rating AS is_correct, nullif(m.suggested_output, '') AS suggested_output,
         m.source_id AS source_user, m.step_id, m.ratings, m.good_positions
  FROM requests_v r LEFT JOIN merged_v m ON m.request_id = r.request_id)"""
LABELLED = """labelled_v AS (SELECT *,
         CASE is_correct WHEN 'positive' THEN 'thumbs_up' WHEN 'negative' THEN 'thumbs_down_edited' ELSE 'no_feedback_provided' END AS source_tag,
         CASE is_correct WHEN 'positive' THEN coalesce(suggested_output, response) WHEN 'negative' THEN suggested_output END AS expected_response,
         suggested_output IS NOT NULL AS has_edit FROM attached_v)"""
CONTEXT = """context_v AS (SELECT l.*, (
    SELECT string_agg(doc_uri || '=' || content, ',' ORDER BY pos) FROM trace_v t
    WHERE t.request_id = l.request_id AND list_contains(good_positions, pos)) AS expected_context FROM labelled_v l)"""
CHAIN = [REQUESTS, LOG, TEXT, CHUNK, NEST, MERGED, ATTACHED, LABELLED]
FULL = [*TRACE, *CHAIN[1:], CONTEXT]

add("feedback_latest_text", "SELECT event_id, request_id, source_id, step_id, answer_rating, suggested_output FROM text_v", LOG, TEXT)
add("feedback_latest_retrieval", "SELECT event_id, request_id, source_id, step_id, position, chunk_rating FROM chunk_v", LOG, CHUNK)
add("feedback_nest_retrieval", "SELECT request_id, source_id, step_id, epoch_us(ts) AS ts_micros, positions, ratings FROM nest_v", LOG, CHUNK, NEST)
add("feedback_merge", "SELECT request_id, source_id, step_id, epoch_us(ts) AS ts_micros, answer_rating, ratings FROM merged_v", *CHAIN[1:6])
add("feedback_attach", "SELECT request_id, is_correct, suggested_output, source_user, step_id, ratings FROM attached_v", *CHAIN[:7])
add("evalset_label", "SELECT request_id, source_user, step_id, source_tag, expected_response, has_edit FROM labelled_v", *CHAIN[:8])
add("evalset_union", ORACLES["evalset_label"])
add("evalset_chunk_relevance", "SELECT request_id, source_user, step_id, ratings AS chunk_relevance FROM attached_v WHERE ratings IS NOT NULL", *CHAIN[:7])
add("trace_retrieved_chunks", "SELECT request_id, pos, doc_uri, content FROM trace_v", *TRACE)
add("evalset_expected_context", "SELECT request_id, source_user, step_id, expected_context FROM context_v WHERE expected_context IS NOT NULL", *FULL)
add("evaluation_set", """SELECT request_id, request, response, expected_response, expected_context AS expected_retrieved_context,
       source_user, step_id, source_tag, has_edit FROM context_v""", *FULL)
add("evaluation_set_one_row", """SELECT request_id, source_user, step_id, source_tag FROM context_v
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY CASE source_tag WHEN 'thumbs_up' THEN 0 WHEN 'thumbs_down_edited' THEN 1 ELSE 2 END,
  coalesce(source_user, ''), coalesce(step_id, '')) = 1""", *FULL)
_HEX = "instr('0123456789abcdef', substring(md5(CAST(request_id AS VARCHAR)), {}, 1)) - 1"
add("evalset_split", f"""SELECT request_id, source_user, step_id, CASE WHEN b < 179 THEN 'train' WHEN b < 230 THEN 'test' ELSE 'validation' END AS split
FROM (SELECT *, ({_HEX.format(1)}) * 16 + {_HEX.format(2)} AS b FROM context_v)""", *FULL)
add("evalset_report", """SELECT source_tag, count(*) AS n_rows, count(DISTINCT request_id) AS n_requests, count(expected_response) AS n_expected,
       count(*) >= 30 AS enough FROM labelled_v GROUP BY source_tag""", *CHAIN[:8])
add("feedback_agreement", """SELECT request_id, count(*) AS n_reviewers, count(*) FILTER (WHERE answer_rating = 'positive') AS n_positive,
       count(*) FILTER (WHERE answer_rating = 'negative') AS n_negative, count(DISTINCT answer_rating) = 1 AS unanimous
FROM text_v GROUP BY request_id""", LOG, TEXT)


# --- evaluation ------------------------------------------------------------

add("metric_precision", """SELECT e.vec_id AS query_id, count(h.chunk_id) AS n_retrieved, count(h.chunk_id) FILTER (WHERE h.label = e.label) AS n_relevant,
       round(coalesce(avg(CASE WHEN h.chunk_id IS NULL THEN NULL WHEN h.label = e.label THEN 1.0 ELSE 0.0 END), 0.0), 6) AS precision
FROM embeddings e LEFT JOIN hits_v h ON h.query_id = e.vec_id GROUP BY e.vec_id""", topk(5))

add("metric_document_recall", """SELECT query_id, n_found, n_truth, round(n_found / n_truth, 6) AS recall FROM (
  SELECT h.query_id, count(DISTINCT CASE WHEN t.doc_id IS NOT NULL THEN h.doc_id END) AS n_found, any_value(z.n_truth) AS n_truth
  FROM hits_v h JOIN (SELECT label, count(DISTINCT doc_id) AS n_truth FROM truth GROUP BY label) z ON z.label = h.query_label
  LEFT JOIN truth t ON t.label = h.query_label AND t.doc_id = h.doc_id GROUP BY h.query_id)""",
    topk(10), "truth AS (SELECT DISTINCT label, vec_id // 4 AS doc_id FROM embeddings)")

add("metric_at_k", """SELECT query_id, k, round(r / k, 6) AS precision_at_k, round(r / n_truth, 6) AS recall_at_k FROM (
  SELECT e.vec_id AS query_id, k, e.label, count(h.chunk_id) FILTER (WHERE h.label = e.label AND rank <= k) AS r
  FROM embeddings e CROSS JOIN (SELECT CAST(unnest([1, 3, 5, 10]) AS INTEGER) AS k) LEFT JOIN hits_v h ON h.query_id = e.vec_id GROUP BY ALL)
JOIN (SELECT label, count(*) AS n_truth FROM embeddings GROUP BY label) USING (label)""", topk(10))

add("metric_ndcg", """SELECT e.vec_id AS query_id, round(coalesce(d.dcg, 0) / i.ideal, 6) AS ndcg
FROM embeddings e
JOIN (SELECT label, count(*) AS n_truth FROM embeddings GROUP BY label) z USING (label)
JOIN (SELECT n, sum(1 / log2(n2 + 1)) AS ideal FROM range(1, 11) a(n), range(1, 11) b(n2) WHERE n2 <= n GROUP BY n) i ON i.n = least(z.n_truth, 10)
LEFT JOIN (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg FROM hits_v WHERE label = query_label GROUP BY query_id) d ON d.query_id = e.vec_id""", topk(10))

SUMMARY = """summary_v AS (SELECT experiment, count(*) AS n_rows,
         round(avg(CASE WHEN correctness = 'yes' THEN 1.0 ELSE 0.0 END) * 100, 6) AS correct_percentage,
         round(avg(total_token_count), 6) AS avg_token_count, round(avg(latency_seconds), 6) AS avg_latency_seconds
  FROM runs_v GROUP BY experiment)"""
LONG = """long_v AS (SELECT experiment, 'correct_percentage' AS metric, correct_percentage AS value, -correct_percentage AS signed FROM summary_v
  UNION ALL SELECT experiment, 'avg_token_count', avg_token_count, avg_token_count FROM summary_v
  UNION ALL SELECT experiment, 'avg_latency_seconds', avg_latency_seconds, avg_latency_seconds FROM summary_v)"""
WINNERS = """winners_v AS (SELECT metric, experiment AS winner, value AS best_value FROM long_v
  QUALIFY row_number() OVER (PARTITION BY metric ORDER BY signed, CASE WHEN experiment = 'poc' THEN 0 ELSE 1 END, experiment) = 1)"""

add("metric_summary", "SELECT * FROM summary_v", RUNS, SUMMARY)
add("metric_token_counts", f"""SELECT conv_id, CAST(sum(CASE WHEN role <> 'assistant' THEN n ELSE 0 END) AS BIGINT) AS input_tokens,
       CAST(sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) AS BIGINT) AS output_tokens, CAST(sum(n) AS BIGINT) AS total_tokens
FROM (SELECT conv_id, role, {n_words('content')} AS n FROM turns_v) GROUP BY conv_id""", TURNS)
add("metric_latency", """SELECT experiment, round(avg(latency_seconds), 6) AS avg_latency, round(quantile_cont(latency_seconds, 0.5), 6) AS p50,
       round(quantile_cont(latency_seconds, 0.95), 6) AS p95, round(quantile_cont(latency_seconds, 0.99), 6) AS p99
FROM runs_v GROUP BY experiment""", RUNS)


def causes(truth: bool) -> str:
    names = ["low", "groundedness", *(["correctness"] if truth else []), "relevance_to_query"]
    rules = RULES_WITH_TRUTH if truth else RULES_WITHOUT_TRUTH
    rows = values([(str(r[0]).upper(), *r[1:]) for r in rules]).replace("'TRUE'", "TRUE").replace("'FALSE'", "FALSE")
    on = " AND ".join(f"(r.{n} IS NULL OR r.{n} = j.{n})" for n in names[1:])
    return f"""diagnosed_v AS (SELECT j.*, r.root_cause, r.assessment, r.rationale FROM judge_v j
  LEFT JOIN (VALUES {rows}) r({', '.join(names)}, root_cause, assessment, rationale)
  ON r.low = (j.chunk_relevance_precision < 0.5) AND {on})"""


CAUSE = "SELECT request_id, root_cause, assessment, rationale FROM diagnosed_v"
add("root_cause_truth", CAUSE, JUDGE, causes(True))
add("root_cause_no_truth", CAUSE, JUDGE, causes(False))
add("root_cause_frequency", " UNION ALL ".join(f"""SELECT {c} AS value, count(*) AS n,
       round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent, '{kind}' AS kind FROM diagnosed_v GROUP BY {c}"""
                                               for c, kind in (("root_cause", "cause"), ("rationale", "rationale"))), JUDGE, causes(False))
add("drilldown_retrieval", """SELECT request_id, chunk_relevance_precision, groundedness, relevance_to_query, assessment, rationale
FROM diagnosed_v WHERE root_cause = 'Improve Retrieval'""", JUDGE, causes(False))
add("drilldown_suspects", """SELECT * FROM (SELECT request_id, chunk_relevance_precision, groundedness, correctness,
       CASE WHEN correctness = 'no' AND chunk_relevance_precision < 0.5 THEN 'wrong_low_precision'
            WHEN groundedness = 'no' AND chunk_relevance_precision >= 0.5 THEN 'ungrounded_high_precision' END AS reason FROM judge_v)
WHERE reason IS NOT NULL""", JUDGE)
add("metric_winners", "SELECT metric, winner, best_value FROM winners_v", RUNS, SUMMARY, LONG, WINNERS)
add("overall_winner", """SELECT experiment AS winner, wins FROM (
  SELECT experiment, (SELECT count(*) FROM winners_v WHERE winner = experiment) AS wins FROM summary_v)
ORDER BY wins DESC, CASE WHEN experiment = 'poc' THEN 0 ELSE 1 END, experiment LIMIT 1""", RUNS, SUMMARY, LONG, WINNERS)
add("relative_change", """SELECT a.experiment, a.metric, round((a.value - b.value) / b.value, 6) AS change,
       round((a.value - b.value) / b.value * 100, 2) AS change_percent
FROM long_v a JOIN long_v b ON b.metric = a.metric AND b.experiment = 'poc'
WHERE a.experiment <> 'poc' AND a.metric <> 'correct_percentage'""", RUNS, SUMMARY, LONG)
add("monitor_tumbling", """SELECT start_micros, experiment, n_rows, n_errors, correct_percent, avg_latency, correct_percent < 80 AS alert FROM (
  SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, event_ts)) AS start_micros, experiment, count(*) AS n_rows,
         count(*) FILTER (WHERE correctness <> 'yes') AS n_errors,
         round(avg(CASE WHEN correctness = 'yes' THEN 100.0 ELSE 0.0 END), 4) AS correct_percent, round(avg(latency_seconds), 9) AS avg_latency
  FROM runs_v GROUP BY 1, 2)""", RUNS)


# --- settings --------------------------------------------------------------

SETTINGS = [
    f"sources_v AS (SELECT source, max({n_words('text')}) AS longest, count(*) AS n FROM documents GROUP BY source)",
    """base_v AS (SELECT source AS strategy, key_path, val FROM sources_v,
  (VALUES ('parser/name', 'html'), ('chunker/name', 'window'), ('chunker/size', '1500'), ('chunker/overlap', '250')) t(key_path, val))""",
    """over_v AS (SELECT source AS strategy, 'chunker/size' AS key_path, '512' AS val FROM sources_v WHERE longest > 600
  UNION ALL SELECT source, 'embedding/name', 'gte-large' FROM sources_v WHERE longest > 600
  UNION ALL SELECT source, 'corpus/documents', CAST(n AS VARCHAR) FROM sources_v WHERE longest > 600)""",
    """merged_v AS (SELECT strategy, key_path, val FROM over_v
  UNION ALL SELECT strategy, key_path, val FROM base_v WHERE (strategy, key_path) NOT IN (SELECT (strategy, key_path) FROM over_v))"""]
add("config_merge", "SELECT strategy, key_path, val FROM merged_v", *SETTINGS)
add("config_diff", """SELECT strategy, key_path, b.val AS left_val, m.val AS right_val FROM base_v b FULL OUTER JOIN merged_v m USING (strategy, key_path)
WHERE b.val IS DISTINCT FROM m.val""", *SETTINGS)
add("strategy_grid", """SELECT concat_ws('__', parser, chunker, encoder) AS strategy, parser, chunker, encoder, n_files, total_length FROM (
  SELECT substring(ext, 2) AS parser, count(*) AS n_files, CAST(sum(length) AS BIGINT) AS total_length FROM raw_v GROUP BY ext),
  (VALUES ('window'), ('recursive'), ('semantic')) c(chunker), (VALUES ('gte-large'), ('bge-large')) e(encoder)""", RAW)
