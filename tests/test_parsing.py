import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import markup
from docloom.functions import text as tx
from docloom.operators import cleaning, parsing
from tests.conftest import rows


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("html, expected", [
    ("<h1>Title</h1><p>Some <b>bold</b> and <em>soft</em> text.</p>", "# Title\n\nSome **bold** and *soft* text."),
    ("<ul><li>one</li><li>two</li></ul>", "* one\n* two"),
    ('<p>See <a class="x" href="/u?a=1">the page</a>.</p>', "See [the page](/u?a=1)."),
    ("<head><title>T</title></head><body><!-- ad --><script>var t='</p>';</script><style>p{}</style><p>x</p>", "x"),
    ("<p>a<br>b<br/>c", "a\nb\nc"),
    ("<h3 id='q'>Deep</h3>text", "### Deep\n\ntext"),
    ("<p>1 &lt; 2 &amp;&amp; 3 &amp;lt; 4 &copy;</p>", "1 < 2 && 3 &lt; 4 ©"),
    ("<header>top</header><table><tr><th>a</th><td>b</td></tr></table>", "top\n\n| a | b |"),
    ("", ""),
    ("<ol><li>one</li><li>two</li></ol><ul><li>x</li></ul><ol start='3'><li>a</li></ol>", "1. one\n2. two\n\n* x\n\n1. a"),
    ("<ol><li>a<ul><li>b</li></ul></li></ol>", "* a\n\n* b"),
    ("<p>See <a class='x' href='/u'>it</a> and <a data-href='no' href=\"/v\">that</a></p>", "See [it](/u) and [that](/v)"),
    ("<p><img src='/a.png' alt=\"A b\"><img alt='c' src='/d.png'/> <img src=\"/e.png\"></p>", "![A b](/a.png)![c](/d.png) ![](/e.png)"),
    ("<p>Use <code>x &lt; y</code>:</p><pre><code>if x:\n    y = 1\n\n\n\n    z</code></pre><p>end</p>",
     "Use `x < y`:\n\n```\nif x:\n    y = 1\n\n\n\n    z\n```\n\nend"),
    ("<p>&#8364;&#x41;&#X1F600; &#38;lt; &amp;#65; &#xD800; &#0; &bogus; a & b &copy;</p>", "€A😀 &lt; &#65; &#xD800; &#0; &bogus; a & b ©"),
    ("<p>a</p><pre>  open\n  <b>x</b>", "a\n\n```\n  open\n  x\n```"),
])
def test_html_to_markdown(spark, html, expected):
    assert one(spark, html, markup.html_to_markdown) == expected


def test_collapse_blank_lines(spark):
    assert one(spark, "a\n\n\n\nb\n\nc\nd", tx.collapse_blank_lines) == "a\n\nb\n\nc\nd"


@pytest.mark.parametrize("path, expected", [
    ("store:/volumes/c/s/file.pdf", "volumes/c/s/file.pdf"),
    ("file:///tmp/a b.html", "tmp/a b.html"),
    ("https://host.example.com/en/25?x=1#top", "en/25"),
    ("/plain/path", "plain/path"),
    ("relative/x:y", "relative/x:y"),
])
def test_doc_uri(spark, path, expected):
    assert one(spark, path, tx.doc_uri) == expected


def test_parse_by_extension_and_bad_bytes(spark):
    df = spark.createDataFrame([
        (1, b"<h1>A</h1>", ".html"), (2, b"plain", ".txt"), (3, b"\xff\xfe\xfa", ".html"), (4, b"x", ".docx")],
        "id int, content binary, ext string")
    got = parsing.parse_by_extension(df).select("id", "parsing.output", "parsing.status")
    assert rows(got) == [(1, "# A", "SUCCESS"), (2, "plain", "SUCCESS"), (3, None, "ERROR: not valid UTF-8"),
                         (4, None, "ERROR: unsupported format .docx")]


def test_registered_parser(spark):
    parsing.register_parser("upper", lambda c: F.struct(F.upper(c.cast("string")).alias("output"), F.lit("SUCCESS").alias("status")), (".up",))
    df = spark.createDataFrame([(b"abc", ".up")], "content binary, ext string")
    assert parsing.parse_by_extension(df).first().parsing.output == "ABC"
    assert parsing.apply_parser(df, "upper").first().parsing.output == "ABC"
    with pytest.raises(ValueError):
        parsing.apply_parser(df, "nothing")


def test_python_parser_failure_stays_in_its_row(spark):
    def parse(raw):
        if raw == b"bad":
            raise RuntimeError("broken file")
        return raw.decode()[::-1]

    df = spark.createDataFrame([(1, b"abc"), (2, b"bad")], "id int, content binary")
    got = parsing.apply_python_parser(df, parse).select("id", "parsing.output", "parsing.status")
    assert rows(got) == [(1, "cba", "SUCCESS"), (2, None, "ERROR: broken file")]


def test_parse_json_doc(spark):
    df = spark.createDataFrame([
        (1, b'{"body": "text", "url": "u"}'), (2, b'{"url": "u"}'), (3, b"not json"), (4, b"\xff\xfe"), (5, b'{"body": "only"}')],
        "id int, content binary")
    got = parsing.parse_json_doc(df, "content", "body")
    assert rows(got, "id", "parser_status") == [
        (1, "SUCCESS"), (2, "ERROR: no key body"), (3, "ERROR: not a JSON object"), (4, "ERROR: not valid UTF-8"), (5, "SUCCESS")]
    maps = {r.id: r.doc_parsed_contents for r in got.collect()}
    assert maps[1] == {"parsed_content": "text", "url": "u"}
    assert maps[2] is None


def test_pages_and_elements(spark):
    pages = spark.createDataFrame([([(1, "b"), (0, "a")],)], "p array<struct<page_number int, parsed_content string>>")
    assert pages.select(parsing.pages_to_text(F.col("p")).alias("m")).first().m == {"parsed_content": "a\nb", "num_pages": "2"}
    elements = spark.createDataFrame(
        [([("Title", "Head", None), ("Text", "body", None), ("Table", "x y", "<tr><td>x</td><td>y</td></tr>"), ("Table", "raw", None), ("Text", "end", None)],)],
        "e array<struct<category string, text string, text_as_html string>>")
    assert elements.select(parsing.elements_to_text(F.col("e")).alias("t")).first().t == "Head body\n| x | y |\n\nraw\n end"


def test_report_and_its_errors(spark):
    schema = "doc_content string, parser_status string"
    mixed = spark.createDataFrame([("a", "SUCCESS"), (" ", "SUCCESS"), (None, "ERROR: x"), (None, None)], schema)
    assert parsing.check_parsed(mixed) == {"total": 4, "failed": 2, "empty": 1}
    with pytest.raises(ValueError, match="failed"):
        parsing.check_parsed(spark.createDataFrame([(None, "ERROR")], schema))
    with pytest.raises(ValueError, match="empty"):
        parsing.check_parsed(spark.createDataFrame([("", "SUCCESS"), (None, "ERROR")], schema))


def test_split_is_complete(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["SUCCESS", "ERROR", None, "SUCCESS"])], "id int, s string")
    good, bad = parsing.split_status(df, F.col("s"))
    assert rows(good, "id") == [(0,), (3,)] and rows(bad, "id") == [(1,), (2,)]


def test_select_parsed_flattens(spark):
    df = spark.createDataFrame([("u", ("text", "SUCCESS")), ("v", (None, "ERROR"))], "doc_uri string, parsing struct<output string, status string>")
    schema = T.StructType([T.StructField("doc_uri", T.StringType()), T.StructField("output", T.StringType())])
    assert rows(parsing.select_parsed(df, schema)) == [("u", "text")]


def test_schema_of():
    class Base:
        doc_content: str
        n: int
        score: float

    class More:
        ok: bool
        at: datetime.datetime
        day: datetime.date
        names: list
        grid: list[list[int]]

    schema = parsing.schema_of(Base, More)
    assert schema.simpleString() == ("struct<doc_content:string,n:int,score:double,ok:boolean,at:timestamp,day:date,"
                                     "names:array<string>,grid:array<array<int>>>")
    assert all(f.nullable for f in schema.fields)

    class Bad:
        m: dict

    with pytest.raises(TypeError):
        parsing.schema_of(Bad)


def test_strip_boilerplate_keeps_order_and_whole_documents(spark):
    df = spark.createDataFrame([
        (1, "foot\na\nb\nfoot"), (2, "c\nfoot"), (3, "foot"), (4, "untouched\na"), (5, None), (6, "")], "id int, text string")
    got = cleaning.strip_boilerplate(df, "id", "text", 3)
    assert rows(got) == [(1, "a\nb", 2), (2, "c", 1), (3, "", 1), (4, "untouched\na", 0), (5, None, 0), (6, "", 0)]


def test_json_keys_that_clash(spark):
    df = spark.createDataFrame([
        (1, '{"text": "t", "parsed_content": "old", "a": 1}'), (2, '{"a": 1, "text": "t", "a": 2}'),
        (3, '{"parsed_content": "old"}')], "id int, raw string")
    got = {r.id: (r.doc_parsed_contents, r.parser_status) for r in parsing.parse_json_doc(df, "raw", "text").collect()}
    assert got[1] == ({"parsed_content": "t", "a": "1"}, "SUCCESS")
    assert got[2] == ({"parsed_content": "t", "a": "1"}, "SUCCESS")
    assert got[3] == (None, "ERROR: no key text")


def test_collapse_repeats(spark):
    df = spark.createDataFrame([("a\nb\na\n\nb",)], "text string")
    assert cleaning.collapse_repeats(df, "text").first().clean_text == "a\nb\n"
