"""HTML to Markdown as a chain of built-in regular-expression replacements.

Every pattern avoids look-around and back-references, so the same text is
obtained from any linear-time regular-expression engine. Preformatted blocks,
numbered lists and numeric entities need more than replacements; pages that
have some take a second way over arrays of their pieces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import collapse_blank_lines, let, strip

# An attribute's value in either kind of quotes: two groups, one of them empty.
_QUOTED = r"""(?:"([^"]*)"|'([^']*)')"""

# (pattern, replacement), applied in this order; groups are written $1, $2.
HIDDEN_STEPS: list[tuple[str, str]] = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script.*?</script>", ""),
    (r"(?is)<style.*?</style>", ""),
    (r"(?is)<head[ >].*?</head>", ""),
]
VISIBLE_STEPS: list[tuple[str, str]] = [
    *[(rf"(?is)<h{n}(?: [^>]*)?>(.*?)</h{n}>", "\n\n" + "#" * n + " $1\n\n") for n in range(1, 7)],
    (rf"(?is)<img[ \t\r\n](?:[^>]*[ \t\r\n])?alt={_QUOTED}[^>]*[ \t\r\n]src={_QUOTED}[^>]*>", "![$1$2]($3$4)"),
    (rf"(?is)<img[ \t\r\n](?:[^>]*[ \t\r\n])?src={_QUOTED}[^>]*[ \t\r\n]alt={_QUOTED}[^>]*>", "![$3$4]($1$2)"),
    (rf"(?is)<img[ \t\r\n](?:[^>]*[ \t\r\n])?src={_QUOTED}[^>]*>", "![]($1$2)"),
    (rf"(?is)<a[ \t\r\n](?:[^>]*[ \t\r\n])?href={_QUOTED}[^>]*>(.*?)</a>", "[$3]($1$2)"),
    (r"(?i)</?code(?: [^>]*)?>", "`"),
    (r"(?i)<li(?: [^>]*)?>", "\n* "),
    (r"(?i)</li>", ""),
    (r"(?i)</?(?:b|strong)(?: [^>]*)?>", "**"),
    (r"(?i)</?(?:em|i)(?: [^>]*)?>", "*"),
    (r"(?i)<t[dh](?: [^>]*)?>", "| "),
    (r"(?i)</t[dh]>", " "),
    (r"(?i)</tr>", "|\n"),
    (r"(?i)<br ?/?>", "\n"),
    (r"(?i)</?(?:p|div|article|section|nav|ul|ol|table|header|footer|main|blockquote)(?: [^>]*)?>", "\n\n"),
    (r"<[^>]+>", ""),
    (r"[ \t]+\n", "\n"),
    (r"\n[ \t]+", "\n"),
]
HTML_STEPS = HIDDEN_STEPS + VISIBLE_STEPS

# The entities decoded by name, `&amp;` last so that a doubly
# escaped entity is decoded once only.
ENTITIES: list[tuple[str, str]] = [
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]


_PRE = r"(?i)</?pre(?: [^>]*)?>"
_LIST = r"(?i)<ol(?: [^>]*)?>"
_ITEM = r"(?i)<li(?: [^>]*)?>"


def _replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, step: F.regexp_replace(c, step[0], step[1]), steps, text)


def _decoded_piece(piece: Column) -> Column:
    """What follows an ampersand, with the entity at its start decoded; unknown ones and invalid numbers stay."""
    name = F.regexp_extract(piece, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]+);", 1)

    def of(found: Column) -> Column:
        number = F.when(found.rlike("^#[0-9]"), F.substr(found, F.lit(2))).when(
            found.startswith("#"), F.conv(F.substr(found, F.lit(3)), 16, 10)).cast("int")
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        for entity, named in ENTITIES:
            if not entity.startswith("&#"):
                char = F.when(found == entity[1:-1], F.lit(named)).otherwise(char)
        return F.coalesce(F.concat(char, F.substr(piece, F.length(found) + 2)), F.concat(F.lit("&"), piece))

    return let(name, of)


def decode_entities(text: Column) -> Column:
    """Each entity decoded once: the listed names, and any decimal or hexadecimal code point."""
    named = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)
    pieces = let(F.split(text, "&"), lambda p: F.array_join(F.transform(
        p, lambda x, i: F.when(i == 0, x).otherwise(_decoded_piece(x))), ""))
    return F.when(text.rlike("&#[0-9xX]"), pieces).otherwise(named)


def number_lists(html: Column) -> Column:
    """Items of ordered lists as ``1.``, ``2.``; a list that holds another list keeps its item tags."""
    def numbered(part: Column) -> Column:
        ends = F.split(part, "(?i)</ol>", 2)
        items = F.array_join(F.transform(F.split(F.get(ends, F.lit(0)), _ITEM), lambda x, i: F.when(i == 0, x).otherwise(
            F.concat(F.lit("\n"), i.cast("string"), F.lit(". "), x))), "")
        flat = (F.size(ends) == 2) & ~F.get(ends, F.lit(0)).rlike("(?i)<ul[ >]")
        return F.concat(F.lit("<ol>"), F.when(flat, F.concat(items, F.lit("</ol>"), F.get(ends, F.lit(1)))).otherwise(part))

    listed = F.array_join(F.transform(F.split(html, _LIST), lambda p, i: F.when(i == 0, p).otherwise(numbered(p))), "")
    return F.when(html.rlike(_LIST), listed).otherwise(html)


def _prose(html: Column) -> Column:
    return strip(collapse_blank_lines(decode_entities(_replaced(number_lists(html), VISIBLE_STEPS))))


def _preformatted(html: Column) -> Column:
    """A fenced block; its lines keep their indentation."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?i)<br ?/?>", "\n"), r"<[^>]+>", "")
    return F.concat(F.lit("```\n"), F.btrim(decode_entities(text), F.lit("\r\n")), F.lit("\n```"))


def html_to_markdown(html: Column) -> Column:
    """ATX headings, ``*`` and numbered lists, bold, links, images, code and fenced blocks; scripts and styles dropped.

    A ``pre`` that is not closed reaches to the end of the page.
    """
    shown = _replaced(html, HIDDEN_STEPS)
    blocks = let(F.split(shown, _PRE), lambda parts: F.array_join(F.filter(F.transform(
        parts, lambda p, i: F.when(i % 2 == 1, _preformatted(p)).otherwise(_prose(p))), lambda p: p != ""), "\n\n"))
    return F.when(html.rlike(_PRE), blocks).otherwise(_prose(shown))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


def html_language(html: Column) -> Column:
    return F.regexp_extract(html, r'(?i)<html[^>]* lang="([A-Za-z-]+)"', 1)
