"""Column functions over text: tokens, sentences, paragraphs, paths and ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the six ASCII white-space characters. Spelled out because `\s`
# covers a different set in each regular-expression engine.
WHITESPACE = " \t\n\x0b\f\r"
_GAP = r"[ \t\n\x0B\f\r]+"
_WORD = r"[^ \t\n\x0B\f\r]+"
_SENTENCE = r"[^.!?]+[.!?]*"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Catalyst inlines a projected column into the lambdas that use it, which
    would evaluate a split once per array element; a lambda variable is not
    inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def tokens(text: Column) -> Column:
    """White-space separated words, no empty ones."""
    return F.filter(F.split(text, _GAP), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD)).cast("long")


def sentences(text: Column) -> Column:
    """Runs ending in ``.``, ``!`` or ``?``, trimmed, no empty ones."""
    found = F.regexp_extract_all(text, F.lit(_SENTENCE), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """Blocks between line breaks, trimmed, no empty ones."""
    return F.filter(F.transform(F.split(text, r"\n+"), strip), lambda p: p != "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def collapse_blank_lines(text: Column) -> Column:
    """Three or more line breaks in a row become two."""
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def doc_uri(path: Column) -> Column:
    """The path part of a URL or file path, without its leading slashes."""
    bare = F.regexp_replace(path, r"[?#].*$", "")
    return F.regexp_replace(bare, r"^([A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?)?/*", "")


def extension(path: Column) -> Column:
    """``.html`` of ``a/b.HTML``; an empty string when there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def chunk_id(text: Column) -> Column:
    return F.md5(text)


def positional_chunk_id(uri: Column, position: Column) -> Column:
    """A key that stays unique when two chunks hold equal text."""
    return F.md5(F.concat_ws("#", uri, position.cast("string")))


def id_bucket(key: Column) -> Column:
    """0-255 from the first two hex digits of the key's md5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 2), 16, 10).cast("int")
