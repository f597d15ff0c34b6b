"""URL filters: pattern rules under their rarest literal token.

A rule's literal tokens are the runs of letters and digits that any URL it fits
must hold as whole tokens. The pages are scanned once to count those tokens;
each rule goes under its rarest. In a second scan a URL's tokens fetch the
candidate rules, and only these run their regular expressions. Rules without a
literal token are tried on every URL. Nothing is shuffled but the counts.

Host rules (``example.com/en/``) fit a host, its subdomains and paths with that
start; the longest that fits decides. Where none fits, any text pattern that
fits blocks the page. Text patterns may hold ``*``, stand at token borders and
ignore the case of A-Z.

Defined results: a null URL, or one without ``://``, has an empty host and path
and is allowed; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import opened, sent

# The queries' host rules, fixed by their contract.
HOST_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
TEXT_PATTERNS = ("spam-farm", "cheap-pills", "casino-win", "casino", "viagra", "payday-loan*", "free-money", "/wp-login.php", "/cgi-bin/")
ALLOW, BLOCK = "allow", "block"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    is_host: bool


def host_rule(verdict: str, name: str) -> Rule:
    """The host stands before the first slash and is followed by the path's start."""
    tokens = _TOKEN.findall(name.translate(_LOWER))
    if tokens and name[-1].isalnum():
        # The path may go on within the last token.
        tokens = tokens[:-1]
    return Rule(name, verdict, r"(?:[^/]*\.)?" + re.escape(name), tuple(tokens), True)


def text_pattern(name: str) -> Rule:
    parts = name.split("*")
    regex = "[^ ]*".join(re.escape(p) for p in parts)
    if name[:1].isalnum():
        regex = r"(?:^|[^a-z0-9])" + regex
    if name[-1:].isalnum():
        regex += r"(?:[^a-z0-9]|$)"
    tokens = []
    for i, part in enumerate(parts):
        for m in _TOKEN.finditer(part):
            # A token next to a star may be part of a longer one.
            if not (m.start() == 0 and i > 0) and not (m.end() == len(part) and i < len(parts) - 1):
                tokens.append(m.group())
    return Rule(name, BLOCK, regex, tuple(tokens), False)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(_LOWER), re.match(r"[^?#]*", rest[len(host):]).group()


def tokens_of(subject: str) -> set[str]:
    return set(_TOKEN.findall(subject.translate(_LOWER)))


class RuleIndex:
    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]):
        self.rules = [(r, re.compile(r.regex)) for r in rules]
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        for i, rule in enumerate(rules):
            if rule.tokens:
                rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), t))
                self.by_token.setdefault(rarest, []).append(i)
            else:
                self.always.append(i)

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        subject = host + path
        plain = subject.translate(_LOWER)
        longest, blocked = None, False
        for i in self.always + [i for t in tokens_of(subject) for i in self.by_token.get(t, ())]:
            rule, regex = self.rules[i]
            if rule.is_host:
                if (longest is None or len(rule.name) > len(longest.name)) and regex.match(subject):
                    longest = rule
            elif not blocked:
                blocked = regex.search(plain) is not None
        if longest is not None:
            return longest.name, longest.verdict
        return None, BLOCK if blocked else ALLOW


def _counted(wanted: frozenset[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                counts.update(tokens_of("".join(split_url(url))) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

    return scan


def _judged(index):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(index)
        for batch in batches:
            parts = [split_url(url) for url in batch.column(1).to_pylist()]
            found = [own.judge(*p) for p in parts]
            columns = [[p[0] for p in parts], [p[1] for p in parts], [f[0] for f in found], [f[1] for f in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)],
                                             names=["page_id", "host", "path", "rule", "verdict"])

    return scan


def judged(pages: DataFrame, host_rules: Sequence[tuple[str, str]] = HOST_RULES, patterns: Sequence[str] = TEXT_PATTERNS) -> DataFrame:
    """``page_id, host, path, rule, verdict``. The rules are parameters; their index is sent to the tasks."""
    rules = [host_rule(*r) for r in host_rules] + [text_pattern(p) for p in patterns]
    wanted = frozenset(t for r in rules for t in r.tokens)
    # One row per literal token of the rules.
    counts = pages.select("url").mapInArrow(_counted(wanted), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    index = sent(pages.sparkSession, RuleIndex(rules, {r["token"]: r["n"] for r in counts.collect()}))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(
        _judged(index), "page_id long, host string, path string, rule string, verdict string")


# The fixed rules in DuckDB, longest first.
ORACLE = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r),
f AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '(^|[^a-z0-9])(spam-farm|cheap-pills|casino-win|casino|viagra|free-money)([^a-z0-9]|$)|(^|[^a-z0-9])payday-loan|/wp-login\.php([^a-z0-9]|$)|/cgi-bin/') THEN 'block'
    ELSE 'allow' END AS verdict
FROM f
"""
