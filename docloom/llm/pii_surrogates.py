"""PII: detected entities get keyed surrogates of the same type, gender, script and format.

Detected are e-mail addresses, telephone numbers (E.164 and grouped national
ones), IPv4 and IPv6 addresses, IBANs, card numbers, social security numbers,
and persons named after a title; full names with a title anywhere in the corpus
are also found without one in all documents. An entity's canonical
form (lower case, digits only) and a secret key give its surrogate, so the same
entity has the same surrogate in every document and in every spelling. Digits
stay digits, letters letters of the same case; card check digits stay valid;
names keep script and, for given names, the gender of the title.

All distinct entities of the corpus are checked against one another: where two
share a surrogate, or one equals an entity that occurs, all but the first draw
again, until all are distinct. Only the redrawn ones are sent to the documents
that mention them; the others are computed where they stand.

Defined results: a null text stays null and has no entities; rows with one id
are treated as one document; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stored, with_fixed_ids

KEY = b"docloom surrogate key; replace in production"

_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_NUMBERS = re.compile(
    r"(?P<phone>\+[0-9]{1,3}[ -]?\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}(?![0-9])|(?<![0-9+])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
    r"|(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,5}\)?){1,5}(?![0-9])"
    r"|(?<![0-9.+-])[2-9][0-9]{2}(?P<gap>[-. ])[0-9]{3}(?P=gap)[0-9]{4}(?![0-9]|[-.][0-9])"
    r"|(?<![0-9.+-])0[1-9][0-9]{1,3}[ /-][0-9]{3,4}[ -]?[0-9]{3,4}(?![0-9]|[-.][0-9]))"
    r"|(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<card>(?<![0-9A-Za-z])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9A-Za-z]|[ -][0-9]{1,3}(?![0-9A-Za-z]))|(?<![0-9A-Za-z])(?:[0-9]{4}[ -]){4}[0-9]{1,3}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z]))")
# What any number among them has; most texts have none.
_NUMBER_LIKE = re.compile(r"[0-9][0-9(). -]{6,}")
_IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*(?![\w:]|\.[0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# Country codes of one and of two digits; the others have three.
_ONE_DIGIT = ("1", "7")
_TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
# Titles that name a person, by gender (fixed word lists).
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "κυρία")
_MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "г-н", "κύριος")
_NEUTRAL = ("Dr", "Prof")
_NAME = r"[^\W\d_a-zа-яα-ω](?:[^\W\d_]+|['’][^\W\d_a-zа-яα-ω][^\W\d_]*)(?:-[^\W\d_]+|['’][^\W\d_a-zа-яα-ω][^\W\d_]*)*"
_MOST_NAMES = 4
_PERSON = re.compile(rf"(?<!\w)(?P<title>{'|'.join(_FEMALE + _MALE + _NEUTRAL)})\.? (?P<names>{_NAME}(?: {_NAME}){{0,{_MOST_NAMES - 1}}})")
_RUN = re.compile(rf"(?<!\w){_NAME}(?: {_NAME})+")
# Syllables and endings of invented names by script (fixed lists): female, male.
_SYLLABLES = {
    "latin": ("ba be bo da de di do fa fe ga go ka ke ko la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se so ta te to va ve vi".split(), "a", "n"),
    "cyrillic": ("ба бе бо да де ди до ка ке ко ла ле ли ло ма ме ми мо на не но па пе ра ре ри ро са се со та те то ва ве ви".split(), "а", "н"),
    "greek": ("βα δε δι δο κα κε κο λα λε λι λο μα με μι μο να νε νο πα πε ρα ρε ρι ρο σα σε σο τα τε το".split(), "α", "ς"),
}


_TITLES = _FEMALE + _MALE + _NEUTRAL
_DIGITS = frozenset("0123456789")


class Draw:
    """An endless stream of small numbers that key and entity determine."""

    def __init__(self, *parts: str, key: bytes = KEY):
        self.seed = hashlib.blake2b("\x00".join(parts).encode("utf-8", "replace"), key=key[:64], digest_size=32).digest()
        self.pool, self.block = b"", 0

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = hashlib.blake2b(self.seed + self.block.to_bytes(4, "big"), digest_size=64).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n


def luhn_digit(digits: str) -> str:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 == 0 else 1)
        total += v - 9 if v > 9 else v
    return str(-total % 10)


def _remainder(text: str) -> int:
    """Of an IBAN with its first four characters at the end, letters as numbers from 10, by 97."""
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(text: str) -> str | None:
    """The longest part of groups from the start that has right check digits."""
    while text:
        bare = text.replace(" ", "")
        if 15 <= len(bare) <= 34 and _remainder(bare[4:] + bare[:4]) == 1:
            return text
        text = text.rpartition(" ")[0]
    return None


def _like(text: str, draw: Draw) -> str:
    """Letters for letters of the same case, digits for digits, the rest as it is."""
    return "".join(
        chr(97 + draw.below(26)) if c.islower() else chr(65 + draw.below(26)) if c.isupper() else str(draw.below(10)) if c in _DIGITS else c
        for c in text)


def surrogate(kind: str, canonical: str, attempt: int, key: bytes = KEY) -> str:
    """The surrogate of a canonical form, itself canonical."""
    draw = Draw(kind, canonical, str(attempt), key=key)
    if kind == "email":
        local, _, domain = canonical.partition("@")
        host, _, top = domain.rpartition(".")
        # All addresses of a domain move to the same new domain.
        new_host = _like(host, Draw("domain", host, key=key))
        # Where short names run out of others, later draws are longer.
        more = "".join(chr(97 + draw.below(26)) for _ in range(attempt // 4))
        return f"{_like(local, draw)}{more}@{new_host}.{top}"
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "ssn":
        return f"9{draw.below(100):02d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}"
    if kind == "phone":
        # The country code or trunk zero stays; area codes do not begin with 0 or 1.
        code = canonical[1:] if canonical[0] == "+" else ""
        kept = (2 if code[0] in _ONE_DIGIT else 3 if code[:2] in _TWO_DIGITS else 4) if code else int(canonical[0] == "0")
        return canonical[:kept] + str(2 + draw.below(8)) + "".join(str(draw.below(10)) for _ in canonical[kept + 1:])
    if kind == "ipv6":
        # Zero groups stay, the others keep their width; later draws are wider where short ones run out.
        groups = [(len(g.lstrip("0")), g) for g in canonical.split(":")]
        widths = [min(4, w + attempt // 4) if w else 4 * (attempt >= 16) for w, _ in groups]
        return ":".join(("%x" % (1 + draw.below(15)) + "".join("%x" % draw.below(16) for _ in range(w - 1))).zfill(4) if w else "0000" for w in widths)
    if kind == "iban":
        body = "".join(chr(65 + draw.below(26)) if c.isalpha() else str(draw.below(10)) for c in canonical[4:])
        return canonical[:2] + f"{98 - _remainder(body + canonical[:2] + '00'):02d}" + body
    if kind == "card":
        body = canonical[0] + "".join(str(draw.below(10)) for _ in canonical[1:-1])
        valid = luhn_digit(canonical[:-1]) == canonical[-1]
        return body + (luhn_digit(body) if valid else str((int(luhn_digit(body)) + 1 + draw.below(9)) % 10))
    _, script, gender = kind.split("/")
    syllables, female, male = _SYLLABLES[script]
    name = "".join(syllables[draw.below(len(syllables))] for _ in range(3 + attempt // 4))
    return name + {"f": female, "m": male}.get(gender, male if draw.below(2) else female + male)


def _script(name: str) -> str:
    for c in name:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
    return "latin"


def _digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _in_form(digits: str, original: str) -> str:
    """New digits in the places of the old ones."""
    new = iter(digits)
    return "".join(next(new) if c in _DIGITS else c for c in original)


def _ipv6_in_form(new: str, original: str) -> str:
    """New groups in the places of the old ones, as wide at least."""
    head, gap, tail = original.partition("::")
    first, last = (head.split(":") if head else []), (tail.split(":") if tail else [])
    groups = new.split(":")
    used = groups[:len(first)] + groups[8 - len(last):]
    if gap and any(g != "0000" for g in groups[len(first):8 - len(last)]):
        return new
    shown = [(g.lstrip("0") or "0").zfill(len(o)) for g, o in zip(used, first + last)]
    text = ":".join(shown[:len(first)]) + gap + ":".join(shown[len(first):])
    return text.upper() if original.upper() == original else text


def titled(text: str) -> list[tuple[list[str], str]]:
    """Name words after titles, with the title's gender."""
    return [(m.group("names").split(" "), "f" if m.group("title") in _FEMALE else "m" if m.group("title") in _MALE else "n")
            for m in (_PERSON.finditer(text) if any(title in text for title in _TITLES) else ())]


def detect(text: str, known: dict[str, str] | None = None) -> list[tuple[int, int, str, str]]:
    """Non-overlapping ``(start, end, kind, canonical)`` in order; ``known`` has full names of the corpus and their gender."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(*m.span(), "email", m.group().lower()) for m in _EMAIL.finditer(text)]
    for m in _NUMBERS.finditer(text) if _NUMBER_LIKE.search(text) else ():
        kind, value = m.lastgroup, m.group()
        if kind == "ip" and any(int(x) > 255 for x in value.split(".")):
            continue
        start, end = m.span()
        if kind == "phone" and value[0] == "+":
            # Of numbers in a row, as many groups as a telephone number may have.
            while len(_digits(value)) > 15 and re.search(r"[ .-]", value):
                value = value[:max(value.rfind(c) for c in " .-")]
            if not 8 <= len(_digits(value)) <= 15:
                continue
        digits, grouped = _digits(value), not value.isdigit()
        if kind == "card" and grouped and len(digits) != 16 and luhn_digit(digits[:-1]) != digits[-1]:
            continue
        canonical = value if kind == "ip" else "+" + digits if value[0] == "+" else digits
        found.append((start, start + len(value), kind, canonical))
    for m in _IPV6.finditer(text) if text.count(":") > 1 else ():
        value = m.group() if m.group().endswith("::") else m.group().rstrip(":")
        try:
            address = ipaddress.IPv6Address(value)
        except ValueError:
            continue
        if not (address.is_loopback or address.is_unspecified):
            found.append((m.start(), m.start() + len(value), "ipv6", address.exploded))
    for m in _IBAN.finditer(text):
        if value := _iban(m.group()):
            found.append((m.start(), m.start() + len(value), "iban", value.replace(" ", "")))
    names: dict[str, str] = {}
    people = titled(text)
    for full, gender in (known or {}).items():
        people += [(m.group().split(" "), gender) for m in re.finditer(rf"(?<!\w){re.escape(full)}(?!\w)", text, re.I)]
    for words, gender in people:
        for i, word in enumerate(words):
            # Given names before a family name have the title's gender; a family name has none.
            sex = gender if i < len(words) - 1 else "n"
            names.setdefault(word, f"name/{_script(word)}/{sex}")
    if names:
        # The same names later in the text, without a title.
        anywhere = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})(?!\w)")
        found += [(*m.span(), names[m.group()], m.group().lower()) for m in anywhere.finditer(text)]
    out: list[tuple[int, int, str, str]] = []
    for span in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


def replaced(text: str, attempts: dict[tuple[str, str], int], key: bytes = KEY, known: dict[str, str] | None = None) -> tuple[str, int]:
    """The text with surrogates in place of entities, and how many were replaced."""
    parts, at, spans = [], 0, detect(text, known)
    for start, end, kind, canonical in spans:
        new = surrogate(kind, canonical, attempts.get((kind, canonical), 0), key)
        old = text[start:end]
        if kind in ("phone", "card", "ssn"):
            new = _in_form(_digits(new), old)
        elif kind == "ipv6":
            new = _ipv6_in_form(new, old)
        elif kind == "iban":
            places = iter(new)
            new = "".join(c if c == " " else next(places) for c in old)
        elif kind.startswith("name/"):
            new = new.upper() if old.isupper() and len(old) > 1 else new.capitalize()
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]]), len(spans)


def _known(column: pa.Array) -> Iterator[dict[str, str]]:
    for pairs in column.to_pylist():
        yield {e["name"]: e["gender"] for e in pairs or ()}


def _name_hash(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words).lower().encode()) - (1 << 63)


def _titled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(_name_hash(words), " ".join(words).lower(), gender) for text in batch.column(0).to_pylist() if text
                for words, gender in titled(text) if len(words) > 1]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                                          pa.array([r[2] for r in rows], pa.string())], names=["hash", "name", "gender"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of two to ``_MOST_NAMES`` capitalised words in a row, once per document."""
    for batch in batches:
        ids, hashes = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = set()
            for m in _RUN.finditer(text or ""):
                words = m.group().split(" ")
                found.update(_name_hash(words[i:i + n]) for n in range(2, _MOST_NAMES + 1) for i in range(len(words) - n + 1))
            ids += [doc] * len(found)
            hashes += found
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64())], names=["id", "hash"])


def with_known_names(rows: DataFrame) -> DataFrame:
    """Adds ``known``: the full names with a title somewhere in the corpus that a document may have, with their gender."""
    full = stored(rows.select("text").mapInArrow(_titled, "hash long, name string, gender string")
                  .groupBy("hash", "name").agg(F.min("gender").alias("gender")), "titled")
    met = rows.select("id", "text").mapInArrow(_runs, "id long, hash long").join(full, "hash")
    known = stored(met.groupBy("id").agg(F.collect_set(F.struct("name", "gender")).alias("known")), "known")
    return rows.join(known, "id", "left")


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(doc, kind, canonical) for doc, text, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _known(batch.column(2))) if text
                for kind, canonical in {(s[2], s[3]) for s in detect(text, known)}]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                                          pa.array([r[2] for r in rows], pa.string())], names=["id", "kind", "canonical"])


def _drawn(key: bytes):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(k, c, a, key) for k, c, a in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(new, pa.string())], names=["kind", "canonical", "attempt", "new"])

    return scan


def _family(kind):
    """Kinds within which surrogates must differ: names of one script, whatever the gender, are one."""
    return F.regexp_replace(kind, "/[fmn]$", "")


def redrawn(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """``kind, canonical, attempt`` of the entities whose first surrogate is another's, or an entity of the corpus."""
    state = stored(entities.select("kind", "canonical", F.lit(0).alias("attempt")), "entities")
    originals = state.select(_family(F.col("kind")).alias("family"), F.col("canonical").alias("new")).distinct()
    while True:
        drawn = stored(state.mapInArrow(_drawn(key), "kind string, canonical string, attempt int, new string")
                       .withColumn("family", _family(F.col("kind"))), "drawn")
        # Entities that drew earlier keep what they have.
        first = drawn.groupBy("family", "new").agg(F.min(F.struct("attempt", "canonical", "kind")).alias("first"), F.count(F.lit(1)).alias("n"))
        shared = drawn.join(first.filter("n > 1"), ["family", "new"]).filter(
            F.struct("attempt", "canonical", "kind") != F.col("first")).select("kind", "canonical")
        real = drawn.join(originals, ["family", "new"], "left_semi").select("kind", "canonical")
        again = stored(shared.unionByName(real).distinct(), "again")
        if again.isEmpty():
            return state.filter("attempt > 0")
        state = stored(state.join(again.withColumn("more", F.lit(1)), ["kind", "canonical"], "left").select(
            "kind", "canonical", (F.col("attempt") + F.coalesce("more", F.lit(0))).cast("int").alias("attempt")), "entities")


def _applied(key: bytes):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, extra, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), _known(batch.column(3))):
                if text is None:
                    texts.append(None)
                    counts.append(0)
                    continue
                new, n = replaced(text, {(e["kind"], e["canonical"]): e["attempt"] for e in extra or ()}, key, known)
                texts.append(new)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(texts, pa.string())],
                                             names=["doc_id", "n_entities", "text"])

    return scan


def anonymised(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``doc_id, n_entities, text`` with surrogates in place of all entities."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), with_fixed_ids(F.col("doc_id")).alias("id"), "text")
    rows = with_known_names(rows)
    mentions = stored(rows.select("id", "text", "known").mapInArrow(_mentions, "id long, kind string, canonical string"), "mentions")
    again = stored(redrawn(mentions.select("kind", "canonical").distinct(), key), "redrawn")
    extra = stored(mentions.join(again, ["kind", "canonical"]).groupBy("id").agg(
        F.collect_set(F.struct("kind", "canonical", "attempt")).alias("extra")), "extra")
    # A stored table of known size: sent to the documents when small, else both sides are shuffled.
    return rows.join(extra, "id", "left").select("doc_id", "text", "extra", "known").mapInArrow(
        _applied(key), "doc_id long, n_entities long, text string")
