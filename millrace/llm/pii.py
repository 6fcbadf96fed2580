"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, URL schemes
and words that announce an identifier. At each anchor a deterministic parser
reads outwards to the item's boundaries, in time linear in what it reads, and
checks it. Four kinds follow fixed rules: email, ip, card and phone. The others
are ipv6 addresses, url (one that holds a login), account (an IBAN, or digits
after a cue) and secret (a key or password after a cue).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import field, sliced

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ipv6", "url", "account", "secret")

#: Cues, in lower case; they are also found capitalised and in capitals.
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://")
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "kontonummer", "compte", "cuenta", "passport", "ssn", "social security")
SECRET_CUES = ("password", "passwd", "token", "api_key", "apikey", "api-key", "secret", "access_key")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk_live_")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"[\x20().0-9-]*+")
IPV6 = re.compile(r"[0-9A-Fa-f:]++")
LOGIN = re.compile(r"[^\s/@:\"'<>]++:[^\s/@\"'<>]++@[A-Za-z0-9.-]++(?::[0-9]++)?(?:/[^\s\"'<>]*+)?")
ACCOUNT = re.compile(r"(?:[\x20]?(?:no|nr|number|num|id|#)\.?)?[\x20]?[:=#]?[\x20]?([0-9](?:[\x20-]?[0-9])++)", re.I)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SECRET = re.compile(r"[\"']?\s?[:=]\s?[\"']?([A-Za-z0-9+/_.!@#$%^&*~-]{8,}+)")
KEY = re.compile(r"[A-Za-z0-9_-]{12,}+")


@lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for anchor, kind in (("@", "at"), ("+", "plus"), ("::", "colons"), *((d, "digit") for d in DIGITS)):
        found.add_word(anchor, (kind, len(anchor)))
    for cues, kind in ((SCHEMES, "scheme"), (ACCOUNT_CUES, "account"), (SECRET_CUES, "secret")):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                found.add_word(form, (kind, len(form)))
    for prefix in KEY_PREFIXES:
        found.add_word(prefix, ("key", len(prefix)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2 and (n := 2 * n) > 9:
            n -= 9
        total += n
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


class Finder:
    """The spans of one text, anchor by anchor from left to right."""

    def __init__(self, text: str):
        self.text = text
        self.spans: list[tuple[int, int, int]] = []
        self.email_from = self.ip_from = self.card_from = self.v6_from = self.iban_from = 0

    def add(self, kind: str, start: int, end: int) -> None:
        self.spans.append((KINDS.index(kind), start, end))

    def at(self, start: int, end: int) -> None:
        text, begin = self.text, start
        while begin > self.email_from and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < start and (domain := DOMAIN.match(text, end)):
            self.add("email", begin, domain.end())
            self.email_from = domain.end()

    def digit(self, start: int, end: int) -> None:
        text = self.text
        if start >= self.ip_from:
            chain = CHAIN.match(text, start)
            self.ip_from = chain.end()
            parts = chain[0].split(".") if "." in chain[0] else ()
            at = start
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                stop = at + sum(map(len, four)) + 3
                if all(map(_small, four)):
                    self.add("ip", at, stop)
                at = stop + 1
        if start >= self.card_from:
            run = CARD.match(text, start)
            self.card_from = run.end() if run else end
            if run:
                digits = run[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    self.add("card", start, run.end())
        if start >= self.iban_from and start >= 2 and text[start - 2 : start].isascii() and text[start - 2 : start].isupper() and text[start - 2 : start].isalpha() and not (start > 2 and text[start - 3].isalnum()):
            if (iban := IBAN.match(text, start - 2)) and iban_valid(iban[0]):
                self.add("account", start - 2, iban.end())
                self.iban_from = iban.end()

    def plus(self, start: int, end: int) -> None:
        text = self.text
        if end < len(text) and text[end] in DIGITS:
            body = PHONE.match(text, end)[0].rstrip(" ().-")
            if len(body) >= 3 and 9 <= sum(c in DIGITS for c in body) <= 15:
                self.add("phone", start, end + len(body))

    def colons(self, start: int, end: int) -> None:
        text, begin = self.text, start
        if start < self.v6_from:
            return
        while begin > self.v6_from and (text[begin - 1] in "abcdefABCDEF:" or text[begin - 1] in DIGITS):
            begin -= 1
        run = IPV6.match(text, begin)
        self.v6_from = run.end()
        groups = run[0].split(":")
        edge = (begin and text[begin - 1].isalnum()) or (run.end() < len(text) and text[run.end()].isalnum())
        if not edge and run[0].count("::") == 1 and ":::" not in run[0] and len(groups) <= 8 and all(len(g) <= 4 for g in groups) and sum(map(bool, groups)) >= 3:
            self.add("ipv6", begin, run.end())

    def scheme(self, start: int, end: int) -> None:
        if login := LOGIN.match(self.text, end):
            self.add("url", start, login.end())

    def account(self, start: int, end: int) -> None:
        if (start == 0 or not self.text[start - 1].isalnum()) and (found := ACCOUNT.match(self.text, end)) and 6 <= sum(c in DIGITS for c in found[1]) <= 34:
            self.add("account", found.start(1), found.end(1))

    def secret(self, start: int, end: int) -> None:
        if (found := SECRET.match(self.text, end)) and any(c in DIGITS for c in found[1]):
            self.add("secret", found.start(1), found.end(1))

    def key(self, start: int, end: int) -> None:
        if (start == 0 or not self.text[start - 1].isalnum()) and (rest := KEY.match(self.text, end)) and any(c in DIGITS for c in rest[0]):
            self.add("secret", start, rest.end())


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by kind as in KINDS and then start; none twice."""
    if not text:
        return []
    finder = Finder(text)
    for last, (kind, length) in _automaton().iter(text):
        getattr(finder, kind)(last + 1 - length, last + 1)
    return [(KINDS[k], start, end) for k, start, end in sorted(set(finder.spans))]


def redacted(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    spans = sorted((start, end, kind) for kind, start, end in find_spans(text))
    if not spans:
        return text
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row's whole text, array<struct<kind, start, end>>.

    One row for each row, repeated rows and null ids included; a null or empty
    text has no spans. Other columns are ignored. An empty table gives an empty
    table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in sliced(batches):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(text)] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([field(docs, id_col), T.StructField("spans", SPAN)]))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with the personal data in text_col replaced.

    A null text stays null and an empty one empty; repeated rows stay repeated;
    spans that overlap are replaced as one. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            at = batch.schema.get_field_index(text_col)
            texts = pa.array([redacted(text) for text in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1 :]], names=batch.schema.names)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listing(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
