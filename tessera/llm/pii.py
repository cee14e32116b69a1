"""Personal data in text: patterns propose spans, checksums confirm, context adjusts.

Kinds with their own evidence are kept whatever stands near: ``email``; ``ip`` (four parts
of at most 255); ``card`` (13 to 19 digits that pass Luhn); ``phone`` (a plus and 9 to 15
digits). ``iban`` has the length of its country and needs its mod-97 checksum. ``ssn`` and
``secret`` (access keys and long hex or base-64 strings) start from a low score and need
words such as "password" or "ssn", whole or in the plural, within ``NEAR`` characters
before or after them; an access-key prefix is evidence enough.

Offsets are code points, the end exclusive. Every scan is linear in the text: runs of
digits and of name characters are entered at their start only.

Defined cases: null text counts as empty; a very long text is one row and is scanned once for
each kind; repeated rows are each reported; ``detect`` reads no other column, so none can
clash, and ``redacted`` leaves all others as they are, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

NEAR = 40
ACCEPT = 0.5
#: The kinds, in the order in which spans are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "secret")

#: A kind's score before context, and the words that raise it.
START_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "secret": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "e-mail"),
    "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto"),
    "ssn": ("ssn", "social security", "tax id"),
    "secret": ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api key", "access key"),
}
CONTEXT_GAIN = 0.3
#: Letters and digits of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20,
}
_CONTEXT = {k: re.compile(r"(?<![a-z0-9])(?:" + "|".join(map(re.escape, words)) + r")s?(?![a-z0-9])") for k, words in CONTEXT.items()}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN_REST = re.compile(r" ?[A-Z0-9]")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?:AKIA[0-9A-Z]{16}|(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2})(?![A-Za-z0-9+/_-])")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The IBAN check: its number, country and check digits moved to the end, is 1 mod 97."""
    turned = iban[4:] + iban[:4]
    rest = 0
    for c in turned:
        n = int(c, 36)
        rest = (rest * (100 if n > 9 else 10) + n) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield m.span()


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {"email": list(_emails(text)), "ip": [], "card": [], "phone": list(_phones(text))}
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) <= 19 and len(digits) >= 13 and luhn(digits):
                out["card"].append(m.span())
    return out


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _IBAN_START.finditer(text):
        size = IBAN_LENGTHS.get(m[0][:2])
        if not size or m.start() < done:
            continue
        end = m.end()
        for _ in range(size - 4):
            following = _IBAN_REST.match(text, end)
            if not following:
                break
            end = following.end()
        else:
            if not text[end : end + 1].isalnum() and mod97(text[m.start() : end].replace(" ", "")):
                done = end
                yield m.start(), end


def _more(text: str) -> Iterator[tuple[str, int, int, float]]:
    for start, end in _ibans(text):
        yield "iban", start, end, START_SCORE["iban"]
    for m in _SSN.finditer(text):
        yield "ssn", *m.span(), START_SCORE["ssn"]
    for m in _SECRET.finditer(text):
        yield "secret", *m.span(), 0.9 if m[0].startswith("AKIA") and len(m[0]) == 20 else START_SCORE["secret"]


def _score(kind: str, score: float, text: str, start: int, end: int) -> float:
    """A score, raised if a word of the kind's context stands whole within NEAR characters on either side."""
    low, high = max(0, start - NEAR), min(len(text), end + NEAR)
    near = text[low:start].lower(), text[end:high].lower()
    return min(1.0, score + CONTEXT_GAIN * any(_CONTEXT[kind].search(part) for part in near))


def find(text: str | None) -> list[Span]:
    """All spans of a text by kind as listed, then start."""
    text = text or ""
    out = [Span(k, a, b, _score(k, START_SCORE[k], text, a, b)) for k, spans in base_spans(text).items() for a, b in spans]
    taken: list[list[int]] = []  # merged, so that starts and ends both rise
    for a, b in sorted((s.start, s.end) for s in out):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    ends = [b for _, b in taken]

    def free(s: Span) -> bool:
        i = bisect_right(ends, s.start)
        return i == len(taken) or taken[i][0] >= s.end

    more = [Span(k, a, b, _score(k, s, text, a, b)) for k, a, b, s in _more(text)]
    more = [s for s in more if s.score >= ACCEPT and free(s)]
    return out + sorted(more, key=lambda s: (MORE_KINDS.index(s.kind), s.start))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by ``[KIND]``."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans as an array of (kind, start, end, score), for each row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[s._asdict() for s in find(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(rows, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans, and all spans as text."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        *[of(k).alias(f"n_{k}") for k in MORE_KINDS],
        F.round(F.array_max(F.transform("spans", lambda s: s["score"])), 3).alias("top_score"),
    )


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans in its text replaced by their kinds; n_chars follows if it is there."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            new = []
            for t in batch.column(at):
                text = t.as_py()
                new.append(redact(text, found) if text and (found := find(text)) else text)
            columns = batch.columns
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    bound_batches(docs.sparkSession)
    out = docs.mapInArrow(rows, docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
