"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust scores.

Base kinds (email, ip, card, phone) are reported whenever their own rule holds, whatever
the score says.  Further kinds are reported when a checksum or the words nearby lift their
score to the threshold: iban (mod-97), ssn (number ranges), amex (15 digits, Luhn) and
local_phone (no country code).  A further span never overlaps a base span.

Defined results: a null or empty text has no spans; a null doc_id is kept as null; repeated
rows give repeated rows; other columns of the input are not read; an empty table gives an
empty table.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPANS, Covered, over_batches, span_table, text_or_empty

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn", "amex", "local_phone")
THRESHOLD = 0.5
REACH = 40  # characters of context on either side

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_AMEX = re.compile(r"(?<![0-9])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])")

# Score of a confirmed span before the words nearby are read.
PRIOR = {
    "email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7,
    "iban": 0.8, "ssn": 0.3, "amex": 0.45, "local_phone": 0.3,
}
# Words that make a kind likelier, and words that make any kind unlikelier.
NEARBY = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social security"),
    "amex": ("card", "amex", "american express", "credit"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax"),
}
DOUBT = ("example", "order", "invoice", "version", "isbn", "serial")
BONUS, MALUS = 0.3, 0.2


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", at + 1)


def _digits(match: str) -> str:
    return _NOT_DIGIT.sub("", match)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans, by kind as listed and then by start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(map(_byte, m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 15:
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def _extra(text: str, base: list[tuple[str, int, int]]):
    """Confirmed spans of the further kinds that overlap no base span and no earlier kind's."""
    taken = [(s, e) for _, s, e in base]
    for kind, pattern, confirmed in (
        ("iban", _IBAN, lambda s: mod97(s.replace(" ", ""))),
        ("ssn", _SSN, _ssn),
        ("amex", _AMEX, lambda s: luhn(_digits(s))),
        ("local_phone", _LOCAL_PHONE, lambda s: s.count("(") == s.count(")")),
    ):
        covered = Covered(taken)
        for m in pattern.finditer(text):
            start, end = m.span()
            if confirmed(m.group()) and not covered(start, end):
                taken.append((start, end))
                yield kind, start, end


def _ssn(number: str) -> bool:
    area, group, serial = number.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def score(text: str, kind: str, start: int, end: int) -> float:
    around = (text[max(0, start - REACH):start] + " " + text[end:end + REACH]).lower()
    value = PRIOR[kind]
    if any(w in around for w in NEARBY[kind]):
        value += BONUS
    if any(w in around for w in DOUBT):
        value -= MALUS
    return min(1.0, max(0.0, value))


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score): base spans, then further ones at or above the threshold."""
    base = base_spans(text)
    out = [(k, s, e, score(text, k, s, e)) for k, s, e in base]
    if _DIGIT.search(text):
        more = [(k, s, e, score(text, k, s, e)) for k, s, e in _extra(text, base)]
        out += [x for x in more if x[3] >= THRESHOLD]
    return out


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans(kind, start, end, score) of every text; offsets are code points."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return span_table(batch.column(0), [find_spans(t) for t in batch.column(1).to_pylist()])

    return over_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")),
        work,
        f"doc_id long, {SPANS}",
    )
