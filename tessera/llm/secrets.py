"""Secrets: fixed shapes, and strings near sensitive words that a primed zstandard cannot shorten.

Base kinds (assign, access, hex) are reported whenever their own rule holds.  The method adds
kind `novel`: a run of token characters shortly after or before a sensitive word, or on the
lines that follow such a key, is measured by what it adds to the compressed size of the text
around it, under a dictionary of identifiers (`identifier_dictionary`, made of a list of words).
Words, names and what the surroundings repeat are matches in the dictionary or the text and
cost little; a random key has none, and costs more than the bits of a random string of its
length and alphabet.

Defined results: without a list of words the dictionary is a short one of common names, and long
ordinary words near a sensitive word are reported more often; a null or empty text has no spans; a null doc_id stays null; repeated rows
give repeated rows; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPANS, Covered, over_batches, span_table, text_or_empty

BASE = ("assign", "access", "hex")
MIN_LENGTH = 16
NOVELTY = 0.96  # of a random string's bits; a random key spends about 1 or more
# Among lines like it the literals' code fits a long key, and saves it up to an eighth.
LONG, LONG_NOVELTY = 40, 0.85
LEVEL = 19  # the levels with a parser that weighs costs; lower ones take dear chance matches
DICTIONARY_BYTES = 1 << 20  # at most, the words given first being kept
NEAR = 48  # characters at most between a candidate and a sensitive word
BETWEEN = 16  # and between lines of one key: line ends, quotes, indentation
AROUND = 512  # characters of text on either side that prime the compressor

_ASSIGN = re.compile(
    r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE = (
    "password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api key", "api-key",
    "credential", "private key", "access key", "access_key", "authorization", "bearer",
)
_SENSITIVE = re.compile("(?i:" + "|".join(map(re.escape, SENSITIVE)) + ")")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
_NAMED = re.compile("(?i:" + "|".join(map(re.escape, SENSITIVE)) + r")[A-Za-z0-9_-]{0,16}=+")
_FILLER = re.compile(r"[\s\"'\\,;>#*]*(?:\\n)?[\s\"'\\,;>#*]*")
ALPHABETS = tuple(
    (re.compile(f"[{chars}]+"), math.log2(n))
    for chars, n in (("0-9", 10), ("0-9a-f", 16), ("0-9A-F", 16), ("a-z", 26), ("A-Z", 26), ("A-Z2-7", 32),
                     ("0-9a-z", 36), ("0-9A-Z", 36), ("A-Za-z", 52), ("0-9A-Za-z", 62))
)
# Identifiers that code and settings commonly hold: what a compressor should already know.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
    "access_key access_token account address api_key application authentication authorization "
    "aws_access_key_id aws_secret_access_key bearer class client_id client_secret config "
    "connection const credentials database default_password def development encrypted endpoint "
    "environment example export function header hostname https:// import include license localhost "
    "password placeholder private_key production public_key refresh_token request response return "
    "secret_key self.session string token_secret undefined username variable version your_password_here"
)

# Stands before the surroundings, so that short ones bear the fixed costs of a block as well.
CARRIER = (
    "The value below is read when the service starts. Keep it out of the repository, set it in the "
    "environment of the process and change it whenever somebody leaves the team that works on it.\n"
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    out.sort(key=lambda s: (s[1], BASE.index(s[0])))
    return out


def identifier_dictionary(words: Iterable[str] = ()) -> bytes:
    """Words of four letters or more, then the common names, for `find_secrets`.

    Words given first lie at the end, where matches are cheapest.  What exceeds
    `DICTIONARY_BYTES` is left out: a word that is not there only counts as more novel.
    """
    kept, room = [], DICTIONARY_BYTES - len(IDENTIFIERS) - 1
    for word in dict.fromkeys(w for w in words if len(w) >= 4 and w.isalpha()):
        raw = word.encode()
        room -= len(raw) + 1
        if room < 0:
            break
        kept.append(raw)
    return b" ".join((*reversed(kept), IDENTIFIERS.encode()))


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def marginal_bytes(candidate: str, before: str, after: str, dictionary: bytes) -> int:
    """Bytes the candidate adds to its surroundings, compressed under the dictionary."""
    zstd, around = _compressor(dictionary), f"{CARRIER}{after}\n{before}"
    return len(zstd.compress(f"{around}{candidate}".encode())) - len(zstd.compress(around.encode()))


def random_bits(candidate: str) -> float:
    """Bits of a random string of the candidate's length over the smallest usual alphabet that holds it."""
    key = candidate.rstrip("=") or candidate
    return len(key) * next((bits for chars, bits in ALPHABETS if chars.fullmatch(key)), 6.0)


def novelty(candidate: str, before: str, after: str, dictionary: bytes) -> float:
    """Bits the candidate adds, in those of a random string like it."""
    return 8 * marginal_bytes(candidate, before, after, dictionary) / random_bits(candidate)


def is_random(score: float, length: int) -> bool:
    return score >= (LONG_NOVELTY if length >= LONG else NOVELTY)


def novel_spans(
    text: str, taken: list[tuple[str, int, int]], dictionary: bytes
) -> list[tuple[str, int, int, float]]:
    """Random candidates near a sensitive word, or on lines after one, that overlap no span taken."""
    out, last = [], -1  # where the last key ended
    covered = Covered((s, e) for _, s, e in taken)
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    starts, ends = [s for s, _ in words], [e for _, e in words]
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        name = _NAMED.match(text, start, end) or _NAMED.search(text, start, end)
        if name and end - name.end() >= MIN_LENGTH:
            start = name.end()
        before, after = bisect_right(ends, start) - 1, bisect_left(starts, end)
        near = (before >= 0 and start - ends[before] <= NEAR) or (after < len(starts) and starts[after] - end <= NEAR)
        follows = 0 <= last and start - last <= BETWEEN and _FILLER.fullmatch(text, last, start)
        if not (near or follows):
            continue
        if covered(start, end):
            last = end
            continue
        score = novelty(text[start:end], text[max(0, start - AROUND):start], text[end:end + AROUND], dictionary)
        if is_random(score, end - start):
            out.append(("novel", start, end, min(1.0, score)))
            last = end
    return out


def find_spans(text: str, dictionary: bytes = IDENTIFIERS.encode()) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by start and then kind: assign, access, hex, novel."""
    base = base_spans(text)
    out = [(k, s, e, 1.0) for k, s, e in base]
    low = text.lower()
    if any(w in low for w in SENSITIVE):
        out += novel_spans(text, base, dictionary)
        out.sort(key=lambda s: (s[1], (*BASE, "novel").index(s[0])))
    return out


def find_secrets(docs: DataFrame, words: Iterable[str] = ()) -> DataFrame:
    """doc_id and spans(kind, start, end, score) of every text; offsets are code points.

    `words` are what code and texts commonly hold, for the identifier dictionary, which every
    Python worker digests once.
    """
    dictionary = identifier_dictionary(words)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return span_table(batch.column(0), [find_spans(t, dictionary) for t in batch.column(1).to_pylist()])

    return over_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")),
        work,
        f"doc_id long, {SPANS}",
    )
