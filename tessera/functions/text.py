"""Text functions as plain Column expressions.

Everything here is `Column -> Column` and runs inside the JVM.  Patterns follow
Python's notion of white space (`str.isspace`), which Java's `\\s` and `\\S` do not.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
TITLE_CHARS = 160
EXCERPT_CHARS = 240
QUOTE_CHARS = 180
SLUG_CHARS = 40
SNAPSHOT_CHARS = 16
EMPTY_SLUG = "query"
UNIT_SEPARATOR = "\x1f"
RECORD_SEPARATOR = "\x1e"
QUERY_PART = r'"([^"]+)"|([A-Za-z0-9][A-Za-z0-9._:-]*)'
SIMILARITY_TOKEN = r"[a-z0-9]+"
# ----------------------------------------------------------------------------

# White space of `str.isspace`, as regex classes and as a list for `btrim`.
_SPACES = r"\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{_SPACES}]"
NON_WS = f"[^{_SPACES}]"
SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Line breaks of `str.splitlines`, and white space that is not a line break.
BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
NON_BREAK = r"[^\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
BLANK = r"[\t\x1f\p{Zs}]"
# One word; runs of printable ASCII take a fast path of the regex engine.
WORD = rf"(?:[!-~]++|{NON_WS})++"
FTS_SEPARATOR = r"[^\p{L}\p{N}\p{Co}]+"


def _null_if_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def strip(value: Column) -> Column:
    """White space removed at both ends, as `str.strip` does."""
    return F.btrim(value, F.lit(SPACE_CHARS))


def normalize_text(value: Column) -> Column:
    """Unix line ends, no blanks before a line end, at most one empty line."""
    unix = F.regexp_replace(value, r"\r\n?", "\n")
    trimmed = F.regexp_replace(unix, r"(?<![ \t])[ \t]++\n", "\n")
    return strip(F.regexp_replace(trimmed, r"\n{3,}", "\n\n"))


def title_from_first_line(text: Column, fallback: Column) -> Column:
    """First line that keeps text once blanks and '#' are stripped, cut to 160."""
    line = F.regexp_extract(
        text,
        rf"(?:\A|{BREAK}){BLANK}*+#*+{BLANK}*+((?!#*+{BLANK}*+(?:{BREAK}|\z)){NON_BREAK}+)",
        1,
    )
    title = F.regexp_replace(line, rf"{BLANK}*#*{BLANK}*\z", "")
    return F.coalesce(_null_if_empty(F.substring(title, 1, TITLE_CHARS)), fallback)


def title_from_markdown(text: Column, fallback: Column) -> Column:
    """Front-matter title, else the first ATX heading, else the first line."""
    front = F.regexp_extract(text, rf"(?sd)\A---{WS}*\n(.*?)\n---{WS}*(?:\n|\z)", 1)
    values = F.regexp_extract_all(
        front, F.lit(rf"(?i)(?:\A|{BREAK}){BLANK}*title{BLANK}*:({NON_BREAK}*)"), F.lit(1)
    )
    cleaned = F.filter(
        F.transform(values, lambda v: F.regexp_replace(strip(v), r"""\A["']+|["']+\z""", "")),
        lambda v: v != "",
    )
    declared = F.substring(F.get(cleaned, F.lit(0)), 1, TITLE_CHARS)
    heading = strip(
        F.regexp_extract(text, rf"(?md)^{WS}{{0,3}}#{{1,6}}{WS}+(.+?){WS}*$", 1)
    )
    return F.coalesce(declared, _null_if_empty(heading), title_from_first_line(text, fallback))


def token_estimate(text: Column) -> Column:
    """Number of white-space separated words."""
    bare = strip(text)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"{WS}+")))


def normalize_search_text(value: Column) -> Column:
    """Lower case ASCII words and digits, single blanks between them."""
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


@functools.cache
def accent_table() -> tuple[str, str]:
    """(accented, plain) letters: those that decompose to one base and one mark."""
    accented, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and unicodedata.combining(parts[1]) and parts[0].isascii():
            accented.append(chr(code))
            plain.append(parts[0])
    return "".join(accented), "".join(plain)


def fts_tokens(value: Column) -> Column:
    """Full-text tokens: case folded, accents removed, split on non letter/digit."""
    accented, plain = accent_table()

    def fold(token: Column) -> Column:
        # `translate` is slow; most tokens are ASCII and skip it.
        ascii_only = F.octet_length(token) == F.length(token)
        return F.when(ascii_only, token).otherwise(F.translate(token, accented, plain))

    tokens = F.filter(F.split(F.lower(value), FTS_SEPARATOR), lambda t: t != "")
    return F.transform(tokens, fold)


def similarity_tokens(value: Column) -> Column:
    return F.regexp_extract_all(F.lower(value), F.lit(SIMILARITY_TOKEN), F.lit(0))


def excerpt(text: Column) -> Column:
    return F.when(F.length(text) <= EXCERPT_CHARS, text).otherwise(
        F.concat(F.substring(text, 1, EXCERPT_CHARS), F.lit("..."))
    )


def source_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def source_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def stable_chunk_id(
    document_id: Column, start: Column, end: Column, page: Column, text: Column
) -> Column:
    """Content address of a chunk; missing numbers count as -1."""
    parts = [F.coalesce(c.cast("long"), F.lit(-1)).cast("string") for c in (start, end, page)]
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, document_id.cast("string"), *parts, text), 256)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def slugify_query(query: Column) -> Column:
    dashed = F.regexp_replace(F.lower(strip(query)), "[^A-Za-z0-9]+", "-")
    bare = F.regexp_replace(dashed, r"\A-+|-+\z", "")
    return F.coalesce(_null_if_empty(F.substring(bare, 1, SLUG_CHARS)), F.lit(EMPTY_SLUG))


def under_root(path: Column, root: Column) -> Column:
    bare = F.regexp_replace(root, r"(?<=.)/+\z", "")
    prefix = F.when(bare == "/", bare).otherwise(F.concat(bare, F.lit("/")))
    return (path == bare) | path.startswith(prefix)


def snapshot_id(query: Column, mode: Column, results: Column) -> Column:
    """Fingerprint of an ordered array<struct<chunk_id, stable_id, rank>>."""
    entries = F.transform(
        results,
        lambda r: F.concat_ws(
            UNIT_SEPARATOR,
            r["chunk_id"].cast("string"),
            F.coalesce(r["stable_id"], F.lit("")),
            r["rank"].cast("string"),
        ),
    )
    head = F.concat_ws(UNIT_SEPARATOR, query, mode)
    body = F.array_join(F.concat(F.array(head), entries), RECORD_SEPARATOR)
    return F.substring(F.sha2(body, 256), 1, SNAPSHOT_CHARS)


# Query parsing --------------------------------------------------------------


def query_phrases(query: Column) -> Column:
    """Quoted phrases, normalised, in first-seen order."""
    return _query_parts(query, 1)


def query_terms(query: Column) -> Column:
    """Bare terms, normalised, in first-seen order (a term may hold several words)."""
    return _query_parts(query, 2)


def _query_parts(query: Column, group: int) -> Column:
    parts = F.regexp_extract_all(query, F.lit(QUERY_PART), F.lit(group))
    normalized = F.transform(parts, normalize_search_text)
    return F.array_distinct(F.filter(normalized, lambda p: p != ""))


def exact_title_match(title: Column, normalized_query: Column) -> Column:
    present = title.isNotNull() & (title != "")
    return F.coalesce(present & (normalize_search_text(title) == normalized_query), F.lit(False))


def exact_source_name_match(name: Column, normalized_query: Column) -> Column:
    return normalized_query.isin(
        normalize_search_text(name), normalize_search_text(source_stem(name))
    )


def haystack(*fields: Column) -> Column:
    """Normalised fields, one per line, so that no match can span two of them."""
    return F.concat_ws("\n", *(normalize_search_text(F.coalesce(f, F.lit(""))) for f in fields))


def query_coverage(phrases: Column, terms: Column, text: Column) -> Column:
    """struct<phrase_match, term_coverage>: phrases and terms found as substrings.

    Binding `text` to a lambda variable evaluates it once, not once per term.
    """

    def judge(hay: Column) -> Column:
        found = F.size(F.filter(terms, lambda t: F.contains(hay, t)))
        share = F.when(F.size(terms) > 0, found / F.size(terms)).otherwise(F.lit(0.0))
        return F.struct(
            F.exists(phrases, lambda p: F.contains(hay, p)).alias("phrase_match"),
            share.alias("term_coverage"),
        )

    return F.get(F.transform(F.array(text), judge), F.lit(0))


# Small scalar rules ---------------------------------------------------------


def distance_to_score(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def eval_delta(before: Column, after: Column) -> Column:
    return F.round(after.cast("double") - before.cast("double"), 6)


def completion_percentage(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(done * 100.0 / total, 3)).otherwise(F.lit(100.0))


def throughput(count: Column, elapsed_seconds: Column) -> Column:
    return F.when(elapsed_seconds > 0, F.round(count / elapsed_seconds, 3)).otherwise(F.lit(0.0))


def change_type(known_hash: Column, new_hash: Column) -> Column:
    return (
        F.when(known_hash.isNull(), "added")
        .when(known_hash != new_hash, "updated")
        .otherwise("unchanged")
    )


def dedupe_strings(items: Column) -> Column:
    """Stripped, non-empty, first occurrence kept."""
    return F.array_distinct(F.filter(F.transform(items, strip), lambda s: s != ""))
