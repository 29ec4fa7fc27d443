"""URL judgements: rules by host and path, then a list of canonical URLs.

A rule (verdict, 'host/path') fits its host and all subdomains when the URL's path starts
with the rule's path; the longest fitting rule wins.  A URL without a rule is blocked when
its canonical form is listed: a blocked Bloom filter of the list passes possible hits on to
an exact join by the canonical URL, and everything else is allowed without a shuffle.

Defined results: a null URL, or one without '://', has empty host and path, fits no rule,
and is allowed; a path that is empty starts with no rule's path; null page ids stay null and
repeated rows give repeated rows; other columns are not read; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import bloom
from tessera.llm.common import ascii_lower

Rule = tuple[str, str]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """host/path?query without scheme, 'www.', fragment, utm parameters and closing slash."""
    host, path = split_url(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(
        F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&"
    )
    bare = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))
    return F.coalesce(F.when(kept == "", bare).otherwise(F.concat_ws("?", bare, kept)), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        name = F.when(fits, F.lit(rule)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, words: int = bloom.WORDS
) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of `pages`.

    `listed` has one column `url` of canonical URLs, of any size.
    """
    url = F.col("url").cast("string")
    host, path = split_url(url)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        host.alias("host"),
        path.alias("path"),
        canonical_url(url).alias("canonical"),
    )
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select(
        "*", name.alias("rule"), verdict.alias("said"), F.xxhash64("canonical").alias("hash")
    )
    listed = listed.select(F.col("url").cast("string").alias("canonical")).where("canonical <> ''").distinct()
    hashes = listed.select(F.xxhash64("canonical").alias("hash"))
    held = bloom.build(
        hashes.select(
            bloom.word_of(F.col("hash"), words).alias("word"), bloom.mask_of(F.col("hash")).alias("mask")
        )
    )
    probed = bloom.probe(rows, "hash", held, words, "possible")
    passed = probed.where(~F.col("possible")).withColumn("listed", F.lit(False))
    checked = probed.where("possible").join(
        listed.withColumn("found", F.lit(True)), "canonical", "left"
    ).withColumn("listed", F.coalesce("found", F.lit(False)))
    columns = (
        "page_id", "host", "path", "rule",
        F.coalesce("said", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed",
    )
    return passed.select(*columns).unionByName(checked.select(*columns))
