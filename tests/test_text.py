from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import citations as C
from tessera.functions import text as T

SAMPLES = [
    "",
    " \n ",
    "# # #\nx",
    "# #\n\nReal title ##  \nbody",
    "## Heading ##\r\ntext  \t\r\n\r\n\r\n\r\nmore words\x1fhere",
    "a\x0bb\x0cc\x1cd\x85e f",
    "Müller straße ÀÉ 12,5 İx K",
    "plain",
    "x" * 400 + " é" * 30,
    "---\ntags: a\nTitle: 'Front'  \n---\n# Second\n",
    "intro\n   ### Deep *one*  \nbody",
    "#\n\nnext line heading?",
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(SAMPLES)), "i int, s string").repartition(2)


def values(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def py_normalize(s):
    s = s.replace("\r\n", "\n").replace("\r", "\n")
    s = re.sub(r"[ \t]+\n", "\n", s)
    return re.sub(r"\n{3,}", "\n\n", s).strip()


def py_first_line(s):
    found = (line.strip().strip("#").strip() for line in s.splitlines())
    return next((f[:160] for f in found if f), "fallback")


def test_normalize_strip_and_counts(df):
    s = F.col("s")
    assert values(df, T.normalize_text(s)) == [py_normalize(x) for x in SAMPLES]
    assert values(df, T.strip(s)) == [x.strip() for x in SAMPLES]
    assert values(df, T.token_estimate(s)) == [len(re.findall(r"\S+", x)) for x in SAMPLES]
    assert T.SPACE_CHARS == "".join(c for c in map(chr, range(0x110000)) if c.isspace())


def test_titles(df):
    s, fallback = F.col("s"), F.lit("fallback")
    assert values(df, T.title_from_first_line(s, fallback)) == [py_first_line(x) for x in SAMPLES]
    titles = values(df, T.title_from_markdown(s, fallback))
    assert titles[9] == "Front"
    assert titles[10] == "Deep *one*"
    assert titles[11] == "next line heading?"
    assert titles[7] == "plain"


def test_search_forms(df):
    s = F.col("s")
    plain = [" ".join(re.sub("[^a-z0-9]+", " ", x.lower()).split()) for x in SAMPLES]
    assert values(df, T.normalize_search_text(s)) == plain
    assert values(df, T.fts_tokens(F.lit("Müller's STRASSE straße ÀÉ-12,5 ấ")))[0] == [
        "muller", "s", "strasse", "straße", "ae", "12", "5", "ấ",
    ]
    assert values(df, T.similarity_tokens(F.lit("Ab-c 9É"))) [0] == ["ab", "c", "9"]


def test_excerpt_names_and_slug(df):
    s = F.col("s")
    assert values(df, T.excerpt(s)) == [x if len(x) <= 240 else x[:240] + "..." for x in SAMPLES]
    one = df.filter("i = 0")
    name = T.source_name(F.lit("/a/b.c/note.tar.gz"))
    assert values(one, F.struct(name, T.source_stem(name)))[0] == ("note.tar.gz", "note.tar")
    assert values(one, T.source_stem(F.lit(".hidden")))[0] == ".hidden"
    slugs = [values(one, T.slugify_query(F.lit(q)))[0] for q in (" What, is: THIS? ", "¿?", "a" * 60)]
    assert slugs == ["what-is-this", "query", "a" * 40]
    under = [values(one, T.under_root(F.lit(p), F.lit("/r/a")))[0] for p in ("/r/a", "/r/a/x", "/r/ab")]
    assert under == [True, True, False]


def test_stable_and_snapshot_ids(df):
    one = df.filter("i = 0")
    got = values(
        one, T.stable_chunk_id(F.lit(7), F.lit(0), F.lit(3), F.lit(None).cast("int"), F.lit("é x"))
    )[0]
    assert got == hashlib.sha256("7\x1f0\x1f3\x1f-1\x1fé x".encode()).hexdigest()
    rows = F.array(
        F.struct(F.lit(1).alias("chunk_id"), F.lit("a").alias("stable_id"), F.lit(1).alias("rank")),
        F.struct(
            F.lit(2).alias("chunk_id"), F.lit(None).cast("string").alias("stable_id"),
            F.lit(2).alias("rank"),
        ),
    )
    want = hashlib.sha256("q\x1fhybrid\x1e1\x1fa\x1f1\x1e2\x1f\x1f2".encode()).hexdigest()[:16]
    assert values(one, T.snapshot_id(F.lit("q"), F.lit("hybrid"), rows))[0] == want


def test_query_parts(df):
    one = df.filter("i = 0")
    query = F.lit('Foo "Big  Cat" foo.bar foo "big cat" "" é-x 9:1')
    assert values(one, T.query_phrases(query))[0] == ["big cat"]
    assert values(one, T.query_terms(query))[0] == ["foo", "foo bar", "x", "9 1"]


def test_citations(df):
    one = df.filter("i = 0")
    answer = F.lit("A [C2], B [C10] and [C2]; no [D1].")
    labels = values(one, C.inline_labels(answer))[0]
    assert labels == ["C2", "C10"]
    rendered = C.render_citations(answer, F.array(F.lit("C2"), F.lit("C10")))
    assert values(one, rendered)[0] == "A [1], B [2] and [1]; no [D1]."
    forms = [" [C3] ", "C3", "[C3", "c3", "[[C3]]", ""]
    assert [values(one, C.normalize_chunk_label(F.lit(f)))[0] for f in forms] == [
        "C3", "C3", None, None, None, None,
    ]
    shown = C.citation_display(
        F.lit("[4]"), F.lit("Hut Rules"), F.lit("/srv/notes/hut.txt"),
        F.lit("Beds"), F.lit(12), F.lit(0),
    )
    assert values(one, shown)[0] == (
        "[4] Hut Rules — /srv/notes/hut.txt — Beds — page 12 — chunk 0"
    )


def test_small_rules(df):
    one = df.filter("i = 0")

    def value(column):
        return values(one, column)[0]

    assert value(T.completion_percentage(F.lit(1), F.lit(3))) == 33.333
    assert value(T.completion_percentage(F.lit(0), F.lit(0))) == 100.0
    assert value(T.throughput(F.lit(5), F.lit(0.0))) == 0.0
    assert value(T.eval_delta(F.lit(None), F.lit(1.0))) is None
    assert value(T.dedupe_strings(F.array(F.lit(" a "), F.lit("a"), F.lit(" ")))) == ["a"]
