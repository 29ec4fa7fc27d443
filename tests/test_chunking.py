from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators.chunking import chunk_documents

SCHEMA = (
    "document_id long, doc_type string, title string, text string, "
    "pages array<struct<page_number:int,text:string>>"
)


def chunks_of(spark, text, target, overlap, doc_type="text", pages=None, document_id=1):
    doc = spark.createDataFrame([(document_id, doc_type, "T", text, pages)], SCHEMA)
    return chunk_documents(doc, target, overlap).orderBy("chunk_index").collect()


def words(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


def test_headed_sections_start_new_chunks(spark):
    text = f"# Intro\n\n{words('a', 12)}\n\n## Details\n\n{words('b', 12)}"
    rows = chunks_of(spark, text, 12, 2)
    assert [r.section_title for r in rows] == ["Intro", "Details"]
    assert "# Intro" in rows[0].text and "## Details" in rows[1].text


def test_overlap_repeats_the_trailing_paragraph(spark):
    text = "\n\n".join(words(p, 4) for p in "abcd")
    rows = chunks_of(spark, text, 8, 4)
    assert len(rows) >= 2
    assert words("b", 4) in rows[0].text and words("b", 4) in rows[1].text


def test_no_overlap_across_sections(spark):
    text = (
        f"# Intro\n\n{words('a', 12)}\n\n## Details\n\n{words('b', 12)}\n\n{words('c', 5)}"
    )
    rows = chunks_of(spark, text, 12, 4)
    assert len(rows) == 3
    assert rows[1].section_title == "Details"
    assert rows[1].text.startswith("## Details") and "a0" not in rows[1].text


def test_pages_split_and_keep_their_number(spark):
    pages = [(1, words("a", 6)), (2, words("b", 6))]
    text = f"[Page 1]\n{pages[0][1]}\n\n[Page 2]\n{pages[1][1]}"
    rows = chunks_of(spark, text, 6, 1, "pdf", pages)
    assert [r.page_number for r in rows] == [1, 2]
    assert rows[0].text == f"[Page 1]\n{pages[0][1]}"
    assert rows[1].text == f"[Page 2]\n{pages[1][1]}"


def test_tiny_tail_joins_the_chunk_before(spark):
    rows = chunks_of(spark, f"{words('a', 6)}\n\n{words('b', 6)}\n\ntail", 12, 2)
    assert len(rows) == 1 and rows[0].text.endswith("tail")


def test_ids_are_repeatable_and_distinct(spark):
    text = f"{words('a', 4)}\n\n{words('b', 4)}"
    first, second = (chunks_of(spark, text, 4, 1, document_id=9) for _ in range(2))
    assert [r.stable_id for r in first] == [r.stable_id for r in second]
    assert len({r.stable_id for r in first}) == len(first)


def test_blank_text_has_no_chunks_and_settings_are_checked(spark):
    assert chunks_of(spark, " \n ", 4, 1) == []
    for target, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunks_of(spark, "x", target, overlap)


def plain_chunks(text, target, overlap):
    """Brute-force statement of the packing rules on (start, end, tokens, section)."""
    blocks = [
        (m.start(), m.start() + len(m.group().rstrip()))
        for m in re.finditer(r"\S.*?(?=\n\s*\n|\Z)", text, re.S)
    ]
    segments, section = [], None
    for start, end in blocks:
        head = re.match(r"#{1,6}\s+(.+)", text[start:end].splitlines()[0].strip())
        section = head.group(1).strip() if head else section
        marks = list(re.finditer(r"\S+", text[start:end]))
        for i in range(0, len(marks), target):
            part = marks[i : i + target]
            segments.append((start + part[0].start(), start + part[-1].end(), len(part), section))
    drafts = []
    for seg in segments:
        size = sum(s[2] for s in drafts[-1]["segs"]) if drafts else 0
        cut = not drafts or (
            size >= max(2, target // 2)
            and (drafts[-1]["section"] != seg[3] or size + seg[2] > target)
        )
        if cut:
            drafts.append({"segs": [seg], "section": seg[3]})
        else:
            drafts[-1]["segs"].append(seg)
            drafts[-1]["section"] = drafts[-1]["section"] or seg[3]
    if len(drafts) > 1:
        tail, prev = (sum(s[2] for s in d["segs"]) for d in (drafts[-1], drafts[-2]))
        orphan = max(1, target // 5)
        if tail <= orphan and tail + prev <= target + orphan:
            drafts[-2]["segs"] += drafts.pop()["segs"]
    out = []
    for i, d in enumerate(drafts):
        start = d["segs"][0][0]
        if overlap and i and drafts[i - 1]["section"] == d["section"]:
            total = 0
            for seg in reversed(drafts[i - 1]["segs"]):
                start, total = seg[0], total + seg[2]
                if total >= overlap:
                    break
        out.append((start, d["segs"][-1][1], d["section"]))
    return out


def random_text(rng):
    parts = []
    for _ in range(rng.randint(0, 25)):
        kind = rng.random()
        if kind < 0.2:
            parts.append("#" * rng.randint(1, 7) + " " + words("h", rng.randint(0, 3)))
        else:
            gaps = [" ", "\n", " ", "  "]
            parts.append("".join(f"w{i}é{rng.choice(gaps)}" for i in range(rng.randint(1, 30))))
    return rng.choice(["", " \n"]) + "".join(p + rng.choice(["\n\n", "\n \n", "\n\n\n"]) for p in parts)


@pytest.mark.parametrize(("target", "overlap"), [(1, 0), (10, 3), (16, 0), (40, 20)])
def test_packing_equals_brute_force(spark, target, overlap):
    rng = random.Random(target * 100 + overlap)
    texts = [(i, random_text(rng)) for i in range(60)]
    doc = spark.createDataFrame(texts, "document_id long, text string")
    got = {}
    for r in chunk_documents(doc, target, overlap).orderBy("document_id", "chunk_index").collect():
        assert r.text == texts[r.document_id][1][r.start_offset : r.end_offset]
        assert r.token_estimate == len(r.text.split())
        got.setdefault(r.document_id, []).append((r.start_offset, r.end_offset, r.section_title))
    assert got == {i: c for i, t in texts if (c := plain_chunks(t, target, overlap))}


def test_ids_unique_on_the_sample_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("document_id"), "text"
    )
    ch = chunk_documents(docs)
    assert ch.groupBy("stable_id").count().filter("count > 1").isEmpty()
    assert ch.groupBy("chunk_id").count().filter("count > 1").isEmpty()


def test_blocks_are_cut_and_counted_once(spark):
    """Expressions inside lambdas are evaluated at each mention, so that none may be mentioned twice."""
    doc = spark.createDataFrame([(1, "# A\n\none two three\n\n" + "word " * 30)], "document_id long, text string")
    plan = chunk_documents(doc, 10, 2)._jdf.queryExecution().optimizedPlan().toString()
    segments = plan[plan.index("aggregate("):]
    assert segments.count("regexp_extract_all(text") == 1
    assert segments.count("#{1,6}") == 1
