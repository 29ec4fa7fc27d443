from __future__ import annotations

import pytest

from tessera.operators import runlog as R
from tessera.sources.artifacts import read_run_log
from tessera.sources.files import TOO_LARGE, decode_text, describe_files, scan_files
from tessera.sources.html import _parse, extract_html
from tessera.sources.paged import assemble_pages
from tessera.sources.tables import duplicate_keys, upsert

PAGE = """<!doctype html><html><head><title> Harbour Times </title><style>p{}</style></head>
<body class="page"><header>Masthead</header><nav>Sections</nav>
<div class="site-NAV">More</div><aside id="x">Side</aside><div id="Cookie-box">Accept</div>
<main><h1>Harbour <b>Times</b></h1><p>Boats <i>leave</i> at six &amp; nine.
<p>Second<br>pier<!-- note -->end<section><h2>Fares</h2><p>Return tickets.</section></main>
<article><p>not this</p></article><footer>Imprint</footer></body></html>"""


def test_page_content_is_found_and_chrome_dropped():
    text, title, heading = _parse(PAGE)
    assert title.strip() == "Harbour Times" and heading == "Harbour Times"
    assert text.split("\n") == [
        "# Harbour Times", "Boats", "leave", "at six & nine.", "Second", "pier", "end",
        "## Fares", "Return tickets.",
    ]


def test_references_without_semicolon_may_stay_as_they_are(spark):
    html = "<title>a &amp; b&amp</title><p>x &#65; &#x42; &ampc &notit; &copy; &amp;quot; R&D &"
    assert _parse(html, unclosed=False) == ("x A B &ampc &notit; © &quot; R&D &", "a & b&amp", None)
    assert _parse("<title>b&amp</title>")[1] == "b&"
    pages = spark.createDataFrame([(1, "http://x/a.html", html)], "id long, url string, html string")
    assert extract_html(pages, "id", "url", "html", unclosed=False).first()["title"] == "a & b&amp"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>only text", "only text"),
        ("<title>T</title><p>a<p class=menu>b<p>c", "a\nc"),
        ("<ul><li class=share>x<li>y</ul>", "y"),
        ("<header><h1>Top</h1></header><div>body</div>", "body"),
        ("a</span>b", "ab"),
        ("<div><script>if (a < b) {}</script>x</div>", "x"),
        ("<h3> </h3>x", "###\nx"),
        ("", ""),
    ],
)
def test_odd_pages(html, want):
    assert _parse(html)[0] == want


def test_scan_reads_wanted_contents_only(spark, tmp_path):
    for name, size in (("a.TXT", 5), ("b.md", 900), ("c.bin", 5_000), ("d.Html", 7), ("e.txt.zip", 9), ("txt", 3)):
        (tmp_path / name).write_bytes(b"x" * size)
    key = "spark.sql.sources.binaryFile.maxLength"
    before = spark.conf.get(key)
    spark.conf.set(key, 100)
    try:
        rows = decode_text(describe_files(scan_files(spark, [str(tmp_path)]))).collect()
    finally:
        spark.conf.set(key, before)
    got = {r.source_path.rsplit("/", 1)[1]: (r.parse_status, r.content_hash[:7], r.parse_error) for r in rows}
    assert set(got) == {"a.TXT", "b.md", "d.Html"}
    assert got["b.md"] == ("failed", "length:", TOO_LARGE)
    assert {got[n][0] for n in ("a.TXT", "d.Html")} == {"parsed"}


def test_hidden_roots_below_another_root_are_read_once(spark, tmp_path):
    names = ["a.md", "sub/b.md", "_drafts/c.md", "_drafts/deep/d.md", "_k=v/e.md", "sub/.x/y/f.md"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    roots = ["", "sub", "_drafts", "_drafts/deep", "_k=v", "sub/.x"]
    rows = scan_files(spark, [str(tmp_path / r) for r in roots]).select("path").collect()
    assert sorted(r.path for r in rows) == sorted(str(tmp_path / n) for n in names)


def test_hidden_files_are_found_and_read(spark, tmp_path):
    names = ["a.md", "_b.md", ".c.TXT", "_d/e.md", "_d/sub/f.md", "g/.h/i.html", "g/_metadata.txt", "_metadata_x/l.md", "_j.bin", ".k"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"text of {name}")
    (tmp_path / "_d" / "big.md").write_bytes(b"x" * 2_000)
    (tmp_path / "g" / "back").symlink_to(tmp_path)  # a loop
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, "1000")
    try:
        rows = {r.path: r for r in scan_files(spark, [str(tmp_path)]).collect()}
    finally:
        spark.conf.unset(limit)
    want = [n for n in names if not n.endswith((".bin", ".k"))] + ["_d/big.md"]
    own = {p for p in rows if "/g/back/" not in p}
    assert own == {str(tmp_path / n) for n in want}
    for name in want:
        row = rows[str(tmp_path / name)]
        stat = (tmp_path / name).stat()
        assert row.length == stat.st_size and abs(row.modificationTime.timestamp() - stat.st_mtime) < 1
        assert row.content == (None if name == "_d/big.md" else f"text of {name}".encode())
    for name in ("_b.md", "a.md"):
        assert [r.path for r in scan_files(spark, [str(tmp_path / name)]).collect()] == [str(tmp_path / name)]
    only = scan_files(spark, [str(tmp_path / "_d")], [".md"])
    assert {r.path for r in only.collect()} == {str(tmp_path / "_d" / n) for n in ("e.md", "sub/f.md", "big.md")}


def test_titles_fall_back(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://x/a.html", "<title>  </title><h2>Head  Line</h2>body"),
            (2, "http://x/b.html", "<nav><h1>Nav head</h1></nav><p>first words</p>"),
            (3, "http://x/c.html", "<p>first words</p>"),
            (4, "http://x/d.html", "<p> </p>"),
        ],
        "id long, url string, html string",
    )
    got = extract_html(pages, "id", "url", "html").orderBy("document_id").collect()
    assert [r.title for r in got] == ["Head  Line", "Nav head", "first words", "d"]
    assert got[0].text == "## Head  Line\nbody"


def test_pages_become_one_text(spark):
    rows = [(1, 2, " b \r\n", "Meta"), (1, 1, "", "Meta"), (1, 10, "c", "Meta"), (2, 1, "# T\n", None)]
    pages = spark.createDataFrame(
        rows, "document_id long, page_number int, text string, meta_title string"
    )
    one, two = assemble_pages(pages).orderBy("document_id").collect()
    assert one.text == "[Page 1]\n\n[Page 2]\nb\n\n[Page 10]\nc" and one.title == "Meta"
    assert two.title == "T" and two.pages[0].text == "# T"


def test_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert duplicate_keys(old.union(new), "k").first().k == 2


NAMES = {
    "20260101T000000Z-inspect-a.json": '{"query": "a", "mode": "hybrid", "results": []}',
    "20260102T000000Z-ask-b.json": '{"query": 5, "generated_answer": {}}',
    "20260103T000000Z-debug-bundle.json": '{"doctor": {}, "traces": {"inspect": 1, "ask": []}}',
    "x-inspect-c.json": "[1]",
    "20269999T000000Z-ask-d.json": "no json",
    "20260101T000000Z-other.json": "{}",
    "20260104T000000Z-inspect-e.txt": "{}",
}


@pytest.fixture
def log(spark, tmp_path):
    for name, text in NAMES.items():
        (tmp_path / name).write_text(text)
    return read_run_log(spark, str(tmp_path))


def test_run_log_metadata_and_stats(log):
    meta = {r.file_name: r for r in R.run_log_metadata(log).collect()}
    assert len(meta) == 5
    first = meta["20260101T000000Z-inspect-a.json"]
    assert (first.type, first.query, str(first.timestamp)) == ("inspect", "a", "2026-01-01 00:00:00")
    assert meta["20269999T000000Z-ask-d.json"].timestamp is None
    assert meta["20260102T000000Z-ask-b.json"].query is None
    stats = {r.type: r for r in R.run_log_stats(log).collect()}
    assert {t: r.run_count for t, r in stats.items()} == {
        "inspect": 2, "ask": 2, "debug-bundle": 1, "total": 5,
    }
    assert str(stats["total"].newest_timestamp) == "2026-01-03 00:00:00"
    none = {r.type: r.run_count for r in R.run_log_stats(log.limit(0)).collect()}
    assert none == {"inspect": 0, "ask": 0, "debug-bundle": 0, "total": 0}


def test_run_log_issues(log):
    issues = {r.file_name.split("-", 1)[1]: r.issues for r in R.verify_run_log(log).collect()}
    assert issues == {
        "inspect-a.json": [],
        "ask-b.json": [R.BAD_QUERY, R.NO_SNAPSHOT, R.NO_RETRIEVAL],
        "debug-bundle.json": [R.BAD_TRACES.format("inspect")],
        "inspect-c.json": [R.NO_OBJECT],
        "ask-d.json": [R.NO_OBJECT],
    }
    total = R.verify_summary(R.verify_run_log(log)).first()
    assert (total.total_count, total.valid_count, total.invalid_count) == (5, 1, 4)


def test_retention_keeps_the_newest(spark, log):
    newest = sorted(
        ((r.modified_at, r.file_name) for r in R.run_log_metadata(log).collect()), reverse=True
    )
    for keep in (0, 2, 9):
        kept = R.retention(log, keep).filter("kept").collect()
        assert {r.file_name for r in kept} == {name for _, name in newest[:keep]}


def test_events_are_numbered_after_the_prior_maximum(spark):
    rows = [(i, i % 2, f"2026-01-01 {i % 5:02d}:00:0{i % 3}") for i in range(40)]
    events = spark.createDataFrame(rows, "id long, job_id long, t string").selectExpr(
        "id", "job_id", "CAST(t AS TIMESTAMP) AS created_at"
    )
    prior = spark.createDataFrame([(1, 7), (1, 4)], "job_id long, sequence long")
    got = R.number_events(events, prior).orderBy("job_id", "sequence").collect()
    for job, first in ((0, 1), (1, 8)):
        mine = [r for r in got if r.job_id == job]
        assert [r.sequence for r in mine] == list(range(first, first + 20))
        assert [(r.created_at, r.id) for r in mine] == sorted((r.created_at, r.id) for r in mine)
