"""Deduplication, Jaccard join, decontamination, URLs, pages, quality and the pipeline."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bloom, jaccard_join, quality
from tessera.llm.decontam import Items, build_index, clean_documents, decontaminate, near_documents, proximity_matches
from tessera.llm.exact_dedup import distinct_documents, list_duplicates
from tessera.llm.jaccard_join import components, one_per_component
from tessera.llm.oracle import ORACLE_SQL
from tessera.llm.page_text import extract_text, main_text
from tessera.llm.queries import REGISTRY, RULES
from tessera.llm.urls import judge_urls
from tests.llm.cases import PLAIN, TEXTS, documents
from tools.check import TABLES, rows_of

WORDS = PLAIN.split()


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, db, name):
    df = REGISTRY[name](spark, sf_dir)
    result = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, result.fetchall())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 14))


# Exact duplicates


def plain_duplicates(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, len(t or "")))
    out = []
    for key, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        for i, n in members:
            out.append((i, keep[0], len(members), (i, n) == keep, sha256(key.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("words", [bloom.WORDS, 1])
def test_duplicates_of_awkward_rows(spark, words):
    got = list_duplicates(documents(spark), words).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == plain_duplicates(TEXTS)
    assert list_duplicates(documents(spark, [])).count() == 0


def test_distinct_documents_keep_one_row_with_its_columns(spark):
    docs = documents(spark)
    kept = distinct_documents(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    texts = [re.sub(r"\s", "", r.text or "") for r in kept]
    assert len(texts) == len(set(texts)) == len({re.sub(r"\s", "", t or "") for _, t in TEXTS})
    assert {(3, " \n\t "), (5, PLAIN)} <= {(r.doc_id, r.text) for r in kept}
    assert distinct_documents(documents(spark, [])).count() == 0


def test_single_texts_are_not_shuffled(spark):
    plan = list_duplicates(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "Python" not in plan and "Arrow" not in plan


# Jaccard join


def plain_components(rows, size=5, percent=75):
    def words(t):
        return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w]

    sets = []
    for _, t in rows:
        w = words(t)
        k = min(size, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    label = [i for i, _ in rows]
    near = [
        (x, y) for x in range(len(rows)) for y in range(x) if sets[x] and sets[y]
        and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y])
    ]
    same = [(x, y) for x in range(len(rows)) for y in range(x) if rows[x][0] == rows[y][0]]
    for _ in rows:
        for x, y in near + same:
            if label[x] is not None and label[y] is not None:
                label[x] = label[y] = min(label[x], label[y])
    return sorted(zip([i for i, _ in rows], map(len, sets), label, strict=True), key=repr)


def near_copies(seed, n_groups=12, n_copies=9):
    """Groups of texts with a few changed words, chains of small changes, and shared passages."""
    draw = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(60)]
    rows, doc_id = [], 0
    for g in range(n_groups):
        base = [f"w{g}x{i}" for i in range(int(draw.integers(1, 120)))]
        text = list(base)
        for _ in range(n_copies):
            chain = draw.random() < 0.3
            text = list(text if chain else base)
            for _ in range(int(draw.integers(0, 4))):
                text[int(draw.integers(len(text)))] = f"z{draw.integers(1_000_000)}"
            whole = text + passage if draw.random() < 0.2 else text
            rows.append((doc_id, " ".join(whole)))
            doc_id += 1
    return [rows[i] for i in draw.permutation(len(rows))]


@pytest.mark.parametrize("seed, light, chunk", [(1, 64, 1_000_000), (2, 3, 500), (3, 64, 300), (4, 2, 1_000_000)])
def test_components_equal_brute_force(spark, monkeypatch, seed, light, chunk):
    monkeypatch.setattr(jaccard_join, "LIGHT", light)
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    rows = near_copies(seed)
    assert sorted(map(tuple, components(documents(spark, rows)).collect()), key=repr) == plain_components(rows)


@pytest.mark.parametrize("seed", [5, 6])
def test_scans_in_blocks_and_slices_lose_no_link(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard_join, "LIGHT", 2)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    monkeypatch.setattr(jaccard_join, "BLOCK", 600)
    rows = near_copies(seed)
    assert sorted(map(tuple, components(documents(spark, rows)).collect()), key=repr) == plain_components(rows)


def test_blocks_meet_their_slices_in_one_task(spark, monkeypatch):
    """Both sides of a scan deal their cells out alike, where partitions are not joined into one."""
    for name, value in (("LIGHT", 2), ("ROUNDS", 0), ("BLOCK", 600)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_copies(5)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        got = sorted(map(tuple, components(documents(spark, rows)).collect()), key=repr)
    finally:
        spark.conf.unset(setting)
    assert got == plain_components(rows)


def test_rounds_of_a_scan_shuffle_no_more_than_the_stored_sets(spark, monkeypatch):
    """Unrelated texts with one passage: each is compared with each, in tasks dealt over rounds."""
    for name, value in (("LIGHT", 2), ("ROUNDS", 0), ("BLOCK", 600), ("ROUND", 600)):
        monkeypatch.setattr(jaccard_join, name, value)
    rounds, add = [], jaccard_join.Links.add
    monkeypatch.setattr(jaccard_join.Links, "add", lambda links, found: (rounds.append(found), add(links, found)))
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{passage} " + " ".join(f"t{i}w{j}" for j in range(6 + i % 2))) for i in range(60)]
    rows += [(i + 100, t + " end") for i, t in rows[:9]]
    got = sorted(map(tuple, components(documents(spark, rows)).collect()), key=repr)
    assert got == plain_components(rows)
    assert len(rounds) > 3


def test_an_id_with_several_texts_links_through_all_of_them(spark):
    a, b = PLAIN, " ".join(f"b{i}" for i in range(30))
    rows = [(3, a), (10, a), (3, b), (2, b), (20, a + " more"), (7, b + " end"), (30, "else"), (30, None), (31, "else")]
    got = sorted(map(tuple, components(documents(spark, rows)).collect()), key=repr)
    assert got == plain_components(rows)
    assert {r[2] for r in got if r[0] < 30} == {2}
    extreme = [((1 << 63) - 1, a), ((1 << 63) - 1, b), (5, b), (-9, a)]
    got = sorted(map(tuple, components(documents(spark, extreme)).collect()), key=repr)
    assert got == plain_components(extreme)


def test_empty_rows_beside_texts_link_nothing(spark):
    """Ids with a text and an empty row each, in pairs that share shingles but are not similar."""
    rows = []
    for i in range(0, 80, 2):
        base = " ".join(f"t{i}w{j}" for j in range(8))
        rows += [(i, base + " x"), (i, None), (i + 1, base + " y"), (i + 1, " ")]
    got = sorted(map(tuple, components(documents(spark, rows)).collect()), key=repr)
    assert got == plain_components(rows)
    assert all(r[0] == r[2] for r in got)


def test_empty_rows_link_nothing_in_scans(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIGHT", 2)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    base = " ".join(f"w{j}" for j in range(8))
    rows = [(i, t) for i in range(30) for t in (f"{base} x{i}", None)]
    got = sorted(map(tuple, components(documents(spark, rows)).collect()), key=repr)
    assert got == plain_components(rows)


def test_components_of_the_least_and_greatest_ids(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(low, PLAIN), (4, PLAIN + " more"), (high, PLAIN + " end"), (5, "else")]
    got = sorted(map(tuple, components(documents(spark, rows)).collect()), key=repr)
    assert got == plain_components(rows)
    several = [(low, "else one two"), (low, PLAIN), (high, PLAIN + " more"), (high, "a b c"), (7, "a b c")]
    got = sorted(map(tuple, components(documents(spark, several)).collect()), key=repr)
    assert got == plain_components(several)


def test_components_of_awkward_rows(spark):
    docs = documents(spark)
    assert sorted(map(tuple, components(docs).collect()), key=repr) == plain_components(TEXTS)
    assert components(documents(spark, [])).count() == 0
    kept = one_per_component(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id)
    wanted = sorted(i for i, _, label in plain_components(TEXTS) if i is not None and i == label)
    assert ids == wanted
    assert one_per_component(documents(spark, [])).count() == 0


# Decontamination


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_hits(rows, items):
    out = []
    for doc_id, text in rows:
        words, hit, ids = plain_words(text), set(), set()
        for item_id, item in items:
            own = plain_words(item)
            if item_id is None or not own:
                continue
            n = min(10, len(own))
            windows = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)}
            for p in range(len(words) - n + 1):
                if tuple(words[p:p + n]) in windows:
                    hit.update(range(p, p + n))
                    ids.add(str(item_id))
        out.append((doc_id, len(words), len(hit), len(ids), sorted(ids), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [
    (1, PLAIN), (2, "near 7 small stones"), (3, None), (4, "...!"), (None, PLAIN), (5, "ten Eleven, twelve"),
    (5, "one one one one one one one one one one one"), (6, "never met"), (7, " ".join(WORDS[3:] + WORDS[:3])),
]


def test_hits_equal_brute_force(spark):
    draw = np.random.default_rng(5)
    vocabulary = [*WORDS, "one", "one", "é", "x"]
    rows = [*TEXTS, (20, "One " * 30), (21, ",".join(WORDS) + " " + PLAIN), (22, PLAIN.replace("six", "SIX é"))]
    rows += [(100 + i, " ".join(draw.choice(vocabulary, 200))) for i in range(20)]
    rows += [(200 + i, " ".join([*draw.choice(vocabulary, 9), *WORDS[i:i + 11]])) for i in range(6)]
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, rows)
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, list(r["items"]), r.contaminated)
           for r in decontaminate(docs, benchmark).collect()]
    wanted = plain_hits(rows, ITEMS)
    assert sorted(got, key=repr) == wanted
    clean = clean_documents(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in clean.collect()) == sorted((w[0] or -1) for w in wanted if not w[5])


def test_empty_tables_are_clean(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate(documents(spark, []), benchmark).count() == 0
    rows = decontaminate(documents(spark), benchmark.limit(0)).collect()
    assert len(rows) == len(TEXTS) and not any(r.contaminated for r in rows)


def test_proximity_takes_terms_in_any_order(spark):
    rows = [(1, "x " * 50 + "delta alpha x gamma beta" + " y" * 50), (2, "alpha " + "x " * 200 + "beta gamma delta")]
    items = Items.of(spark.createDataFrame([(9, "alpha beta gamma delta")], "item_id long, text string"))
    index = build_index(documents(spark, rows), items)
    found = proximity_matches(index, items, reach=30).join(index.rows, ["k_doc", "k_text"])
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(1, 9)]


def plain_near(rows, items, n_terms=4, reach=60):
    """Items whose rarest terms stand within a stretch; ties in rarity go by the hash, so tests avoid them."""
    texts = {i: plain_words(t) for i, t in rows}
    count = Counter(w for words in texts.values() for w in words)
    out = {}
    for doc_id, words in texts.items():
        near = set()
        for item_id, item in items:
            rarest = set(sorted(set(plain_words(item)), key=lambda w: count[w])[:n_terms])
            if rarest and any(rarest <= set(words[a:a + reach]) for a in range(max(1, len(words)))):
                near.add(str(item_id))
        out[doc_id] = sorted(near)
    return out


def test_near_documents_equal_brute_force(spark):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(4)) + " common") for i in range(5)]
    draw = np.random.default_rng(8)
    rows = []
    for d in range(80):
        words = ["common"] * 160
        for w in items[d % 5][1].split()[:4 - (d % 7 == 0)]:
            words[int(draw.integers(160 if d % 2 else 70))] = w
        rows.append((d, " ".join(words)))
    rows += [(90, None), (91, ""), (92, items[2][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = near_documents(documents(spark, rows), benchmark).collect()
    got = {r.doc_id: list(r.near_items) for r in found}
    wanted = plain_near(rows, items)
    assert got == wanted and all(r.n_near == len(r.near_items) for r in found)
    assert 5 < sum(map(bool, wanted.values())) < 75


def test_near_query_is_registered():
    import __spark_entry__

    assert "op10_near" in __spark_entry__.queries()


# URLs


def test_urls_of_awkward_rows(spark):
    urls = ["http://a.example.net/en/x", "http://example.net/EN/", "http://net", "HTTP://X.ORG/fr/?q", "no url", None,
            "http://badnet/x", "https://www.spam.io/a/?b=2&a=1&utm_x=3#f", "https://spam.io/a?a=1&b=2", "://", ""]
    pages = spark.createDataFrame([(i, u, "h", True) for i, u in enumerate(urls)],
                                  "page_id long, url string, host string, listed boolean")
    listed = spark.createDataFrame([("spam.io/a?a=1&b=2",), ("spam.io/a?a=1&b=2",), (None,), ("",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, RULES, listed, 4).collect()}
    assert got == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("example.net", "/EN/", "net/", "block"),
        2: ("net", "", None, "allow"), 3: ("x.org", "/fr/", "org/fr/", "allow"), 4: ("", "", None, "allow"),
        5: ("", "", None, "allow"), 6: ("badnet", "/x", None, "allow"),
        7: ("www.spam.io", "/a/", None, "block"), 8: ("spam.io", "/a", None, "block"),
        9: ("", "", None, "allow"), 10: ("", "", None, "allow"),
    }
    assert judge_urls(pages.limit(0), RULES, listed).count() == 0


# Pages


def article(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    import html

    parts = [html.unescape(re.sub(r"<[^>]*>", "", b)) for b in re.split(r"</?(?:h1|p|br)>", body)]
    return "\n".join(filter(None, (re.sub(r"\s+", " ", p).strip() for p in parts)))


def test_page_text_equals_the_articles(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = REGISTRY["op6_page_text"](spark, sf_dir).collect()
    assert {r.page_id: r.text for r in got} == {i: article(h) for i, h in pages.items()}
    assert all(r.n_chars == len(r.text) for r in got)


def test_page_text_of_other_layouts(spark):
    def page(i):
        return (
            f"<html><body><header><h1>Site</h1></header><div class='menu'><a href=x>Home</a></div>"
            f"<div id=main><h2>Title {i}</h2><p>Body &amp; text {'word ' * 30}{i}</p><p>Cookies are used.</p>"
            f"<div class='comments'><p>reader {i} says much {'so ' * 50}</p></div><form><p>sign</p></form></div>"
            f"<aside>aside {i}</aside><footer>foot</footer></body></html>"
        )

    rows = [(i, f"http://h.test/{i}", page(i)) for i in range(30)]
    rows += [(90, None, None), (91, "http://h.test/e", ""), (92, "http://one.test/", "<p>alone <b>here</b><script>x</script>")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    assert got[7] == f"Title 7\nBody & text {'word ' * 30}7".replace("  ", " ")
    assert (got[90], got[91], got[92]) == ("", "", "alone here")
    assert extract_text(pages.limit(0)).count() == 0
    assert main_text("<div><p>a<p>b</div>", [], set()) == "a\nb"


def test_page_text_of_deep_pages_with_long_class_lists(spark):
    names = "flex w-1/2 min-h-screen items-center justify-between text-gray-700 px-4 py-2 rounded-lg shadow-md"
    tags = ["html", "body", "div", "main", "div", "article", "section", "div"]
    opened = "".join(f"<{t} class='{names}'>" for t in tags)
    closed = "".join(f"</{t}>" for t in reversed(tags))

    def page(i):
        parts = (f"<p class='{names}'>part {i} {k} {'word ' * 20}</p>" for k in range(3))
        return f"{opened}{''.join(parts)}<blockquote class='{names}'><p>quoted {i}</p></blockquote>{closed}"

    rows = [(i, f"http://deep.test/{i}", page(i)) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    assert got == {
        i: "\n".join([*(f"part {i} {k}" + " word" * 20 for k in range(3)), f"quoted {i}"]) for i in range(6)
    }


def test_page_text_of_small_hosts_and_two_layouts(spark):
    def page(i):
        if i % 4:
            return f"<body><div class=a><p>Old notice.</p><p>first {i}</p><p>first more {i}</p></div></body>"
        again = "".join(f"<section><p>Reply</p><p>says {i} {k}</p></section>" for k in range(1 + i % 3))
        return f"<body><div class=b><p>New notice.</p>{again}<p>twice</p><p>twice</p></div></body>"

    rows = [(i, f"http://two.test/{i}", page(i)) for i in range(19)]
    rows += [(100 + i, f"http://same.test/{i}", "<body><p>all copies</p></body>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    for i in range(19):
        again = [f"says {i} {k}" for k in range(1 + i % 3)]
        assert got[i].split("\n") == ([f"first {i}", f"first more {i}"] if i % 4 else [*again, "twice", "twice"])
    assert {got[100 + i] for i in range(5)} == {"all copies"}


@pytest.mark.parametrize("names", ["no-sidebar", "single has-sidebar", "sidebar", "content with-sidebar", "widget-text"])
def test_page_text_is_not_dropped_for_its_names(names):
    text = "".join(f"<p>part {i} has some words</p>" for i in range(4))
    wanted = "\n".join(["Title", *(f"part {i} has some words" for i in range(4))])
    for tag in ("body", "div", "article", "main"):
        assert main_text(f"<{tag} class='{names}'><h1>Title</h1><div><div>{text}</div></div></{tag}>", [], []) == wanted
    inner = f"<article><div class='entry-header'><h1>Title</h1></div><div class='{names}'>{text}</div></article>"
    assert main_text(f"<body>{inner}<div class='sidebar'>aside</div></body>", [], []) == wanted
    assert main_text(f"<div class='widget'>{inner}</div><p>{'outside ' * 40}</p>", [], []).startswith(wanted)


def test_page_text_keeps_a_small_sibling_of_the_largest_box():
    page = f"<body><h1>Title</h1><div>{'<p>many words here</p>' * 9}</div><div><p>last part</p></div></body>"
    assert main_text(page, [], []).split("\n") == ["Title", *["many words here"] * 9, "last part"]


# Quality


def test_quality_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.col("doc_id") % 4 == 0
    model = quality.train(docs, labels.where(~held))
    assert list(model.thresholds) == sorted(model.thresholds)
    scored = quality.score_documents(docs, model).join(labels.where(held), "doc_id").toPandas()
    kept = scored.p_good >= quality.KEEP_AT
    clean = (scored.quality == 1) & (scored.toxic == 0)
    assert kept[clean].mean() > 0.99
    assert kept[~clean].mean() < 0.06
    assert kept[scored.toxic == 1].mean() < 0.06
    assert ((scored.p_not_toxic + scored.p_good) - scored.expected_grade).abs().max() < 1e-9
    assert (scored.p_not_toxic >= scored.p_good).all()


def test_quality_of_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame(
        [(4, 1, 0), (5, 0, 0), (5, 1, 0), (8, 1, 1), (99, 1, 0), (None, 1, 0), (9, None, None)],
        "doc_id long, quality int, toxic int",
    )
    model = quality.train(docs, labels)
    assert quality.score_documents(docs, model).count() == len(TEXTS)
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.train(docs, labels.limit(0)) is None
    assert quality.keep_good(docs, None).count() == len(TEXTS)
    assert quality.score_documents(docs, None).count() == len(TEXTS)
    assert quality.score_documents(documents(spark, []), model).count() == 0


# The pipeline


def test_pipeline_stages_equal_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf_dir)
        rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        got = sorted(r.doc_id for r in after.select("doc_id").collect())
        if name == "exact_duplicates":
            assert got == sorted(r[0] for r in plain_duplicates(rows) if r[3])
        elif name == "near_duplicates":
            assert got == sorted(r[0] for r in plain_components(rows) if r[0] == r[2])
        elif name == "decontamination":
            assert got == sorted(r[0] for r in plain_hits(rows, benchmark) if not r[5])
        elif name == "pieces":
            assert got == sorted(r[0] for r in rows)
            texts = dict(rows)
            for r in after.collect():
                assert r.decoded_sha256 == sha256(texts[r.doc_id].encode()).hexdigest()
        if name != "pieces":
            assert after.columns == docs.columns
            before = spark.createDataFrame(after.collect(), docs.schema)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == got
