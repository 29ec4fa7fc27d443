from __future__ import annotations

import json
import os

import pytest

from tessera.operators import evaluation as E
from tessera.operators.index import build_index
from tessera.plans.ingest import ingest
from tessera.plans.search import Backends, ask, inspect, search
from tessera.plans.state import dense_ids, empty_state, read_state, write_state
from tessera.sources.artifacts import complete_golden, read_golden, write_case_bundles, write_report
from tessera.sources.files import doc_type, scan_files
from tests.stubs import axes, length_score
from pyspark.sql import functions as F


def write(folder, files):
    for name, content in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())


def counts(result):
    return {k: v for k, v in result.run.first().asDict().items()}


class Steps:
    """Runs ingest after ingest, each from the snapshot the last one wrote."""

    def __init__(self, spark, tmp_path):
        self.spark, self.base, self.n = spark, tmp_path, 0
        self.state = empty_state(spark)

    def run(self, roots, **options):
        result = ingest(self.spark, [str(r) for r in roots], self.state, **options)
        if not options.get("dry_run"):
            self.n += 1
            write_state(result.state, str(self.base / f"state-{self.n}"))
            self.state = read_state(self.spark, str(self.base / f"state-{self.n}"))
        return result


@pytest.fixture
def steps(spark, tmp_path):
    return Steps(spark, tmp_path)


def test_scan_keeps_wanted_files_once(spark, tmp_path):
    write(tmp_path, {"a.TXT": "x", "sub/b.md": "y", "c.bin": "z", "d.pdf": "p"})
    roots = [str(tmp_path), str(tmp_path / "sub"), str(tmp_path) + "/", str(tmp_path / "none")]
    names = sorted(os.path.basename(r.path) for r in scan_files(spark, roots).collect())
    assert names == ["a.TXT", "b.md", "d.pdf"]
    only = scan_files(spark, [str(tmp_path / "sub" / "b.md")]).collect()
    assert [r.path for r in only] == [str(tmp_path / "sub" / "b.md")]
    assert scan_files(spark, [str(tmp_path / "none")]).count() == 0
    one = spark.range(1)
    kinds = [one.select(doc_type(F.lit(p))).first()[0] for p in ("/x.HTM", "/y.md", "/z.bin", "/txt")]
    assert kinds == ["html", "markdown", None, None]
    with pytest.raises(Exception, match="Unsupported file type"):
        one.select(doc_type(F.lit("/z.bin"), strict=True)).collect()


def test_all_kinds_and_failures(spark, tmp_path, steps):
    src = tmp_path / "src"
    write(
        src,
        {
            "a.md": "# Markdown Fixture\n\n## Details\n\n- one\n",
            "b.txt": "Plain title\n\nbody",
            "c.html": "<html><head><title>Page</title></head><body><nav>N</nav>"
            "<main><h1>Head</h1><p>kept</p></main></body></html>",
            "d.pdf": "%PDF",
            "e.pdf": "broken",
            "f.txt": b"\xff\xfe bad",
        },
    )
    pages = spark.createDataFrame(
        [(str(src / "d.pdf"), 2, "second"), (str(src / "d.pdf"), 1, "Hello PDF World")],
        "source_path string, page_number int, text string",
    )
    first = steps.run([src], pages=pages)
    assert counts(first) == {
        "docs_seen": 6, "docs_added": 6, "docs_updated": 0, "docs_unchanged": 0,
        "docs_deleted": 0, "docs_failed": 2,
    }
    docs = {os.path.basename(r.source_path): r for r in steps.state.documents.collect()}
    assert {n: d.title for n, d in docs.items()} == {
        "a.md": "Markdown Fixture", "b.txt": "Plain title", "c.html": "Page",
        "d.pdf": "Hello PDF World", "e.pdf": "e", "f.txt": "f",
    }
    assert docs["f.txt"].parse_error.startswith("UnicodeDecodeError")
    assert docs["e.pdf"].parse_status == "failed"
    assert sorted(d.document_id for d in docs.values()) == [1, 2, 3, 4, 5, 6]
    paged = steps.state.chunks.filter(f"document_id = {docs['d.pdf'].document_id}")
    assert [r.page_number for r in paged.orderBy("chunk_index").collect()] == [1, 2]
    # Failed files are tried again although their content did not change.
    again = steps.run([src], pages=pages)
    assert (counts(again)["docs_unchanged"], counts(again)["docs_failed"]) == (6, 2)
    report = {os.path.basename(r.source_path): r for r in again.documents.collect()}
    assert report["a.md"].preserved_chunk_count == 1 and report["a.md"].new_chunk_count == 0
    assert steps.state.runs.count() == 2


def test_changed_chunk_is_replaced_and_others_kept(spark, tmp_path, steps):
    src = tmp_path / "src"
    parts = [" ".join([w] * n) for w, n in (("alpha", 400), ("beta", 400), ("tail", 50))]
    write(src, {"doc.txt": "\n\n".join(parts), "gone.txt": "old text", "same.txt": "same text"})
    steps.run([src], embedder=axes, model="m")
    before = {r.stable_id: r for r in steps.state.chunks.collect()}
    assert steps.state.vectors.count() == len(before)
    assert all(r.embedding_model == "m" and r.embedding_dim == 3 for r in before.values())

    write(src, {"doc.txt": "\n\n".join([parts[0], parts[1].replace("beta", "gamma"), parts[2]])})
    os.remove(src / "gone.txt")
    preview = steps.run([src], embedder=axes, model="m", dry_run=True)
    second = steps.run([src], embedder=axes, model="m")
    assert counts(preview) == counts(second) == {
        "docs_seen": 2, "docs_added": 0, "docs_updated": 1, "docs_unchanged": 1,
        "docs_deleted": 1, "docs_failed": 0,
    }
    shown = {os.path.basename(r.source_path): r for r in second.documents.collect()}
    doc = shown["doc.txt"]
    assert (doc.preserved_chunk_count, doc.new_chunk_count, doc.removed_chunk_count) == (1, 1, 1)
    after = {r.stable_id: r for r in steps.state.chunks.collect()}
    shared = before.keys() & after.keys()
    assert {after[s].chunk_id for s in shared} == {before[s].chunk_id for s in shared}
    new = [r for s, r in after.items() if s not in before]
    assert len(new) == 1 and new[0].chunk_id not in {r.chunk_id for r in before.values()}
    assert {r.chunk_id for r in steps.state.vectors.collect()} == {r.chunk_id for r in after.values()}
    assert all(r.embedding_model == "m" for r in after.values())
    assert not any("gone" in r.source_path for r in steps.state.documents.collect())
    assert [os.path.basename(r.source_path) for r in second.deleted.collect()] == ["gone.txt"]


def test_file_that_breaks_loses_its_chunks_and_keeps_its_title(spark, tmp_path, steps):
    src = tmp_path / "src"
    write(src, {"a.txt": "Old title\n\nbody", "b.txt": "Other"})
    steps.run([src], embedder=axes)
    write(src, {"a.txt": b"\xff\xff"})
    steps.run([src], embedder=axes)
    doc = steps.state.documents.filter("parse_status = 'failed'").first()
    assert doc.title == "Old title"
    assert steps.state.chunks.filter(f"document_id = {doc.document_id}").isEmpty()
    assert steps.state.vectors.count() == steps.state.chunks.count() == 1


def test_only_documents_below_the_roots_are_deleted(spark, tmp_path, steps):
    write(tmp_path, {"one/a.txt": "a", "onetwo/b.txt": "b"})
    steps.run([tmp_path / "one", tmp_path / "onetwo"])
    os.remove(tmp_path / "one/a.txt")
    os.remove(tmp_path / "onetwo/b.txt")
    result = steps.run([tmp_path / "one"])
    assert counts(result)["docs_deleted"] == 1
    assert steps.state.documents.count() == 1


def test_dense_ids_are_gapless_and_stable(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    a, b = (dense_ids(df.repartition(n), "key", "n", 10).orderBy("n").collect() for n in (1, 3))
    assert [r.n for r in a] == list(range(10, 510)) and a == b


def test_ingest_keeps_the_index(spark, tmp_path):
    root = tmp_path / "hut"
    write(root, {"a.md": "# Alpha\n\nrope and axe\n", "b.txt": "tea and bread\n"})
    first = ingest(spark, [str(root)], empty_state(spark))
    index = build_index(first.state.chunks, first.state.documents)
    write(root, {"a.md": "# Alpha\n\nrope and lamp\n", "c.txt": "snow\n"})
    os.remove(root / "b.txt")
    second = ingest(spark, [str(root)], first.state, index=index)
    fresh = build_index(second.state.chunks, second.state.documents)

    def words(i):
        return {r.token: r.chunk_count for r in i.vocabulary.collect()}

    assert words(second.index) == words(fresh) and "tea" not in words(fresh)
    assert second.index.stats.first() == fresh.stats.first()
    assert second.index.postings.count() == fresh.postings.count()
    q = spark.createDataFrame([(1, "lamp"), (2, "bread")], "query_id long, query_text string")
    assert [r.query_id for r in search(q, "lexical", Backends(second.index)).collect()] == [1]
    # An index that misses chunks is built anew.
    empty = build_index(first.state.chunks.limit(0), first.state.documents)
    assert words(ingest(spark, [str(root)], first.state, index=empty).index) == words(fresh)


def test_search_can_sync_first(spark, tmp_path):
    write(tmp_path / "s", {"a.txt": "widget\n"})
    state = ingest(spark, [str(tmp_path / "s")], empty_state(spark)).state
    backends = Backends(build_index(state.chunks, state.documents), state.vectors, axes, "m")
    q = spark.createDataFrame([(1, "widget")], "query_id long, query_text string")
    assert search(q, "semantic", backends).count() == 0
    assert search(q, "semantic", backends, sync=True).count() == 1


# Golden corpus: a few notes of a mountain hut and queries on them, end to end --------------

NOTES = {
    "stove_care.md": "# Stove Care\n\n## Lighting\n\n"
    "Open the damper before a match is struck, or smoke fills the room.\n"
    "Ash is carried out every second morning.\n",
    "water_tank.md": "# Water Tank\n\n## Winter\n\n"
    "The tank holds six hundred litres.\nEmpty the pipe each evening when frost is forecast.\n",
    "guest_book.md": "# Guest Book\n\n## Entries\n\n"
    "Every party writes its route, its size and the weather before leaving each morning.\n",
}
CASES = [
    {"id": "smoke", "query": "damper before a match", "relevant_sources": ["stove_care.md"],
     "relevant_chunk_substrings": ["open the damper before a match"],
     "required_citation_sources": ["stove_care.md"]},
    {"id": "name", "query": "Stove Care", "relevant_sources": ["stove_care.md"],
     "relevant_chunk_substrings": [], "expected_top_source": "stove_care.md"},
    {"id": "frost", "query": "pipe each evening frost", "relevant_sources": ["water_tank.md"],
     "relevant_chunk_substrings": ["six hundred litres"]},
    {"id": "route", "query": "party writes route and weather", "relevant_sources": ["guest_book.md"]},
    {"id": "spread", "query": "morning", "min_unique_sources_at_k": 2,
     "relevant_sources": ["stove_care.md", "guest_book.md"]},
]


@pytest.fixture(scope="module")
def golden_run(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("golden")
    write(base / "corpus", NOTES)
    (base / "golden.json").write_text(json.dumps(CASES))
    result = ingest(spark, [str(base / "corpus")], empty_state(spark), axes, "m")
    write_state(result.state, str(base / "state"))
    state = read_state(spark, str(base / "state"))
    index = build_index(state.chunks, state.documents)
    golden = read_golden(spark, str(base / "golden.json"))
    q = golden.select("query_id", F.col("query").alias("query_text"))
    return golden, q, Backends(index, state.vectors, axes, "m", length_score)


@pytest.mark.parametrize("mode", ["lexical", "semantic", "hybrid"])
def test_golden_retrieval_metrics(golden_run, mode, tmp_path):
    golden, q, backends = golden_run
    results = search(q, mode, backends, 3)
    rows, report = E.evaluate_retrieval(results, golden, 3, mode)
    got = report.first()
    assert (got.query_count, got.hit_at_k) == (5, 1.0)
    assert got.source_diversity_at_k == 1.0
    if mode == "lexical":
        assert (got.recall_at_k, got.mrr, got.top_source_at_1) == (1.0, 1.0, 1.0)
    bundles = E.case_bundles(results, rows, ["name"], mode, 3)
    write_case_bundles(bundles, str(tmp_path / "b"), ["name"], rows)
    assert os.listdir(tmp_path / "b" / "case=name")
    with pytest.raises(ValueError, match="nope"):
        write_case_bundles(bundles, str(tmp_path / "c"), ["nope"], rows)
    write_report(report, str(tmp_path / "r"))
    text = golden.sparkSession.read.text(str(tmp_path / "r")).first()[0]
    assert list(json.loads(text)) == sorted(json.loads(text))


def test_inspect_and_ask(spark, golden_run):
    from catalog.queries import first_label_generator

    golden, q, backends = golden_run
    seen = inspect(q, backends)
    for d in seen.diagnostics.collect():
        assert d.fused_candidate_count == 3 >= d.returned_result_count == d.unique_document_count
    answers = ask(q, backends, first_label_generator)
    assert {r.cited_chunk_count for r in answers.collect()} == {2}
    cases = E.evaluate_answers(answers, complete_golden(golden))
    smoke = cases.filter("case_id = 'smoke'").first()
    assert not smoke.answer_declined
    strict = golden.withColumn("answer_should_decline", F.lit(True)).withColumn(
        "required_answer_substrings", F.array(F.lit("zebra"), F.lit("EVIDENCE"))
    )
    bad = E.evaluate_answers(answers, strict).filter("case_id = 'smoke'").first()
    assert bad.expectation_failures[0] == E.EXPECTED_DECLINE
    assert E.MISSING_TEXT + "zebra" in bad.expectation_failures and not bad.passed


def test_search_modes_check_their_needs(spark, golden_run):
    _, q, backends = golden_run
    assert search(q, "hybrid", Backends()).count() == 0
    with pytest.raises(ValueError):
        search(q, "semantic", Backends(backends.index, backends.vectors))
    with pytest.raises(ValueError):
        search(q, "hybrid", Backends(backends.index, backends.vectors, axes, "m"))
    with pytest.raises(ValueError):
        search(q, "other", backends)
