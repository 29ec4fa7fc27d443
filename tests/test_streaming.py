from __future__ import annotations

import pytest

from catalog.corpus import write_texts
from tessera.plans.state import SnapshotLog
from tessera.streaming.jobs import (
    copy_events,
    ingest_stream,
    number_stream,
    numbered_events,
    stream_events,
)
from tests.test_ingest import write


def arrive(spark, tmp_path, log, files=None, **options):
    if files:
        write(tmp_path / "in", files)
    ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "cp"), log, **options).awaitTermination()


def test_new_files_are_ingested_without_deletions(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path / "log"))
    assert log.latest().documents.isEmpty()
    arrive(spark, tmp_path, log, {"a.txt": "first"})
    arrive(spark, tmp_path, log, {"b.md": "# second", "c.bin": "x"})
    assert log.entries().count() == 2
    assert sorted(r.title for r in log.latest().documents.collect()) == ["first", "second"]
    assert log.latest().chunks.count() == 2


def test_a_replayed_batch_takes_effect_once(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path / "log"))
    arrive(spark, tmp_path, log, {"a.txt": "first"})
    arrive(spark, tmp_path, log, {"b.txt": "second"})
    # The checkpoint forgets that the last batch was done, as after a failure before its commit.
    for name in ("1", ".1.crc"):
        (tmp_path / "cp" / "commits" / name).unlink()
    arrive(spark, tmp_path, log)
    assert [r.run_id for r in log.latest().runs.orderBy("run_id").collect()] == [1, 2]
    assert log.latest().documents.count() == 2 and log.entries().count() == 2


def test_a_batch_that_failed_before_its_commit_is_done_again(spark, tmp_path):
    class Failing(SnapshotLog):
        def commit(self, state, source, batch_id):
            raise RuntimeError("lost")

    folder = str(tmp_path / "log")
    with pytest.raises(Exception, match="lost"):
        arrive(spark, tmp_path, Failing(spark, folder), {"a.txt": "first"})
    log = SnapshotLog(spark, folder)
    # A commit cut short leaves an entry without a file.
    (tmp_path / "log" / "ledger" / "1" / "_temporary").mkdir(parents=True)
    arrive(spark, tmp_path, log)
    assert [r.docs_added for r in log.latest().runs.collect()] == [1]
    assert [r.title for r in log.latest().documents.collect()] == ["first"]


def test_files_of_one_arrival_may_be_several_batches(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path / "log"))
    arrive(spark, tmp_path, log, {f"{i}.txt": f"text {i}" for i in range(3)}, files_per_batch=2)
    runs = log.latest().runs.orderBy("run_id").collect()
    assert [(r.run_id, r.docs_added) for r in runs] == [(1, 2), (2, 1)]
    assert log.latest().documents.select("document_id").distinct().count() == 3


def test_event_numbers_go_on_over_runs_and_replays(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("log", "out", "cp"))
    # Job 1 is busy within one hour; the second run has late events, a new job and a null one.
    first = [(i, 1 if i % 4 else 2, f"2026-01-01 10:{i % 60:02d}:00") for i in range(200)]
    second = [(200 + i, (1, 2, 3, None)[i % 4], "2026-01-01 09:00:00") for i in range(40)]
    schema = "id long, job_id long, t string"

    def run(rows):
        if rows:
            spark.createDataFrame(rows, schema).selectExpr(
                "id", "job_id", "CAST(t AS TIMESTAMP) AS created_at"
            ).write.mode("append").parquet(source)
        events = stream_events(spark, source, spark.read.parquet(source).schema, 100)
        number_stream(events, target, checkpoint).awaitTermination()
        return {r.id: r.sequence for r in numbered_events(spark, target).collect()}

    def plain(*batches):
        out, last = {}, {}
        for rows in batches:
            for i, job, _ in sorted(rows, key=lambda r: (r[2], r[0])):
                out[i] = last[job] = last.get(job, 0) + 1
        return out

    assert run(first) == plain(first)
    assert run(second) == plain(first, second)
    for name in ("1", ".1.crc"):
        (tmp_path / "cp" / "commits" / name).unlink()
    assert run(None) == plain(first, second)
    assert numbered_events(spark, target).count() == 240


def test_event_tail_delivers_each_event_once(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id AS id", "user_id AS job_id", "0L AS sequence", "ts AS created_at",
        "event_type", "props AS payload_json",
    )
    source, target = str(tmp_path / "log"), str(tmp_path / "out")
    for low, high in ((0, 400), (400, 1000)):
        events.filter(f"id >= {low} AND id < {high}").write.mode("append").parquet(source)
        copy_events(stream_events(spark, source), target, str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(target).count() == high
    assert spark.read.parquet(target).select("id").distinct().count() == 1000


def test_listed_files_are_ingested_without_a_listing_in_the_driver(spark, tmp_path):
    """What a table names is read by path in tasks; a file that it does not name is not looked for."""
    log, place, listing = SnapshotLog(spark, str(tmp_path / "log")), str(tmp_path / "in"), str(tmp_path / "listing")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string")
    for part in ("doc_id < 3", "doc_id >= 3"):
        write_texts(docs.where(part), place, listing)
        (tmp_path / "in" / "unlisted.txt").write_text("unlisted")
        ingest_stream(spark, place, str(tmp_path / "cp"), log, 1000, listing).awaitTermination()
    runs = log.latest().runs.orderBy("run_id").collect()
    assert [(r.run_id, r.docs_added) for r in runs] == [(1, 3), (2, 2)]
    assert sorted(r.title for r in log.latest().documents.collect()) == [f"text {i}" for i in range(5)]
