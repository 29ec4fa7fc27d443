from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import blockjoin
from tessera.operators import semantic as S
from tests.stubs import axes


def vectors(spark, rows, model="m"):
    return spark.createDataFrame(
        [(i, i, model, [float(x) for x in v]) for i, v in rows], schemas.VECTORS
    )


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, document_id long, text string")


@pytest.mark.parametrize(("values", "blocks"), [(1 << 18, 16), (60, 2)])
def test_knn_equals_brute_force(spark, monkeypatch, values, blocks):
    monkeypatch.setattr(blockjoin, "BLOCK_VALUES", values)
    monkeypatch.setattr(blockjoin, "SLICE_BLOCKS", blocks)
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 6)).astype(np.float32)
    data[50:60] = data[10]  # ties
    asked = np.concatenate([data[:20], rng.normal(size=(10, 6)).astype(np.float32)])
    q = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(asked)],
        "query_id long, query_vector array<float>",
    )
    vec = vectors(spark, list(enumerate(data))).repartition(3)
    got = {}
    for r in S.knn_topk(q, vec, 12, "m").orderBy("query_id", "semantic_rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for i, v in enumerate(asked.astype(np.float64)):
        d = ((data.astype(np.float64) - v) ** 2).sum(1)
        assert got[i] == list(np.lexsort((np.arange(300), d))[:12])


def test_equal_query_vectors_are_looked_for_once(spark, monkeypatch):
    asked, nearest = [], S.nearest

    def spy(queries, *rest):
        asked.append(queries.count())
        return nearest(queries, *rest)

    monkeypatch.setattr(S, "nearest", spy)
    rows = [(i, [float(i % 3), 1.0]) for i in range(30)] + [(0, [2.0, 1.0]), (5, None)]
    q = spark.createDataFrame(rows, "query_id long, query_vector array<float>")
    vec = vectors(spark, [(i, [i % 4, i % 2]) for i in range(20)])
    once = S.knn_topk(q, vec, 4, "m").collect()
    monkeypatch.setattr(S, "FEW_DISTINCT", -1)
    assert sorted(once) == sorted(S.knn_topk(q, vec, 4, "m").collect())
    assert asked == [3, 31]


def test_model_filter_comes_before_the_cut(spark):
    both = vectors(spark, [(1, [1, 0, 0])], "a").unionByName(vectors(spark, [(2, [0, 1, 0])], "b"))
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query_id long, query_vector array<float>")
    assert [r.chunk_id for r in S.knn_topk(q, both, 1, "b").collect()] == [2]
    assert S.knn_topk(q, both, 3, "none").collect() == []
    assert S.knn_topk(q.limit(0), both, 3, "a").collect() == []


def test_sync_drops_stale_and_adds_missing(spark):
    ch = chunks(spark, [(1, 1, "widget a"), (2, 1, "socket timeout"), (3, 2, "else")])
    vec = vectors(spark, [(1, [9, 9, 9]), (8, [1, 1, 1])]).unionByName(
        vectors(spark, [(8, [5, 5, 5])], "other")
    )
    got = {
        (r.chunk_id, r.embedding_model): list(r.embedding)
        for r in S.sync_vectors(ch, vec, axes, "m").collect()
    }
    assert got == {
        (1, "m"): [9, 9, 9], (2, "m"): [1, 0, 0], (3, "m"): [0, 0, 1], (8, "other"): [5, 5, 5],
    }
    limited = S.sync_vectors(ch, vec, axes, "m", limit=1)
    assert {r.chunk_id for r in limited.filter("embedding_model = 'm'").collect()} == {1, 2}
    with pytest.raises(ValueError):
        S.sync_vectors(ch, vec, axes, "m", limit=0)


def counting(spark):
    """An embedder that counts the texts it is given."""
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        seen.add(len(text))
        return pd.Series([[float(len(t)), 1.0, 0.0] for t in text])

    return embed, seen


def test_reindex_resumes_in_slices(spark, tmp_path):
    ch = chunks(spark, [(i, 1, f"widget {i}") for i in range(7)]).withColumns(
        {"embedding_model": F.lit(None).cast("string"), "embedding_dim": F.lit(None).cast("int")}
    )
    path = str(tmp_path / "vec")
    first = S.reindex_vectors(ch, path, axes, "m", rebuild=True, limit=3, slice_rows=2)
    report = first.report.first()
    assert (report.indexed_count, report.vector_count, report.remaining_count) == (3, 3, 4)
    assert [(r.slice, r.embedded, r.indexed_count, r.remaining_count) for r in first.progress.collect()] == [
        (1, 2, 2, 1), (2, 1, 3, 0),
    ]
    assert {r.chunk_id: r.embedding_dim for r in first.chunks.collect()} == {
        0: 3, 1: 3, 2: 3, 3: None, 4: None, 5: None, 6: None,
    }
    stopped = S.reindex_vectors(ch, path, axes, "m", until_seconds=0.0, slice_rows=2).report.first()
    assert (stopped.starting_vector_count, stopped.indexed_count) == (3, 2)
    assert stopped.stopped_due_to_time_budget
    told = []
    rest = S.reindex_vectors(ch, path, axes, "m", slice_rows=1, on_slice=lambda row: told.append(row)).report.first()
    assert (rest.vector_count, told[0]["remaining_count"]) == (6, 1)
    last = S.reindex_vectors(ch, path, axes, "m").report.first()
    assert (last.vector_count, last.completion_percentage) == (7, 100.0)
    assert spark.read.parquet(path).groupBy("chunk_id").count().filter("count > 1").isEmpty()


def test_reindex_drops_stale_vectors_first(spark, tmp_path):
    ch = chunks(spark, [(i, 1, "x" * i) for i in range(50)])
    path = str(tmp_path / "vec")
    old = vectors(spark, [(i, [1, 1, 1]) for i in (3, 4, 99)])
    old.unionByName(vectors(spark, [(99, [1, 1, 1])], "other")).write.parquet(path)
    report = S.reindex_vectors(ch, path, axes_of(spark), "m", limit=10).report.first()
    assert (report.starting_vector_count, report.starting_remaining_count) == (2, 48)
    assert (report.vector_count, report.remaining_count, report.completion_percentage) == (12, 38, 24.0)
    assert spark.read.parquet(path).filter("embedding_model = 'other'").count() == 1


def axes_of(spark):
    return counting(spark)[0]


@pytest.mark.parametrize("partitions", [1, 5, 23])
def test_a_limited_sync_embeds_only_what_it_keeps(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rng = np.random.default_rng(partitions)
        ids = [int(i) for i in rng.choice(10**12, 400, replace=False)]
        ch = chunks(spark, [(i, 1, "text") for i in ids])
        embed, seen = counting(spark)
        got = S.sync_vectors(ch, vectors(spark, [(ids[0], [1, 1, 1])]), embed, "m", limit=60)
        found = {r.chunk_id for r in got.collect()} - {ids[0]}
        assert found == set(sorted(set(ids) - {ids[0]})[:60])
        assert seen.value == 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_batches_are_numbered_without_gaps(spark):
    got = S.batch_numbers(chunks(spark, [(i * 7, 1, "") for i in range(25)]), 10)
    assert {r.batch: r["count"] for r in got.groupBy("batch").count().collect()} == {1: 10, 2: 10, 3: 5}


def test_query_vectors_are_checked(spark):
    vec = vectors(spark, [(1, [1, 0, 0])])
    schema = "query_id long, query_vector array<float>"
    ragged = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0] * 5)], schema)
    with pytest.raises(ValueError, match="length"):
        S.knn_topk(ragged, vec, 1)


def test_ragged_chunk_vectors_are_refused(spark):
    schema = "query_id long, query_vector array<float>"
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], schema)
    with pytest.raises(ValueError, match="length"):
        S.knn_topk(q, vectors(spark, [(1, [1, 0, 0]), (2, [1, 0])]), 1)
    with pytest.raises(ValueError, match="length"):
        S.knn_topk(q, vectors(spark, [(1, [1, 0])]), 1)


def test_far_blocks_are_never_paired(spark, monkeypatch):
    monkeypatch.setattr(blockjoin, "BLOCK_VALUES", 40)
    rng = np.random.default_rng(5)
    centres = 100.0 * np.eye(4)[np.arange(240) % 4]
    data = centres + rng.normal(size=(240, 4))
    schema = "id long, vector array<double>"
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], schema)
    shape = blockjoin.Shape(240, 4)
    pivots = blockjoin.choose_pivots(table, shape)
    held = blockjoin.packed(table, shape, pivots)
    homes = blockjoin.home_pairs(held, held, pivots, 3)
    first = blockjoin._first_pass(held, held, homes, pivots, 4, 3)
    total, needed = held.count() ** 2, blockjoin.needed_pairs(first, held).count()
    assert held.count() >= 24 and needed <= total / 3
    got = {}
    for r in blockjoin.nearest(table, table, 3).collect():
        got.setdefault(r.query_id, []).append((r.distance, r.chunk_id))
    for i in range(240):
        d = ((data - data[i]) ** 2).sum(1)
        assert [c for _, c in sorted(got[i])[:3]] == list(np.lexsort((np.arange(240), d))[:3])


def test_repeated_query_ids_end(spark, monkeypatch):
    monkeypatch.setattr(blockjoin, "BLOCK_VALUES", 6)
    rows = [(1, [1.0, 0.0, 0.0])] * 5 + [(2, [0.0, 1.0, 0.0])] * 3
    q = spark.createDataFrame(rows, "query_id long, query_vector array<float>")
    got = S.knn_topk(q, vectors(spark, [(5, [1, 0, 0]), (6, [0, 1, 0])]), 1).collect()
    assert sorted((r.query_id, r.chunk_id) for r in got) == [(1, 5), (2, 6)]


def test_upsert_delete_and_meta(spark):
    vec = vectors(spark, [(1, [1, 1]), (2, [2, 2])])
    new = vectors(spark, [(2, [7, 7]), (3, [3, 3])])
    after = S.upsert_vectors(vec, new)
    assert {r.chunk_id: list(r.embedding) for r in after.collect()} == {1: [1, 1], 2: [7, 7], 3: [3, 3]}
    ids = spark.createDataFrame([(1,), (1,)], "chunk_id long")
    assert {r.chunk_id for r in S.delete_vectors(after, ids, "m").collect()} == {2, 3}
    assert S.delete_vectors(after, ids, "x").count() == 3
    ch = chunks(spark, [(1, 1, "a"), (9, 1, "b")]).withColumns(
        {"embedding_model": F.lit(None).cast("string"), "embedding_dim": F.lit(None).cast("int")}
    )
    twice = vec.unionByName(vectors(spark, [(1, [1, 1, 1])], "n"))
    assert [r.embedding_dim for r in S.with_embedding_meta(ch, twice, "n").filter("chunk_id = 1").collect()] == [3]
    assert S.with_embedding_meta(ch, twice).count() == 2
    meta = {r.chunk_id: (r.embedding_model, r.embedding_dim) for r in S.with_embedding_meta(ch, vec).collect()}
    assert meta == {1: ("m", 2), 9: (None, None)}


def test_blank_query_is_refused(spark):
    q = spark.createDataFrame([(1, "  ")], "query_id long, query_text string")
    with pytest.raises(Exception, match="searchable term"):
        S.embed_queries(q, axes).collect()


def test_equal_vectors_take_no_more_memory():
    import tracemalloc

    from tessera.functions.vectors import Nearest

    same = np.ones((1024, 64))
    ids = np.arange(1024)[::-1].copy()
    tracemalloc.start()
    best = Nearest(same, 3)
    best.offer(ids, same)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    _, found, far = best.results()
    assert found.tolist() == [0, 1, 2] * 1024 and not far.any()
    assert peak < 150e6
