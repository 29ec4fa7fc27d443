from __future__ import annotations

from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import hybrid as H
from tests.stubs import marked_score

NAMES = [f.name for f in schemas.RANKED]


def row(chunk_id, document_id=None, **values):
    base = dict.fromkeys(NAMES)
    base |= {
        "query_id": 1, "chunk_id": chunk_id, "document_id": document_id or chunk_id,
        "chunk_index": 0, "source_path": f"/d/{chunk_id}.md", "source_name": f"{chunk_id}.md",
        "title": "T", "chunk_text": f"text {chunk_id}", "chunk_text_excerpt": "x",
        "exact_title_match": False, "exact_source_name_match": False, "phrase_match": False,
    }
    return tuple((base | values)[n] for n in NAMES)


def table(spark, rows):
    return spark.createDataFrame(rows, schemas.RANKED)


def lexical(spark, ids):
    rows = [row(c, lexical_rank=i, lexical_score=9.0 - i) for i, c in enumerate(ids, 1)]
    return table(spark, rows)


def semantic(spark, ids):
    rows = [row(c, semantic_rank=i, semantic_score=1.0 - i / 10) for i, c in enumerate(ids, 1)]
    return table(spark, rows)


def ids(df):
    return [r.chunk_id for r in df.orderBy("final_rank").collect()]


def test_fusion_merges_and_orders(spark):
    fused = H.rrf(lexical(spark, [1, 2]), semantic(spark, [2, 3]), 10)
    assert ids(fused) == [2, 1, 3]
    top = fused.filter("chunk_id = 2").first()
    assert (top.lexical_rank, top.semantic_rank, top.final_rank) == (2, 1, 1)
    assert abs(top.fusion_score - (1 / 12 + 1 / 11)) < 1e-12


def test_fusion_tie_keeps_the_lexical_row_first(spark):
    assert ids(H.rrf(lexical(spark, [10]), semantic(spark, [20]))) == [10, 20]
    assert ids(H.rrf(lexical(spark, [20]), semantic(spark, [10]))) == [20, 10]


def test_near_duplicates_of_one_document_collapse(spark):
    words = "socket timeout startup checks local indexing guide repeated for troubleshooting and validation"
    rows = [
        row(1, 5, chunk_text=words, final_rank=1),
        row(2, 5, chunk_text=words + " today", final_rank=2),
        row(3, 6, chunk_text=words, final_rank=3),
        row(4, 6, chunk_text=" " + words + "\n", final_rank=4),
        row(5, 6, chunk_text="short one", stable_id="s", final_rank=5),
        row(6, 6, chunk_text="short two", stable_id="s", final_rank=6),
        row(7, 6, chunk_text="short one more", final_rank=7),
    ]
    kept = H.collapse_near_duplicates(table(spark, rows))
    assert ids(kept) == [1, 3, 5, 7]
    assert [r.final_rank for r in kept.orderBy("final_rank").collect()] == [1, 2, 3, 4]


def test_rerank_sorts_the_head_only(spark):
    q = spark.createDataFrame([(1, "q")], "query_id long, query_text string")
    rows = [
        row(1, chunk_text="score=0.2", fusion_score=0.3, final_rank=1),
        row(2, chunk_text="score=0.9", fusion_score=0.2, final_rank=2),
        row(3, chunk_text="score=9", fusion_score=0.1, final_rank=3),
    ]
    done = H.rerank(table(spark, rows), q, marked_score, 2)
    assert ids(done) == [2, 1, 3]
    assert done.filter("chunk_id = 3").first().reranker_score is None


def test_exact_matches_stay_on_top_of_the_reranker(spark):
    q = spark.createDataFrame([(1, "q")], "query_id long, query_text string")
    rows = [
        row(1, chunk_text="score=0.9", fusion_score=0.3, final_rank=1),
        row(2, chunk_text="score=0.1", fusion_score=0.2, final_rank=2, exact_title_match=True),
        row(3, chunk_text="score=0.2", fusion_score=0.1, final_rank=3, phrase_match=True, lexical_rank=1),
        row(4, chunk_text="score=0.3", fusion_score=0.1, final_rank=4, phrase_match=True, lexical_rank=2),
    ]
    assert ids(H.rerank(table(spark, rows), q, marked_score)) == [2, 3, 1, 4]


def test_soft_cap(spark):
    rows = [row(i, d, final_rank=i) for i, d in ((1, 7), (2, 7), (3, 7), (4, 8))]
    assert ids(H.diversify(table(spark, rows), 4, 2)) == [1, 2, 4, 3]
    assert ids(H.diversify(table(spark, rows), 2, 1)) == [1, 4]
    assert ids(H.diversify(table(spark, rows), 0, 1)) == []


def test_breakdown_in_first_seen_order(spark):
    rows = [row(i, d, final_rank=i) for i, d in ((1, 7), (2, 8), (3, 7))]
    got = H.document_breakdown(table(spark, rows)).orderBy("document_order").collect()
    assert [(r.document_id, r.chunk_count) for r in got] == [(7, 2), (8, 1)]


def test_collapse_plan_reads_its_input_once(spark):
    ranked = table(spark, [row(1, final_rank=1)]).withColumn("n", F.rand())
    plan = H.collapse_near_duplicates(ranked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rand(") == 1
