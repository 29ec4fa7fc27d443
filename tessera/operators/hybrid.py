"""Fusion, near-duplicate collapse, reranking and diversity of ranked lists.

A ranked list is bounded by the limits of its arms (20 rows per query by
default), whatever the corpus size, so per-query groups stay small here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.index import LexicalIndex, fetch_chunks
from tessera.operators.lexical import bm25_candidates, judge_candidates, query_shape
from tessera.operators.semantic import Embedder, embed_queries, hydrate, knn_topk
from tessera.session import CANDIDATE_ROWS, fits, materialize

# --- fixed values -----------------------------------------------------------
RRF_K = 60
LEXICAL_LIMIT = 10
SEMANTIC_LIMIT = 10
RERANK_LIMIT = 10
MAX_PER_DOCUMENT = 2
RESULT_LIMIT = 8
NEAR_DUPLICATE_TOKENS = 12
NEAR_DUPLICATE_OVERLAP = 0.9
# ----------------------------------------------------------------------------

# (query, text) -> score, a pandas UDF.
Scorer = Callable[[Column, Column], Column]

DESCRIPTION = (
    "document_id",
    "chunk_index",
    "stable_id",
    "source_path",
    "source_name",
    "title",
    "section_title",
    "page_number",
    "chunk_text_excerpt",
    "chunk_text",
    "embedding_model",
    "embedding_dim",
)
FLAGS = ("exact_title_match", "exact_source_name_match", "phrase_match")


def _renumber(df: DataFrame, *order: Column) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(*order)
    return df.withColumn("final_rank", F.row_number().over(window))


def rrf(lexical: DataFrame, semantic: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of the two arms on (query_id, chunk_id)."""
    joined = lexical.alias("l").join(semantic.alias("s"), ["query_id", "chunk_id"], "full_outer")

    def share(rank: Column) -> Column:
        return F.coalesce(1.0 / (k + rank), F.lit(0.0))

    fused = joined.select(
        "query_id",
        "chunk_id",
        *(F.coalesce(f"l.{c}", f"s.{c}").alias(c) for c in DESCRIPTION),
        F.col("l.lexical_rank").alias("lexical_rank"),
        F.col("l.lexical_score").alias("lexical_score"),
        F.col("s.semantic_rank").alias("semantic_rank"),
        F.col("s.semantic_score").alias("semantic_score"),
        *(F.coalesce(F.col(f"l.{c}"), F.lit(False)).alias(c) for c in FLAGS),
        (share(F.col("l.lexical_rank")) + share(F.col("s.semantic_rank"))).alias("fusion_score"),
        F.lit(None).cast("double").alias("reranker_score"),
    )
    return _renumber(
        fused,
        F.desc("fusion_score"),
        F.desc(F.coalesce("lexical_score", F.lit(0.0))),
        F.desc(F.coalesce("semantic_score", F.lit(0.0))),
        F.asc_nulls_last("lexical_rank"),
        F.asc("semantic_rank"),
    )


def near_duplicate(a: Column, b: Column) -> Column:
    """Same-document test on structs with stable_id, body, words, word_count."""
    shared = F.size(F.array_intersect(a["words"], b["words"]))
    smaller = F.least(F.size(a["words"]), F.size(b["words"]))
    long_enough = F.least(a["word_count"], b["word_count"]) >= NEAR_DUPLICATE_TOKENS
    overlap = F.coalesce(F.try_divide(shared, smaller), F.lit(0.0))
    same_id = F.coalesce((a["stable_id"] == b["stable_id"]) & (a["stable_id"] != ""), F.lit(False))
    return (
        same_id
        | (a["body"] == b["body"])
        | (long_enough & (overlap >= NEAR_DUPLICATE_OVERLAP))
    )


def collapse_near_duplicates(ranked: DataFrame) -> DataFrame:
    """Greedy in rank order: a row goes when it repeats a kept row of its document.

    Rows travel inside the per-document list, so the input is read once; a list
    holds at most the rows one query has from one document.
    """
    words = T.similarity_tokens(T.strip(F.col("chunk_text")))
    item = F.struct(
        F.col("final_rank").alias("rank"),
        F.col("stable_id").alias("stable_id"),
        T.strip(F.col("chunk_text")).alias("body"),
        F.array_distinct(words).alias("words"),
        F.size(words).alias("word_count"),
        F.struct(*ranked.columns).alias("row"),
    )
    groups = (
        ranked.select("query_id", "document_id", item.alias("item"))
        .groupBy("query_id", "document_id")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    kept = F.aggregate(
        "items",
        F.slice("items", 1, 0),
        lambda acc, it: F.when(F.exists(acc, lambda a: near_duplicate(a, it)), acc).otherwise(
            F.concat(acc, F.array(it))
        ),
    )
    survivors = groups.select(F.inline(F.transform(kept, lambda i: i["row"])))
    return _renumber(survivors, F.asc("final_rank"))


def anchor_priority() -> Column:
    return (
        F.when(F.col("exact_title_match") | F.col("exact_source_name_match"), 2)
        .when(F.col("phrase_match") & F.col("lexical_rank").eqNullSafe(F.lit(1)), 1)
        .otherwise(0)
    )


def rerank(ranked: DataFrame, q: DataFrame, scorer: Scorer, limit: int = RERANK_LIMIT) -> DataFrame:
    """Scores and re-sorts the first `limit` rows; the rest keep their order.

    The head is cut off before the scorer runs, so a model sees only those rows.
    """
    head = ranked.filter(F.col("final_rank") <= limit).join(
        q.select("query_id", "query_text"), "query_id"
    )
    scored = head.withColumn(
        "reranker_score", scorer(F.col("query_text"), F.col("chunk_text")).cast("double")
    ).drop("query_text")
    tail = ranked.filter(F.col("final_rank") > limit)
    marked = scored.withColumn("in_tail", F.lit(0)).unionByName(
        tail.withColumn("in_tail", F.lit(1))
    )
    in_head = F.col("in_tail") == 0
    return _renumber(
        marked,
        F.asc("in_tail"),
        F.desc(F.when(in_head, anchor_priority())),
        F.desc(F.when(in_head, F.coalesce("reranker_score", F.lit(0.0)))),
        F.desc(F.when(in_head, F.col("fusion_score"))),
        F.asc("final_rank"),
    ).drop("in_tail")


def diversify(
    ranked: DataFrame, limit: int = RESULT_LIMIT, max_per_document: int = MAX_PER_DOCUMENT
) -> DataFrame:
    """Rows beyond the cap of their document come after all others, then the cut."""
    per_document = Window.partitionBy("query_id", "document_id").orderBy("final_rank")
    over = F.row_number().over(per_document) > max_per_document
    return _renumber(
        ranked.withColumn("over_cap", over), F.asc("over_cap"), F.asc("final_rank")
    ).filter(F.col("final_rank") <= limit).drop("over_cap")


def document_breakdown(results: DataFrame, rank: str = "final_rank") -> DataFrame:
    """Rows per document of each result list, in first-seen order."""
    key = F.coalesce(F.col("document_id").cast("string"), F.col("source_path"))
    grouped = results.groupBy("query_id", key.alias("document_key")).agg(
        F.min_by("document_id", rank).alias("document_id"),
        F.min_by("title", rank).alias("title"),
        F.min_by("source_path", rank).alias("source_path"),
        F.count("*").alias("chunk_count"),
        F.min(rank).alias("first_rank"),
    )
    window = Window.partitionBy("query_id").orderBy("first_rank")
    return grouped.withColumn("document_order", F.row_number().over(window)).drop("document_key")


def diagnostics_of(
    q: DataFrame, fused: DataFrame, collapsed: DataFrame, final: DataFrame, max_per_document: int
) -> DataFrame:
    """Counts per stage and query; queries that found nothing get zeros."""

    def stage(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("query_id").agg(F.count("*").alias(name))

    returned = final.groupBy("query_id").agg(
        F.count("*").alias("returned_result_count"),
        F.count_distinct(
            F.coalesce(F.col("document_id").cast("string"), F.col("source_path"))
        ).alias("unique_document_count"),
    )
    counts = (
        q.select("query_id")
        .join(stage(fused, "fused_candidate_count"), "query_id", "left")
        .join(stage(collapsed, "deduped_candidate_count"), "query_id", "left")
        .join(returned, "query_id", "left")
        .na.fill(0)
    )
    fused_n, deduped_n = F.col("fused_candidate_count"), F.col("deduped_candidate_count")
    return counts.select(
        "query_id",
        "fused_candidate_count",
        "deduped_candidate_count",
        F.greatest(fused_n - deduped_n, F.lit(0)).alias("collapsed_same_document_count"),
        deduped_n.alias("reranked_candidate_count"),
        (deduped_n - F.col("returned_result_count")).alias("document_capped_count"),
        F.lit(max_per_document).alias("max_results_per_document"),
        "returned_result_count",
        "unique_document_count",
    )


def texts_of(chunks: DataFrame, candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """The chunks that either arm found, each once."""
    # The comparisons hold for every row: a scan is pruned by a side with a condition only.
    found = (
        candidates.filter("candidate_rank >= 1").select("chunk_id")
        .unionByName(hits.filter("semantic_rank >= 1").select("chunk_id"))
        .distinct()
    )
    return fetch_chunks(chunks, found, fits(found, CANDIDATE_ROWS))


def hybrid_search(
    q: DataFrame,
    index: LexicalIndex,
    vec: DataFrame,
    embedder: Embedder,
    model: str,
    scorer: Scorer,
    lexical_limit: int = LEXICAL_LIMIT,
    semantic_limit: int = SEMANTIC_LIMIT,
    rerank_limit: int = RERANK_LIMIT,
    limit: int = RESULT_LIMIT,
    max_per_document: int = MAX_PER_DOCUMENT,
    diagnostics: bool = False,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Both arms, fusion, collapse, rerank and diversity.

    Both arms find chunk ids first; the texts of all of them are then fetched at once.
    """
    shape = query_shape(q)
    candidates = materialize(bm25_candidates(q, index, lexical_limit, shape))
    hits = materialize(knn_topk(embed_queries(q, embedder), vec, semantic_limit, model))
    texts = materialize(texts_of(index.chunks, candidates, hits))
    lexical = judge_candidates(q, candidates, texts, lexical_limit, shape)
    small = fits(q.select("query_id"), CANDIDATE_ROWS // semantic_limit)
    semantic = hydrate(hits, texts, small)
    # Several steps read the fused rows; they are few per query and stored once,
    # so that neither arm is ever computed again.
    fused = materialize(rrf(lexical, semantic))
    collapsed = materialize(collapse_near_duplicates(fused))
    final = diversify(rerank(collapsed, q, scorer, rerank_limit), limit, max_per_document)
    if not diagnostics:
        return final
    return final, diagnostics_of(q, fused, collapsed, final, max_per_document)
