"""Embedding tables: exact k-nearest search and index upkeep."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as T
from tessera.operators.blockjoin import nearest
from tessera.operators.index import fetch_chunks
from tessera.operators.lexical import top_k
from tessera.plans.state import dense_ids
from tessera.session import BROADCAST_ROWS, CANDIDATE_ROWS, fits, hint_small, materialize
from tessera.sources.files import root_exists
from tessera.sources.tables import replace_folder, upsert

# A pandas UDF: text -> array<float>.
Embedder = Callable[[Column], Column]

EDGE_CELLS = 4096
# Share of distinct vectors up to which equal query vectors are looked for once.
FEW_DISTINCT = 0.5


def knn_topk(queries: DataFrame, vec: DataFrame, k: int, model: str | None = None) -> DataFrame:
    """Exact nearest `k` chunks per query: (query_id, chunk_id, distance, semantic_rank).

    `queries` has (query_id, query_vector); rows given twice count once, and several vectors
    of one query id share its `k` places.  Both tables are joined in blocks, see `blockjoin`.
    Where few query vectors are distinct, each is looked for once.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if model is not None:
        vec = vec.filter(F.col("embedding_model") == model)
    # Stored, as several steps read them and a model made them.
    asked = materialize(
        queries.select(F.col("query_id").cast("long").alias("id"), F.col("query_vector").alias("vector"))
        .where("vector IS NOT NULL").distinct()
    )
    vectors = vec.select(F.col("chunk_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    size = asked.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("vector")).alias("distinct")).first()
    if size.distinct > FEW_DISTINCT * size.n:
        found = nearest(asked, vectors, k)
    else:
        numbered = materialize(asked.select("vector").distinct().withColumn("number", F.monotonically_increasing_id()))
        few = size.distinct <= BROADCAST_ROWS // 10
        named = materialize(asked.join(hint_small(numbered, few), "vector").select("id", "number"))
        once = nearest(numbered.select(F.col("number").alias("id"), "vector"), vectors, k)
        once = top_k(once, k, ["query_id"], [F.asc("distance"), F.asc("chunk_id")], "place")
        once = materialize(once.select(F.col("query_id").alias("number"), "chunk_id", "distance"))
        found = named.join(hint_small(once, few), "number").select(
            F.col("id").alias("query_id"), "chunk_id", "distance"
        )
    return top_k(found, k, ["query_id"], [F.asc("distance"), F.asc("chunk_id")], "semantic_rank")


def hydrate(hits: DataFrame, chunks: DataFrame, small: bool) -> DataFrame:
    """Hits with their chunk rows, in hit order; unknown chunks are dropped."""
    rows = fetch_chunks(chunks, hits, small)
    ranked = top_k(
        rows, 2**31 - 1, ["query_id"], [F.asc("semantic_rank")], "semantic_rank_"
    )
    return ranked.select(
        "query_id",
        "chunk_id",
        "document_id",
        "chunk_index",
        "stable_id",
        "source_path",
        "source_name",
        "title",
        "section_title",
        "page_number",
        T.excerpt(F.col("text")).alias("chunk_text_excerpt"),
        F.col("text").alias("chunk_text"),
        "embedding_model",
        "embedding_dim",
        T.distance_to_score(F.col("distance")).alias("semantic_score"),
        F.col("semantic_rank_").alias("semantic_rank"),
    )


def embed_queries(q: DataFrame, embedder: Embedder) -> DataFrame:
    """(query_id, query_vector); blank queries are refused."""
    text = F.col("query_text")
    message = F.lit("Query must contain at least one searchable term.")
    checked = F.when(T.strip(text) != "", text).otherwise(F.raise_error(message).cast("string"))
    return q.select("query_id", embedder(checked).alias("query_vector"))


def semantic_search(
    q: DataFrame,
    vec: DataFrame,
    chunks: DataFrame,
    embedder: Embedder,
    model: str,
    limit: int = 8,
) -> DataFrame:
    """Ranked chunks per query by distance to the embedded query; reads only."""
    hits = knn_topk(embed_queries(q, embedder), vec, limit, model)
    small = fits(q.select("query_id"), CANDIDATE_ROWS // limit)
    return hydrate(hits, chunks, small)


# Index upkeep ---------------------------------------------------------------


def embed_chunks(
    ch: DataFrame, embedder: Embedder, model: str, ids: DataFrame | None = None
) -> DataFrame:
    """Vectors of the chunk table, or of the chunks named in `ids`, each once.

    The chunk table has one row per id, so texts are never shuffled to find
    repeats; repeats in `ids` vanish in the semi-join.
    """
    if ids is not None:
        ch = ch.join(ids.select("chunk_id"), "chunk_id", "left_semi")
    return ch.select(
        "chunk_id",
        "document_id",
        F.lit(model).alias("embedding_model"),
        embedder(F.col("text")).cast("array<float>").alias("embedding"),
    )


def check_embedded(wanted: DataFrame, vec: DataFrame) -> None:
    """Fails unless there is one vector per wanted chunk."""
    asked, made = wanted.select("chunk_id").distinct().count(), vec.count()
    if asked != made:
        raise RuntimeError(f"{made} vectors were made for {asked} chunks")


def missing_chunks(ch: DataFrame, vec: DataFrame, model: str) -> DataFrame:
    known = vec.filter(F.col("embedding_model") == model).select("chunk_id")
    return ch.join(known, "chunk_id", "left_anti")


def stale_vectors(ch: DataFrame, vec: DataFrame, model: str) -> DataFrame:
    return vec.filter(F.col("embedding_model") == model).join(
        ch.select("chunk_id"), "chunk_id", "left_anti"
    )


def delete_vectors(vec: DataFrame, ids: DataFrame, model: str | None = None) -> DataFrame:
    """Vectors without those of `ids` (chunk_id), of one model or of all."""
    gone = ids.select("chunk_id").distinct()
    if model is not None:
        gone = gone.withColumn("embedding_model", F.lit(model))
        return vec.join(gone, ["chunk_id", "embedding_model"], "left_anti")
    return vec.join(gone, "chunk_id", "left_anti")


def upsert_vectors(vec: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(vec, new, ["chunk_id", "embedding_model"])


def first_ids_edge(ids: DataFrame, limit: int) -> int | None:
    """The `limit`-th smallest distinct chunk_id, or None when there are no more than that.

    The range of ids is narrowed by counts of `EDGE_CELLS` cells at a time, so that no
    ids are sorted or gathered.
    """
    ids = ids.select("chunk_id").distinct()
    low, high, n = ids.agg(F.min("chunk_id"), F.max("chunk_id"), F.count("*")).first()
    if n <= limit:
        return None
    left = limit
    while low < high:
        width = (high - low) // EDGE_CELLS + 1
        inside = ids.filter(F.col("chunk_id").between(low, high))
        cell = F.floor((F.col("chunk_id") - F.lit(low)) / F.lit(width)).alias("cell")
        for number, count in sorted(inside.groupBy(cell).count().collect()):
            if left <= count:
                low = low + number * width
                high = min(high, low + width - 1)
                break
            left -= count
    return low


def first_missing(ch: DataFrame, vec: DataFrame, model: str, limit: int | None) -> DataFrame:
    """Chunks without a vector of the model, the first `limit` by id.

    The cut is a filter on the id, so that an embedder above it sees just these chunks
    and they stay spread over the tasks that read them.
    """
    missing = missing_chunks(ch, vec, model)
    if limit is None:
        return missing
    ids = materialize(missing_chunks(ch.select("chunk_id"), vec, model))
    edge = first_ids_edge(ids, limit)
    return missing if edge is None else missing.filter(F.col("chunk_id") <= edge)


def living_vectors(ch: DataFrame, vec: DataFrame, model: str) -> DataFrame:
    """Vectors without the stale ones of `model`; other models' are left alone."""
    columns = [f.name for f in schemas.VECTORS]
    own = F.col("embedding_model").eqNullSafe(F.lit(model))
    kept = vec.filter(own).join(ch.select("chunk_id"), "chunk_id", "left_semi")
    return vec.filter(~own).select(columns).unionByName(kept.select(columns))


def sync_vectors(
    ch: DataFrame, vec: DataFrame, embedder: Embedder, model: str, limit: int | None = None
) -> DataFrame:
    """Drops stale vectors and adds missing ones, the first `limit` by chunk id."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    todo = first_missing(ch, vec, model, limit)
    return living_vectors(ch, vec, model).unionByName(embed_chunks(todo, embedder, model))


def batch_numbers(ch: DataFrame, batch_rows: int) -> DataFrame:
    """(chunk_id, batch): batches of `batch_rows` chunks, numbered from 1 without a global sort."""
    if batch_rows <= 0:
        raise ValueError("batch_rows must be positive")
    numbered = dense_ids(ch.select("chunk_id").distinct(), "chunk_id", "position", 0)
    return numbered.select(
        "chunk_id", (F.floor(F.col("position") / batch_rows) + 1).cast("long").alias("batch")
    )


def with_embedding_meta(ch: DataFrame, vec: DataFrame, model: str | None = None) -> DataFrame:
    """Chunks with the model and size of their vector, where they have one.

    Of several models' vectors those of `model` are told, or of the first model by name.
    """
    if model is not None:
        vec = vec.filter(F.col("embedding_model") == model)
    named = F.struct(F.col("embedding_model").alias("model"), F.size("embedding").alias("dim"))
    meta = (
        vec.groupBy("chunk_id")
        .agg(F.min(named).alias("meta"))
        .select("chunk_id", F.col("meta.model").alias("new_model"), F.col("meta.dim").alias("new_dim"))
    )
    known = [[c] if c in ch.columns else [] for c in ("embedding_model", "embedding_dim")]
    return (
        ch.join(meta, "chunk_id", "left")
        .withColumn("embedding_model", F.coalesce("new_model", *known[0]))
        .withColumn("embedding_dim", F.coalesce("new_dim", *known[1]))
        .drop("new_model", "new_dim")
    )


def vector_status(ch: DataFrame, vec: DataFrame, model: str) -> DataFrame:
    """One row: chunks, vectors of the model, remaining, completion percentage."""
    counts = (
        ch.select(F.lit(1).alias("chunk"), F.lit(0).alias("vector"))
        .unionByName(
            vec.filter(F.col("embedding_model") == model).select(
                F.lit(0).alias("chunk"), F.lit(1).alias("vector")
            )
        )
        .agg(
            F.coalesce(F.sum("chunk"), F.lit(0)).alias("chunk_count"),
            F.coalesce(F.sum("vector"), F.lit(0)).alias("vector_count"),
        )
    )
    chunk_count, vector_count = F.col("chunk_count"), F.col("vector_count")
    return counts.select(
        F.lit(model).alias("embedding_model"),
        "chunk_count",
        "vector_count",
        F.greatest(chunk_count - vector_count, F.lit(0)).alias("remaining_count"),
        T.completion_percentage(vector_count, chunk_count).alias("completion_percentage"),
    )


class Reindexed(NamedTuple):
    report: DataFrame  # one row: counts before and after, time, throughput
    chunks: DataFrame  # the chunks with the model and size of their vectors
    progress: DataFrame  # one row a slice


def reindex_vectors(
    ch: DataFrame,
    path: str,
    embedder: Embedder,
    model: str,
    rebuild: bool = False,
    limit: int | None = None,
    until_seconds: float | None = None,
    slice_rows: int = 1_000_000,
    on_slice: Callable[[dict], bool] | None = None,
) -> Reindexed:
    """Resumable indexing of `ch` into the vector folder `path`.

    Stale vectors of the model go first, so that only vectors of living chunks count.
    Work is done in slices of `slice_rows` chunks by id.  Each slice is appended as one
    job, so a run that stops, or is killed, keeps what it finished; the time budget, and
    `on_slice` with the slice's progress, are asked between slices and can end the run.
    `rebuild` drops every vector of the model first.
    """
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    spark = ch.sparkSession
    started = time.monotonic()

    def vectors() -> DataFrame:
        return spark.read.schema(schemas.VECTORS).parquet(path)

    if not root_exists(spark, path):
        spark.createDataFrame([], schemas.VECTORS).write.parquet(path)
    living = ch.limit(0) if rebuild else ch
    if not stale_vectors(living, vectors(), model).isEmpty():
        replace_folder(living_vectors(living, vectors(), model), path)
    before = vector_status(ch, vectors(), model).first()
    ids = materialize(missing_chunks(ch.select("chunk_id"), vectors(), model))
    pending = ids.count()
    target = pending if limit is None else min(limit, pending)
    done, stopped, out_of_time, rows = 0, False, False, []
    while done < target and not stopped and not out_of_time:
        size = min(slice_rows, target - done)
        # Slices follow each other by id, so the missing ids found at the start serve them all.
        edge = first_ids_edge(ids, size)
        todo, now = ch, ids
        if edge is not None:
            now, ids = ids.filter(F.col("chunk_id") <= edge), ids.filter(F.col("chunk_id") > edge)
            todo = ch.filter(F.col("chunk_id") <= edge)
        embed_chunks(todo, embedder, model, now).write.mode("append").parquet(path)
        done += size
        elapsed = time.monotonic() - started
        rows.append((len(rows) + 1, size, done, target - done, elapsed))
        out_of_time = until_seconds is not None and elapsed >= until_seconds and done < target
        if on_slice is not None:
            told = dict(zip(schemas.PROGRESS.names, rows[-1], strict=True))
            stopped = not on_slice(told)
    elapsed = time.monotonic() - started
    report = vector_status(ch, vectors(), model).select(
        "*",
        F.lit(not rebuild).alias("resume"),
        F.lit(before["vector_count"]).alias("starting_vector_count"),
        F.lit(before["remaining_count"]).alias("starting_remaining_count"),
        F.lit(target).cast("long").alias("target_count"),
        F.lit(done).cast("long").alias("indexed_count"),
        F.round(F.lit(elapsed), 3).alias("elapsed_seconds"),
        T.throughput(F.lit(done), F.lit(elapsed)).alias("throughput_chunks_per_second"),
        F.lit(out_of_time).alias("stopped_due_to_time_budget"),
    )
    return Reindexed(
        report,
        with_embedding_meta(ch, vectors(), model),
        spark.createDataFrame(rows, schemas.PROGRESS),
    )
