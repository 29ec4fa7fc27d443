"""Incremental ingest of files into a corpus state."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as T
from tessera.operators.chunking import OVERLAP_TOKENS, PAGED_TYPE, TARGET_TOKENS, chunk_documents
from tessera.operators.index import LexicalIndex, build_index, describe_chunks, refresh_index
from tessera.operators.semantic import (
    Embedder,
    check_embedded,
    embed_chunks,
    upsert_vectors,
    with_embedding_meta,
)
from tessera.plans.reconcile import (
    cascade_delete,
    chunk_counts,
    detect_changes,
    detect_deleted,
    reconcile_chunks,
    run_summary,
)
from tessera.plans.state import CorpusState, dense_ids
from tessera.session import materialize
from tessera.sources.files import decode_text, describe_files, parse_text_docs, scan_files
from tessera.sources.paged import assemble_pages

NO_PAGES = "PageTextMissing: no page text was supplied for this file"


@dataclass(frozen=True)
class IngestResult:
    state: CorpusState  # unchanged by a dry run
    run: DataFrame  # one row of document counts
    documents: DataFrame  # per document: change, status, chunk counts
    deleted: DataFrame  # source_path, document_id
    pending: DataFrame  # inserted chunks, those an embedder has to see
    index: LexicalIndex | None = None  # the index given, brought up to date
    # For an index stored in segments: refresh_segments(spark, path, result.changed, result.touched).
    changed: DataFrame | None = None  # described chunks of the documents parsed in this run
    touched: DataFrame | None = None  # document_id of those and of the deleted


def ingest(
    spark: SparkSession,
    roots: Iterable[str],
    state: CorpusState,
    embedder: Embedder | None = None,
    model: str = "default",
    pages: DataFrame | None = None,
    dry_run: bool = False,
    now: datetime | None = None,
    target_tokens: int = TARGET_TOKENS,
    overlap_tokens: int = OVERLAP_TOKENS,
    index: LexicalIndex | None = None,
) -> IngestResult:
    """Files below `roots` against `state`; without an embedder no vectors are made.

    A given `index` is refreshed for the documents that changed, or built anew when it does
    not hold as many chunks as the state.

    `pages` (source_path, page_number, text[, meta_title]) supplies the text of
    paged files.  A dry run returns the same counts and the old state.
    """
    roots = [r.rstrip("/") or "/" for r in roots]
    files = scan_files(spark, roots)
    return ingest_files(
        files, roots, state, embedder, model, pages, dry_run, now, target_tokens, overlap_tokens,
        index=index,
    )


def ingest_files(
    files: DataFrame,
    roots: list[str],
    state: CorpusState,
    embedder: Embedder | None = None,
    model: str = "default",
    pages: DataFrame | None = None,
    dry_run: bool = False,
    now: datetime | None = None,
    target_tokens: int = TARGET_TOKENS,
    overlap_tokens: int = OVERLAP_TOKENS,
    detect_deletions: bool = True,
    index: LexicalIndex | None = None,
) -> IngestResult:
    """Files as `scan_files` returns them, or as `describe_files` already described them."""
    spark = files.sparkSession
    now = now or datetime.now(timezone.utc).replace(microsecond=0, tzinfo=None)
    stamp = F.lit(now).cast("timestamp")
    described = files if "content_hash" in files.columns else describe_files(files)
    # The first pass keeps fingerprints only; contents are read again just for
    # the files that changed.
    found = materialize(described.drop("content"))
    changes = materialize(_numbered(detect_changes(found, state.documents), state))
    deleted = detect_deleted(state.documents, found, roots if detect_deletions else [])

    parsed = materialize(_parse(described, changes.filter("should_parse"), pages))
    chunks = chunk_documents(parsed.filter("parse_status = 'parsed'"), target_tokens, overlap_tokens)
    touched = parsed.select("document_id")
    old_chunks = state.chunks.join(touched, "document_id", "left_semi")
    reconciled = materialize(reconcile_chunks(old_chunks, chunks))

    seen = changes.join(
        parsed.select("document_id", "parse_status", "parse_error", "title"), "document_id", "left"
    ).withColumn(
        "parse_status", F.coalesce("parse_status", "known_status")
    ).withColumn(
        "parse_error", F.when(~F.col("should_parse"), F.col("known_error")).otherwise(F.col("parse_error"))
    ).withColumn("title", F.coalesce("title", "known_title"))
    documents = seen.select(
        "document_id",
        "source_path",
        "title",
        "doc_type",
        "content_hash",
        "modified_at",
        stamp.alias("ingested_at"),
        "parse_status",
        "parse_error",
    )
    columns = [f.name for f in schemas.CHUNKS]
    pending = reconciled.filter("outcome = 'inserted'").select(columns)
    report = _per_document(seen, reconciled, state.chunks, embedder is not None)
    run = run_summary(seen, deleted)
    if dry_run:
        return IngestResult(state, run, report, deleted, pending, index)

    gone = deleted.select("document_id")
    kept = cascade_delete(
        {"documents": state.documents, "chunks": state.chunks, "vectors": state.vectors},
        gone.unionByName(touched),
    )
    unchanged = changes.filter("NOT should_parse").select("document_id")
    preserved = reconciled.filter("outcome = 'preserved'").select(columns)
    inserted = pending
    kept_vectors = kept["vectors"].unionByName(
        state.vectors.join(
            preserved.select("chunk_id"), "chunk_id", "left_semi"
        )
    )
    if embedder is not None:
        fresh = materialize(embed_chunks(pending, embedder, model))
        check_embedded(pending, fresh)
        kept_vectors = upsert_vectors(kept_vectors, fresh)
        inserted = with_embedding_meta(pending, fresh).select(columns)
    run_id = F.coalesce(state.runs.agg(F.max("run_id").alias("m")).select("m").scalar(), F.lit(0))
    run_row = run.select(
        (run_id + 1).alias("run_id"),
        stamp.alias("started_at"),
        F.current_timestamp().alias("finished_at"),
        *[f.name for f in schemas.RUNS][3:],
    )
    new_state = CorpusState(
        kept["documents"].join(unchanged, "document_id", "left_anti").unionByName(documents),
        kept["chunks"].select(columns).unionByName(preserved).unionByName(inserted),
        kept_vectors,
        state.runs.unionByName(run_row),
    )
    # Chunks of changed documents only, described by the documents' new titles.
    changed = describe_chunks(preserved.unionByName(inserted), documents)
    touched = gone.unionByName(touched)
    if index is not None and index.chunks.count() != state.chunks.count():
        index = build_index(new_state.chunks, new_state.documents)
    elif index is not None:
        index = refresh_index(index, changed, touched)
    return IngestResult(new_state, run, report, deleted, pending, index, changed, touched)


def _numbered(changes: DataFrame, state: CorpusState) -> DataFrame:
    """Gives new files the next document ids."""
    start = state.documents.agg(F.coalesce(F.max("document_id"), F.lit(0)) + 1).first()[0]
    new = changes.filter("document_id IS NULL").select("source_path")
    ids = dense_ids(new, "source_path", "new_id", start)
    return (
        changes.join(ids, "source_path", "left")
        .withColumn("document_id", F.coalesce("document_id", "new_id"))
        .drop("new_id")
    )


def _parse(described: DataFrame, wanted: DataFrame, pages: DataFrame | None) -> DataFrame:
    """Parsed rows of the wanted files; failures are rows with a status, not errors."""
    rows = described.select("source_path", "content").join(
        wanted.select("source_path", "document_id", "doc_type", "known_title"), "source_path"
    )
    no_pages = F.array().cast("array<struct<page_number:int,text:string>>")
    flat = parse_text_docs(decode_text(rows.filter(F.col("doc_type") != PAGED_TYPE))).select(
        "document_id",
        "source_path",
        "doc_type",
        "known_title",
        "parse_status",
        "parse_error",
        "title",
        "text",
        no_pages.alias("pages"),
    )
    paged = rows.filter(F.col("doc_type") == PAGED_TYPE).drop("content")
    if pages is not None:
        stem = T.source_stem(T.source_name(F.col("source_path")))
        keyed = pages.join(paged.select("source_path", "document_id"), "source_path").withColumn(
            "stem", stem
        )
        text = assemble_pages(keyed, "stem").drop("doc_type")
        paged = paged.join(text, "document_id", "left")
    else:
        paged = (
            paged.withColumn("title", F.lit(None).cast("string"))
            .withColumn("text", F.lit(None).cast("string"))
            .withColumn("pages", no_pages)
        )
    has_text = F.col("text").isNotNull()
    paged = paged.withColumn(
        "parse_status", F.when(has_text, "parsed").otherwise("failed")
    ).withColumn("parse_error", F.when(~has_text, NO_PAGES))
    stem = T.source_stem(T.source_name(F.col("source_path")))
    return (
        flat.unionByName(paged)
        .withColumn(
            "title",
            F.when(F.col("parse_status") == "parsed", F.col("title")).otherwise(
                F.coalesce(F.nullif("known_title", F.lit("")), stem)
            ),
        )
        .drop("known_title")
    )


def _per_document(
    seen: DataFrame, reconciled: DataFrame, old_chunks: DataFrame, embeds: bool
) -> DataFrame:
    untouched = (
        old_chunks.join(seen.filter("NOT should_parse").select("document_id"), "document_id")
        .groupBy("document_id")
        .agg(F.count("*").alias("stored"))
    )
    counted = (
        seen.join(chunk_counts(reconciled), "document_id", "left")
        .join(untouched, "document_id", "left")
        .na.fill(0, ["preserved_chunk_count", "new_chunk_count", "removed_chunk_count", "stored"])
    )
    embedded = F.col("new_chunk_count") if embeds else F.lit(0).cast("long")
    return counted.select(
        "document_id",
        "source_path",
        "change_type",
        "parse_status",
        "parse_error",
        (F.col("preserved_chunk_count") + F.col("stored")).alias("preserved_chunk_count"),
        "new_chunk_count",
        "removed_chunk_count",
        embedded.alias("embedded_chunk_count"),
    )
