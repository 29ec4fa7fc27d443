"""Joins between a stored snapshot and what was found now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.chunking import CHUNK_ORDINALS, chunk_id_of


def detect_changes(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Found files with change_type and whether they need parsing.

    A file is parsed when it is new or changed, or when it failed before.
    """
    known = documents.select(
        "source_path",
        "document_id",
        F.col("content_hash").alias("known_hash"),
        F.col("parse_status").alias("known_status"),
        F.col("parse_error").alias("known_error"),
        F.col("title").alias("known_title"),
    )
    change = T.change_type(F.col("known_hash"), F.col("content_hash"))
    retry = F.coalesce(F.col("known_status") != "parsed", F.lit(False))
    return (
        found.join(known, "source_path", "left")
        .withColumn("change_type", change)
        .withColumn("should_parse", (F.col("change_type") != "unchanged") | retry)
    )


def detect_deleted(documents: DataFrame, found: DataFrame, roots: list[str]) -> DataFrame:
    """Tracked documents below one of the roots that were not found now."""
    covered = F.lit(False)
    for root in roots:
        covered = covered | T.under_root(F.col("source_path"), F.lit(root))
    return documents.filter(covered).join(found.select("source_path"), "source_path", "left_anti")


def reconcile_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new chunks of the same documents, matched by stable id.

    outcome: `preserved` keeps its chunk id and embedding metadata, `inserted`
    gets the next free id of its document, `deleted` is gone from the new text.
    """
    before = old.select(
        "document_id",
        "stable_id",
        F.col("chunk_id").alias("old_chunk_id"),
        F.col("embedding_model").alias("old_model"),
        F.col("embedding_dim").alias("old_dim"),
        F.lit(False).alias("is_new"),
    )
    now = new.select("document_id", "chunk_index", "stable_id", F.lit(True).alias("is_new"))
    # One shuffle of narrow rows by document serves the matching and the numbering below;
    # texts join at the end.
    both = now.unionByName(before, allowMissingColumns=True).repartition("document_id")
    same_id = Window.partitionBy("document_id", "stable_id")
    matched = both.select(
        "*",
        F.bool_or("is_new").over(same_id).alias("still_there"),
        *(F.max(c).over(same_id).alias(f"matched_{c}") for c in ("old_chunk_id", "old_model", "old_dim")),
    )
    per_document = Window.partitionBy("document_id")
    last_used = F.coalesce(
        F.max(F.col("old_chunk_id") - F.col("document_id") * CHUNK_ORDINALS).over(per_document),
        F.lit(-1),
    )
    outcome = (
        F.when(~F.col("is_new"), "deleted")
        .when(F.col("matched_old_chunk_id").isNull(), "inserted")
        .otherwise("preserved")
    )
    nth = F.row_number().over(
        Window.partitionBy("document_id", "outcome").orderBy("chunk_index", "stable_id")
    )
    fresh = chunk_id_of(F.col("document_id"), F.col("last_used") + nth)
    numbered = (
        matched.withColumn("last_used", last_used)
        .withColumn("outcome", outcome)
        .filter(F.col("is_new") | ~F.col("still_there"))
        .select(
            F.when(F.col("outcome") == "inserted", fresh)
            .otherwise(F.col("matched_old_chunk_id"))
            .alias("chunk_id"),
            "document_id",
            "chunk_index",
            "stable_id",
            F.col("matched_old_model").alias("embedding_model"),
            F.col("matched_old_dim").alias("embedding_dim"),
            "outcome",
        )
    )
    details = ["section_title", "page_number", "start_offset", "end_offset", "text", "token_estimate"]
    place = ["document_id", "chunk_index"]
    return numbered.join(new.select(*place, *details), place, "left").select(
        "chunk_id", *place, "stable_id", *details, "embedding_model", "embedding_dim", "outcome"
    )


def chunk_counts(reconciled: DataFrame) -> DataFrame:
    """Preserved, new and removed chunks per document."""

    def outcome(value: str) -> Column:
        return F.count_if(F.col("outcome") == value)

    return reconciled.groupBy("document_id").agg(
        outcome("preserved").alias("preserved_chunk_count"),
        outcome("inserted").alias("new_chunk_count"),
        outcome("deleted").alias("removed_chunk_count"),
    )


def run_summary(changes: DataFrame, deleted: DataFrame) -> DataFrame:
    """One row of document counts; a failed document also counts as added or updated."""

    def change(value: str) -> Column:
        return F.count_if(F.col("change_type") == value)

    rows = changes.select("change_type", "parse_status").unionByName(
        deleted.select(F.lit("deleted").alias("change_type"), F.lit(None).alias("parse_status"))
    )
    return rows.agg(
        F.count_if(F.col("change_type") != "deleted").alias("docs_seen"),
        change("added").alias("docs_added"),
        change("updated").alias("docs_updated"),
        change("unchanged").alias("docs_unchanged"),
        change("deleted").alias("docs_deleted"),
        F.count_if(F.col("parse_status") == "failed").alias("docs_failed"),
    )


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the documents in `gone`."""
    ids = gone.select("document_id")
    return {name: df.join(ids, "document_id", "left_anti") for name, df in tables.items()}
