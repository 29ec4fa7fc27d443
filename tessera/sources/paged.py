"""Paged text: page rows to one document per id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.chunking import PAGE_MARKER, PAGED_TYPE


def assemble_pages(pages: DataFrame, fallback: str | None = None) -> DataFrame:
    """(document_id, page_number, text[, meta_title]) -> text with page markers.

    All pages of one document form one row, as they form one document; the title
    is the metadata title, else the first line of the first page with text, else
    the column named by `fallback`.
    """
    opening, closing = PAGE_MARKER
    extra = [
        F.max(name).alias(alias)
        for name, alias in (("meta_title", "meta"), (fallback, "fallback"))
        if name in pages.columns
    ]
    page = F.struct(
        F.col("page_number").cast("int").alias("page_number"),
        T.normalize_text(F.coalesce("text", F.lit(""))).alias("text"),
    )
    grouped = pages.groupBy("document_id").agg(
        F.array_sort(F.collect_list(page)).alias("pages"), *extra
    )
    marked = F.transform(
        "pages",
        lambda p: T.strip(
            F.concat(
                F.lit(opening), p["page_number"].cast("string"), F.lit(closing + "\n"), p["text"]
            )
        ),
    )
    first = F.get(F.filter(F.transform("pages", lambda p: p["text"]), lambda t: t != ""), F.lit(0))
    meta = F.nullif(T.strip(F.col("meta")), F.lit("")) if "meta" in grouped.columns else F.lit(None)
    last = F.col("fallback") if "fallback" in grouped.columns else F.lit(None).cast("string")
    return grouped.select(
        "document_id",
        F.coalesce(
            meta.cast("string"), T.title_from_first_line(F.coalesce(first, F.lit("")), last)
        ).alias("title"),
        F.lit(PAGED_TYPE).alias("doc_type"),
        T.normalize_text(F.array_join(marked, "\n\n")).alias("text"),
        "pages",
    )
