"""Table schemas shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T

PAGE = T.StructType(
    [T.StructField("page_number", T.IntegerType()), T.StructField("text", T.StringType())]
)

FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

DOCUMENTS = T.StructType(
    [
        T.StructField("document_id", T.LongType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("doc_type", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("parse_status", T.StringType()),
        T.StructField("parse_error", T.StringType()),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.LongType()),
        T.StructField("document_id", T.LongType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("stable_id", T.StringType()),
        T.StructField("section_title", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("start_offset", T.IntegerType()),
        T.StructField("end_offset", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("token_estimate", T.IntegerType()),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("embedding_dim", T.IntegerType()),
    ]
)

VECTORS = T.StructType(
    [
        T.StructField("chunk_id", T.LongType()),
        T.StructField("document_id", T.LongType()),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("docs_seen", T.LongType()),
        T.StructField("docs_added", T.LongType()),
        T.StructField("docs_updated", T.LongType()),
        T.StructField("docs_unchanged", T.LongType()),
        T.StructField("docs_deleted", T.LongType()),
        T.StructField("docs_failed", T.LongType()),
    ]
)

# One row per micro-batch that an ingest stream has stored.
LEDGER = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("folder", T.StringType()),
    ]
)

# One ranked-result row; columns of an arm that did not find the chunk are null.
RANKED = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("chunk_id", T.LongType()),
        T.StructField("document_id", T.LongType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("stable_id", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("section_title", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("chunk_text_excerpt", T.StringType()),
        T.StructField("chunk_text", T.StringType()),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("embedding_dim", T.IntegerType()),
        T.StructField("lexical_rank", T.IntegerType()),
        T.StructField("lexical_score", T.DoubleType()),
        T.StructField("semantic_rank", T.IntegerType()),
        T.StructField("semantic_score", T.DoubleType()),
        T.StructField("exact_title_match", T.BooleanType()),
        T.StructField("exact_source_name_match", T.BooleanType()),
        T.StructField("phrase_match", T.BooleanType()),
        T.StructField("fusion_score", T.DoubleType()),
        T.StructField("reranker_score", T.DoubleType()),
        T.StructField("final_rank", T.IntegerType()),
    ]
)

GOLDEN = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("relevant_sources", T.ArrayType(T.StringType())),
        T.StructField("relevant_chunk_substrings", T.ArrayType(T.StringType())),
        T.StructField("expected_top_source", T.StringType()),
        T.StructField("min_unique_sources_at_k", T.IntegerType()),
        T.StructField("answer_should_decline", T.BooleanType()),
        T.StructField("required_citation_sources", T.ArrayType(T.StringType())),
        T.StructField("required_answer_substrings", T.ArrayType(T.StringType())),
        T.StructField("forbidden_answer_substrings", T.ArrayType(T.StringType())),
    ]
)

JOB_EVENTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("job_id", T.LongType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("payload_json", T.StringType()),
    ]
)

PROGRESS = T.StructType(
    [
        T.StructField("slice", T.LongType()),
        T.StructField("embedded", T.LongType()),
        T.StructField("indexed_count", T.LongType()),
        T.StructField("remaining_count", T.LongType()),
        T.StructField("elapsed_seconds", T.DoubleType()),
    ]
)
