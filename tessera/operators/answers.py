"""Grounded answers: context, evidence gate, prompts and validation.

All steps work on one row per query whose arrays hold at most `limit` chunks.
The model call itself is the user's: a pandas UDF, or a table of responses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import citations as C
from tessera.functions import text as T
from tessera.operators.hybrid import collapse_near_duplicates

# (system prompt, user prompt) -> raw response, a pandas UDF.
Generator = Callable[[Column, Column], Column]

# --- fixed values -----------------------------------------------------------
CONTEXT_LIMIT = 5
MIN_STRONG_CHUNKS = 2
LIMITED_EVIDENCE_MARKERS = (
    "may be incomplete",
    "limited evidence",
    "insufficient evidence",
    "insufficiently supported",
    "not enough evidence",
    "not enough information",
    "not enough context",
    "cannot determine from the retrieved chunks",
    "cannot answer from the retrieved chunks",
    "unclear from the retrieved chunks",
)
SYSTEM_PROMPT = (
    "You are a grounded local-only answer generator. "
    "Use only the provided chunks. "
    "Do not add outside knowledge. "
    "If the evidence is insufficient, say so clearly. "
    "Every factual claim must include one or more inline chunk citations like [C1]. "
    "Return strict JSON only with keys: answer, citations, warnings."
)
WEAK_INSTRUCTION = (
    "Evidence is limited. You must explicitly say the answer may be incomplete "
    "or insufficiently supported."
)
STRONG_INSTRUCTION = (
    "Evidence is sufficient enough to answer cautiously if the chunks support it."
)
PROMPT_RULES = """Rules:
- Use only the chunks below.
- Do not claim anything that is not supported by a chunk.
- Put inline citations directly in the answer using [C1] style markers.
- The citations array must contain each referenced chunk label once.
- The warnings array must contain plain strings only.
- Return valid JSON only. Do not wrap it in markdown fences.
JSON schema: {"answer": "...", "citations": ["C1"], "warnings": ["..."]}
Retrieved chunks:"""
LIMITED_WARNING = "Retrieved evidence is limited; the answer may be incomplete."
EMPTY_WARNING = "No retrieved evidence matched the query."
SINGLE_WARNING = "A single weakly matched chunk is not enough for a grounded answer."
EMPTY_ANSWER = (
    "I could not answer from the local corpus because no relevant chunks were retrieved."
)
SINGLE_ANSWER = (
    "I found some potentially relevant local evidence, but not enough support to "
    "answer confidently from the retrieved chunks alone."
)
FAILURE_ANSWER = (
    "I found relevant local evidence, but I could not produce a citation-valid grounded "
    "answer from the retrieved chunks."
)
BAD_JSON = "The generator returned invalid JSON."
NOT_AN_OBJECT = "The generator returned a non-object JSON payload."
EMPTY_FIELD = "The generator returned an empty answer field."
BAD_LABELS = "The generator returned invalid citation labels."
UNCITED = "The generator returned an uncited substantive answer."
LABEL_MISMATCH = (
    "The generator returned citation labels that do not match the cited chunks in the answer."
)
UNKNOWN_LABEL = "The generator cited a chunk that was not retrieved."
BAD_WARNINGS = "The generator returned invalid warnings."
NOT_ADMITTED = "Weak retrieval requires the answer to acknowledge limited evidence."
# ----------------------------------------------------------------------------

USED = (
    "chunk_id",
    "chunk_index",
    "stable_id",
    "document_id",
    "source_path",
    "source_name",
    "section_title",
    "page_number",
    "chunk_text_excerpt",
    "embedding_model",
    "embedding_dim",
    "final_rank",
    "lexical_rank",
    "lexical_score",
    "semantic_rank",
    "semantic_score",
    "exact_title_match",
    "exact_source_name_match",
    "phrase_match",
    "fusion_score",
    "reranker_score",
)


def answer_context(ranked: DataFrame, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """Used chunks: near-duplicates collapsed, the first `limit`, labelled C1..Cn."""
    kept = collapse_near_duplicates(ranked).filter(F.col("final_rank") <= limit)
    return kept.select(
        "query_id",
        F.concat(F.lit("C"), F.col("final_rank").cast("string")).alias("label"),
        F.col("title").alias("document_title"),
        F.col("chunk_text").alias("text"),
        *USED,
    )


def gate_evidence(q: DataFrame, ranked: DataFrame, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """One row per query: its used chunks, the decision, the weak flag and warnings.

    decision: `empty` and `single` are answered by fixed refusals, `generate`
    goes to the model.
    """
    context = answer_context(ranked, limit)
    item = F.struct("final_rank", *(c for c in context.columns if c not in ("query_id", "final_rank")))
    used = context.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("used"))
    retrieved = ranked.groupBy("query_id").agg(F.count("*").alias("retrieved_count"))
    none = F.array().cast(used.schema["used"].dataType)
    joined = (
        q.select("query_id", "query_text")
        .join(retrieved, "query_id", "left")
        .join(used, "query_id", "left")
        .withColumn("used", F.coalesce("used", none))
    )
    count = F.size("used")
    first = F.get("used", F.lit(0))
    confident = F.coalesce(
        (first["lexical_rank"] == 1)
        & (first["exact_title_match"] | first["exact_source_name_match"]),
        F.lit(False),
    )
    decision = (
        F.when(count == 0, "empty").when((count == 1) & ~confident, "single").otherwise("generate")
    )
    counted = joined.withColumn("used_chunk_count", count)
    warnings = (
        F.when(F.col("decision") == "empty", F.array(F.lit(EMPTY_WARNING)))
        .when(F.col("decision") == "single", F.array(F.lit(LIMITED_WARNING), F.lit(SINGLE_WARNING)))
        .when(F.col("weak_retrieval"), F.array(F.lit(LIMITED_WARNING)))
        .otherwise(F.array().cast("array<string>"))
    )
    return (
        counted.withColumn("retrieved_count", F.coalesce("retrieved_count", F.lit(0)))
        .withColumn("decision", decision)
        .withColumn("weak_retrieval", F.col("used_chunk_count") < MIN_STRONG_CHUNKS)
        .withColumn("warnings", warnings)
    )


def build_prompts(gated: DataFrame) -> DataFrame:
    """(query_id, system_prompt, user_prompt) of the queries that go to the model."""

    def shown(value: Column, default: str) -> Column:
        return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(default))

    def block(chunk: Column) -> Column:
        return F.concat_ws(
            "\n",
            chunk["label"],
            F.concat(F.lit("title: "), shown(chunk["document_title"], C.UNTITLED)),
            F.concat(F.lit("path: "), chunk["source_path"]),
            F.concat(F.lit("section: "), shown(chunk["section_title"], "-")),
            F.concat(F.lit("page: "), shown(chunk["page_number"], "-")),
            F.concat(F.lit("chunk_index: "), chunk["chunk_index"].cast("string")),
            F.lit("text:"),
            chunk["text"],
        )

    instruction = F.when(F.col("weak_retrieval"), WEAK_INSTRUCTION).otherwise(STRONG_INSTRUCTION)
    return gated.filter(F.col("decision") == "generate").select(
        "query_id",
        F.lit(SYSTEM_PROMPT).alias("system_prompt"),
        F.concat_ws(
            "\n",
            F.concat(F.lit("Question: "), F.col("query_text")),
            instruction,
            F.lit(PROMPT_RULES),
            F.array_join(F.transform("used", block), "\n\n"),
        ).alias("user_prompt"),
    )


def generate_responses(prompts: DataFrame, generator: Generator) -> DataFrame:
    return prompts.select(
        "query_id", generator(F.col("system_prompt"), F.col("user_prompt")).alias("raw_response")
    )


def _kind(value: Column) -> Column:
    """JSON kind of a variant: STRING, VOID (null or absent), OBJECT, ARRAY, ..."""
    return F.regexp_extract(F.coalesce(F.schema_of_variant(value), F.lit("VOID")), r"\A[A-Z]+", 0)


def _strings(value: Column) -> Column:
    """List of strings; empty when null or absent, null when it is anything else."""
    items = F.try_variant_get(value, "$", "array<variant>")
    all_strings = (_kind(value) == "ARRAY") & F.forall(items, lambda i: _kind(i) == "STRING")
    return F.when(_kind(value) == "VOID", F.array().cast("array<string>")).when(
        all_strings, F.transform(items, lambda i: F.try_variant_get(i, "$", "string"))
    )


def normalize_citation_labels(value: Column) -> Column:
    """Labels of a JSON list without repeats; null when any item is no label."""
    labels = F.transform(_strings(value), C.normalize_chunk_label)
    return F.when(F.forall(labels, lambda x: x.isNotNull()), F.array_distinct(labels))


def normalize_warning_list(value: Column) -> Column:
    stripped = F.transform(_strings(value), T.strip)
    return F.filter(stripped, lambda w: w != "")


def validate_answers(gated: DataFrame, responses: DataFrame) -> DataFrame:
    """Final answers of all queries.

    `failure` names the first rule a response breaks; such answers, like those of
    gated queries, carry a fixed text and no citations.
    """
    parsed = (
        gated.join(responses.select("query_id", "raw_response"), "query_id", "left")
        .withColumn("json", F.try_parse_json("raw_response"))
        .withColumn("json_kind", F.when(F.col("json").isNotNull(), _kind(F.col("json"))))
        .withColumn("fields", F.when(F.col("json_kind") == "OBJECT", F.col("json")))
    )

    def field(name: str) -> Column:
        return F.try_variant_get(F.col("fields"), f"$.{name}", "variant")

    read = (
        parsed.withColumn("answer_field", field("answer"))
        .withColumn(
            "answer_text",
            F.when(
                _kind(F.col("answer_field")) == "STRING",
                F.try_variant_get(F.col("answer_field"), "$", "string"),
            ),
        )
        .withColumn("cited", normalize_citation_labels(field("citations")))
        .withColumn("noted", normalize_warning_list(field("warnings")))
        .withColumn("inline", C.inline_labels(F.coalesce("answer_text", F.lit(""))))
    )
    known = F.transform("used", lambda u: u["label"])
    generated = F.col("decision") == "generate"
    admitted = C.has_marker(F.col("answer_text"), LIMITED_EVIDENCE_MARKERS)
    failure = F.when(
        generated,
        F.when(F.col("json").isNull(), BAD_JSON)
        .when(F.col("json_kind") != "OBJECT", NOT_AN_OBJECT)
        .when(F.coalesce(T.strip(F.col("answer_text")), F.lit("")) == "", EMPTY_FIELD)
        .when(F.col("cited").isNull(), BAD_LABELS)
        .when(F.size("inline") == 0, UNCITED)
        .when(F.sort_array("inline") != F.sort_array("cited"), LABEL_MISMATCH)
        .when(F.size(F.array_except("inline", known)) > 0, UNKNOWN_LABEL)
        .when(F.col("noted").isNull(), BAD_WARNINGS)
        .when(F.col("weak_retrieval") & ~admitted, NOT_ADMITTED),
    )
    judged = read.withColumn("failure", failure)
    accepted = generated & F.col("failure").isNull()

    def citation(label: Column, i: Column) -> Column:
        chunk = F.get(F.filter("used", lambda u: u["label"] == label), F.lit(0))
        number = F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"))
        return F.struct(
            number.alias("label"),
            *(chunk[c].alias(c) for c in ("chunk_id", "chunk_index", "document_id")),
            *(
                chunk[c].alias(c)
                for c in ("document_title", "source_path", "section_title", "page_number")
            ),
            C.citation_quote(chunk["text"]).alias("quote"),
            C.citation_display(
                number,
                chunk["document_title"],
                chunk["source_path"],
                chunk["section_title"],
                chunk["page_number"],
                chunk["chunk_index"],
            ).alias("display"),
        )

    labels = F.when(accepted, F.col("inline")).otherwise(F.array().cast("array<string>"))
    answer = (
        F.when(accepted, C.render_citations(F.col("answer_text"), F.col("inline")))
        .when(generated, FAILURE_ANSWER)
        .when(F.col("decision") == "single", SINGLE_ANSWER)
        .otherwise(EMPTY_ANSWER)
    )
    own = (
        F.when(accepted, F.col("noted"))
        .when(generated, F.array("failure"))
        .otherwise(F.array().cast("array<string>"))
    )
    return judged.withColumn("labels", labels).select(
        "query_id",
        "query_text",
        answer.alias("answer"),
        F.transform("labels", citation).alias("citations"),
        F.col("used").alias("used_chunks"),
        T.dedupe_strings(F.concat("warnings", own)).alias("warnings"),
        "failure",
        "decision",
        "retrieved_count",
        "used_chunk_count",
        F.size("labels").alias("cited_chunk_count"),
        "weak_retrieval",
        generated.alias("generator_called"),
    )


def context_diversity(answers: DataFrame) -> DataFrame:
    """Used chunks and distinct documents behind each answer."""
    keys = F.transform("used_chunks", lambda u: u["document_id"])
    return answers.select(
        "query_id",
        "used_chunk_count",
        F.size(F.array_distinct(keys)).alias("unique_document_count"),
    )


def retrieval_snapshots(q: DataFrame, ranked: DataFrame, mode: str = "hybrid") -> DataFrame:
    """(query_id, snapshot_id, result_count): fingerprint of each result list."""
    entry = F.struct(F.col("final_rank").alias("rank"), "chunk_id", "stable_id")
    lists = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("results"))
    empty = F.array().cast("array<struct<rank:int,chunk_id:bigint,stable_id:string>>")
    return q.join(lists, "query_id", "left").select(
        "query_id",
        T.snapshot_id(
            F.col("query_text"), F.lit(mode), F.coalesce("results", empty)
        ).alias("snapshot_id"),
        F.coalesce(F.size(F.coalesce("results", empty)), F.lit(0)).alias("result_count"),
    )
