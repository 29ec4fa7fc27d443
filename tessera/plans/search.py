"""Search by mode, inspection, and the full question-answering plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import hybrid as H
from tessera.operators.answers import (
    Generator,
    build_prompts,
    context_diversity,
    gate_evidence,
    generate_responses,
    retrieval_snapshots,
    validate_answers,
)
from tessera.operators.index import LexicalIndex
from tessera.operators.lexical import lexical_search
from tessera.operators.semantic import Embedder, semantic_search, sync_vectors
from tessera.session import materialize

MODES = ("lexical", "semantic", "hybrid")
ANSWER_RESULTS = 5


@dataclass(frozen=True)
class Backends:
    """What a search may use; a missing part makes a mode unavailable or empty."""

    index: LexicalIndex | None = None
    vectors: DataFrame | None = None
    embedder: Embedder | None = None
    model: str | None = None
    scorer: H.Scorer | None = None


def search(
    q: DataFrame,
    mode: str,
    backends: Backends,
    limit: int = H.RESULT_LIMIT,
    max_per_document: int = H.MAX_PER_DOCUMENT,
    sync: bool = False,
) -> DataFrame:
    """Ranked rows of one mode; without stored tables the result is empty.

    With `sync`, vectors are first brought up to date with the index's chunks, for this
    search only.
    """
    if mode not in MODES:
        raise ValueError(f"unsupported mode: {mode}")
    needs_vectors = mode != "lexical"
    if backends.index is None or (needs_vectors and backends.vectors is None):
        return q.sparkSession.createDataFrame([], schemas.RANKED)
    if needs_vectors and backends.embedder is None:
        raise ValueError(f"{mode} search needs an embedder")
    if needs_vectors and sync:
        fresh = sync_vectors(
            backends.index.chunks, backends.vectors, backends.embedder, backends.model
        )
        backends = replace(backends, vectors=materialize(fresh))
    if mode == "lexical":
        return lexical_search(q, backends.index, limit)
    if mode == "semantic":
        return semantic_search(
            q, backends.vectors, backends.index.chunks, backends.embedder, backends.model, limit
        )
    if backends.scorer is None:
        raise ValueError("hybrid search needs a scorer")
    return H.hybrid_search(
        q,
        backends.index,
        backends.vectors,
        backends.embedder,
        backends.model,
        backends.scorer,
        limit=limit,
        max_per_document=max_per_document,
    )


@dataclass(frozen=True)
class Inspection:
    results: DataFrame
    diagnostics: DataFrame
    documents: DataFrame


def inspect(
    q: DataFrame,
    backends: Backends,
    limit: int = H.RESULT_LIMIT,
    max_per_document: int = H.MAX_PER_DOCUMENT,
) -> Inspection:
    """Hybrid results with component scores, stage counts and document breakdown."""
    results, diagnostics = H.hybrid_search(
        q,
        backends.index,
        backends.vectors,
        backends.embedder,
        backends.model,
        backends.scorer,
        limit=limit,
        max_per_document=max_per_document,
        diagnostics=True,
    )
    return Inspection(results, diagnostics, H.document_breakdown(results))


def ask(
    q: DataFrame,
    backends: Backends,
    generator: Generator,
    limit: int = ANSWER_RESULTS,
    max_per_document: int = H.MAX_PER_DOCUMENT,
) -> DataFrame:
    """Validated answers with snapshot id, retrieval diagnostics and context diversity."""
    seen = inspect(q, backends, limit, max_per_document)
    gated = materialize(gate_evidence(q, seen.results))
    # The model is called once per prompt, however often the answers are read.
    responses = materialize(generate_responses(build_prompts(gated), generator))
    answers = validate_answers(gated, responses)
    context = context_diversity(answers).select(
        "query_id", F.col("unique_document_count").alias("context_document_count")
    )
    return (
        answers.join(retrieval_snapshots(q, seen.results), "query_id")
        .join(seen.diagnostics, "query_id")
        .join(context, "query_id")
    )
