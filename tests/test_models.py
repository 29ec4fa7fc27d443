from __future__ import annotations

import os
import uuid

import numpy as np
import pytest

from pyspark.sql import functions as F
from tessera.functions.models import batched_embedder, batched_generator, batched_scorer
from tessera.operators.semantic import embed_chunks


def noted(folder, line):
    """Leaves one file a call: the workers share nothing else with the test."""
    (folder / f"{uuid.uuid4().hex}").write_text(line)


def notes(folder):
    return [p.read_text() for p in folder.iterdir()]


def test_a_model_is_loaded_once_a_worker_and_sees_bounded_batches(spark, tmp_path):
    loads, batches = tmp_path / "loads", tmp_path / "batches"
    loads.mkdir(), batches.mkdir()

    def load():
        noted(loads, str(os.getpid()))

        def predict(texts):
            noted(batches, str(len(texts)))
            return np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)

        return predict

    chunks = spark.range(300).repartition(40).selectExpr(
        "id AS chunk_id", "id AS document_id", "repeat('ab', CAST(id AS INT)) AS text"
    )
    got = embed_chunks(chunks, batched_embedder(load, 5), "m").collect()
    assert {r.chunk_id: r.embedding for r in got} == {i: [2.0 * i, float(i)] for i in range(300)}
    pids = notes(loads)
    # Forty tasks, but no worker loads a second time.
    assert len(pids) == len(set(pids)) < 40
    sizes = list(map(int, notes(batches)))
    assert sum(sizes) == 300 and max(sizes) == 5


def test_scores_and_responses_of_null_texts_are_null(spark):
    rows = spark.createDataFrame([(1, "q", "text"), (2, None, "x"), (3, "q", None), (4, "", "")], "i int, a string, b string")

    def scorer():
        return lambda queries, texts: np.array([float(len(q) + len(t)) for q, t in zip(queries, texts, strict=True)])

    def generator():
        return lambda prompts: np.array([p.upper() for p in prompts], dtype=object)

    got = rows.select(
        "i", batched_scorer(scorer, 2)(F.col("a"), F.col("b")).alias("s"), batched_generator(generator, 3)(F.col("b")).alias("g")
    ).orderBy("i").collect()
    assert [(r.s, r.g) for r in got] == [(5.0, "TEXT"), (None, "X"), (None, None), (0.0, "")]
    assert rows.limit(0).select(batched_generator(generator)(F.col("b"))).count() == 0


def test_the_batch_size_must_be_positive():
    with pytest.raises(ValueError, match="batch_size"):
        batched_embedder(lambda: None, 0)
