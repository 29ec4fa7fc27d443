"""Embedders, rerankers and generators from a loader: one model a worker, batches of a fixed size.

A loader is a function without arguments that loads the model and returns its predictor.  It
runs on the executors, once in each Python worker that gets rows, and its model is kept there
for later batches; the driver never holds it.  The predictor gets numpy arrays of at most
`batch_size` texts and returns one result a text.  A row with a null text gets a null result;
the predictor sees an empty text in its place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StringType

BATCH_SIZE = 64


def _batched(load: Callable[[], Callable], kind: DataType, batch_size: int) -> Callable[..., Column]:
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    predict = predict_batch_udf(load, return_type=kind, batch_size=batch_size)

    def over(*texts: Column) -> Column:
        present = texts[0].isNotNull()
        for text in texts[1:]:
            present = present & text.isNotNull()
        return F.when(present, predict(*(F.coalesce(t, F.lit("")) for t in texts)))

    return over


def batched_embedder(
    load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = BATCH_SIZE
) -> Callable[[Column], Column]:
    """Embedder whose predictor maps n texts to an (n, dimensions) array."""
    return _batched(load, ArrayType(FloatType()), batch_size)


def batched_scorer(
    load: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], batch_size: int = BATCH_SIZE
) -> Callable[[Column, Column], Column]:
    """Reranker whose predictor maps n queries and n texts to n scores."""
    return _batched(load, DoubleType(), batch_size)


def batched_generator(
    load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = BATCH_SIZE
) -> Callable[[Column], Column]:
    """Generator whose predictor maps n prompts to n responses."""
    return _batched(load, StringType(), batch_size)
