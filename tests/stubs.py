"""Deterministic stand-ins for models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType


def _axes(text: str) -> list[float]:
    low = text.lower()
    if "socket" in low and "timeout" in low:
        return [1.0, 0.0, 0.0]
    if "widget" in low:
        return [0.0, 1.0, 0.0]
    return [0.0, 0.0, 1.0]


@F.pandas_udf(ArrayType(FloatType()))
def axes(text: pd.Series) -> pd.Series:
    return text.map(_axes)


@F.pandas_udf(DoubleType())
def length_score(query: pd.Series, text: pd.Series) -> pd.Series:
    return text.str.len().astype("float64")


@F.pandas_udf(DoubleType())
def marked_score(query: pd.Series, text: pd.Series) -> pd.Series:
    """The number a test wrote at the end of a text, as its score."""
    return text.str.extract(r"score=([\d.]+)")[0].astype("float64").fillna(0.0)
