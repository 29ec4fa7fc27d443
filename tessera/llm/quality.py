"""Ordinal quality classifier: a cumulative-link regression on hashed text.

Grades are ordered: 0 toxic, 1 poor, 2 good.  One weight vector w is shared by all grades
and ordered thresholds t_0 < t_1 cut its scale: P(grade <= k) = sigmoid(t_k - w.x).  From
these come the expected grade and the tail probability P(grade >= 2) that selects.

Features are hashed and binary: each distinct word and each distinct run of marks of the
text, and a few about its shape (share of distinct words, of repeated lines, of words with
marks inside).  The model is fitted by proximal gradient steps with an L1 penalty on a
sample of at most `SAMPLE` labelled rows (the smallest hashes of doc_id), the only rows the
driver ever sees; every document is scored, whole, in a narrow step.

Defined results: a null or empty text has no words and is graded by its shape features
alone, like any other; labels that are null or name no document are ignored, and the
lowest grade counts when labels repeat; null doc_ids stay null and repeated rows give repeated rows; extra
columns of any name pass through `keep_good` untouched; without any label everything is kept
(P = 1); an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.common import over_batches, text_or_empty

DIMENSIONS = 1 << 20
SAMPLE = 12_000
GRADES = 3
KEEP_AT = 0.5  # least P(grade >= 2) of a document that stays
L1 = 5e-4
STEPS = 200
RATE = 0.05
KNOWN_WORDS = 100_000
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+")


def features(text: str) -> list[str]:
    """The distinct features of a text, as strings."""
    words = _TOKEN.findall(text.lower())
    own = set(words)
    lines = [line for line in text.split("\n") if line.strip()]
    again = sum(map(eq, words, words[1:]))
    marked = sum(not w[0].isalnum() for w in words)
    shape = (
        ("distinct", len(own) / len(words) if words else 1.0, 10),
        ("lines", len(set(lines)) / len(lines) if lines else 1.0, 10),
        ("again", again / len(words) if words else 0.0, 10),
        ("marks", marked / len(words) if words else 0.0, 10),
    )
    out = list(own)
    size = min(len(words).bit_length(), 12)
    for name, share, steps in shape:
        out += (f"\x00{name}:{int(share * steps)}", f"\x00{name}:{int(share * steps)}:{size}")
    return out


def index_of(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) & (DIMENSIONS - 1)


@dataclass(frozen=True)
class OrdinalModel:
    """`weights` of the features that have one, by index, and ascending `thresholds`."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES - 1, a column each."""
        return _sigmoid(scores[:, None] - np.array(self.thresholds)[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit(rows: list[np.ndarray], grades: np.ndarray) -> OrdinalModel:
    """Fits weights and thresholds to feature indices and grades, in memory."""
    kept, columns = np.unique(np.concatenate(rows), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    # A feature in one row only tells nothing about others.
    common = np.bincount(columns, minlength=len(kept)) > 1
    used = common[columns]
    columns, owner = columns[used], owner[used]
    counts = np.bincount(grades, minlength=GRADES) + 1.0
    below = np.cumsum(counts)[:-1] / counts.sum()
    w, t = np.zeros(len(kept)), np.log(below / (1 - below))
    # The penalty picks the features; the second run, on those alone, undoes its shrinking.
    w, t = _descend(owner, columns, grades, w, t, L1)
    picked = (w != 0)[columns]
    w, t = _descend(owner[picked], columns[picked], grades, w, t, L1 / 20)
    weights = {int(kept[i]): float(w[i]) for i in np.flatnonzero(w)}
    return OrdinalModel(weights, tuple(map(float, t)))


def _descend(owner, columns, grades, w, t, l1):
    """Proximal steps on the mean negative log-likelihood, scaled by each feature's own gradients."""
    n = len(grades)
    speed_w, speed_t = np.full(len(w), 1e-8), np.full(len(t), 1e-8)
    for _ in range(STEPS):
        score = np.bincount(owner, w[columns], minlength=n)
        padded = np.concatenate(([-np.inf], t, [np.inf]))
        hi, lo = _sigmoid(padded[grades + 1] - score), _sigmoid(padded[grades] - score)
        mass = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
        g_w = np.bincount(columns, ((d_hi - d_lo) / n)[owner], minlength=len(w))
        g_t = np.array(
            [(d_lo[grades == k + 1].sum() - d_hi[grades == k].sum()) / n for k in range(len(t))]
        )
        speed_w = 0.95 * speed_w + 0.05 * g_w**2
        speed_t = 0.95 * speed_t + 0.05 * g_t**2
        rate = RATE / (np.sqrt(speed_w) + 1e-4)
        w = w - rate * g_w
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0.0)
        t = np.sort(t - RATE / (np.sqrt(speed_t) + 1e-4) * g_t)
    return w, t


def train(docs: DataFrame, labels: DataFrame) -> OrdinalModel | None:
    """Fits the model to a bounded sample of labelled documents; None without any."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    graded = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))
    sample = (
        graded.dropna()
        .groupBy("doc_id")
        .agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [
            np.unique(np.array([index_of(f) for f in features(t)], "<i4")).tobytes()
            for t in batch.column(2).to_pylist()
        ]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.binary())],
            ["doc_id", "grade", "found"],
        )

    chosen = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text")
    rows = (
        over_batches(chosen, work, "doc_id long, grade int, found binary").limit(SAMPLE).collect()
    )
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, bytes(r.found)))
    indices = [np.frombuffer(r.found, "<i4") for r in rows]
    return fit(indices, np.array([r.grade for r in rows]))


class _Scorer:
    """Scores texts; remembers the weights of words met, up to a bound."""

    def __init__(self, model: OrdinalModel):
        self.weights, self.known = model.weights, {}

    def __call__(self, text: str) -> float:
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        score = 0.0
        for feature in features(text):
            weight = known.get(feature)
            if weight is None:
                weight = known[feature] = self.weights.get(index_of(feature), 0.0)
            score += weight
        return score


GRADED = StructType(
    [StructField(name, DoubleType()) for name in ("expected_grade", "p_not_toxic", "p_good")]
)


def _grade(model: OrdinalModel | None):
    """Pandas UDF: text -> expected grade and tail probabilities."""

    @F.pandas_udf(GRADED)
    def grade(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(model)
        for text in texts:
            tails = model.tails(np.array([scorer(t) for t in text], dtype=float))
            yield pd.DataFrame(
                {"expected_grade": tails.sum(axis=1), "p_not_toxic": tails[:, 0], "p_good": tails[:, 1]}
            )

    if model is None:
        sure = [F.lit(v).alias(n) for n, v in zip(GRADED.names, (2.0, 1.0, 1.0), strict=True)]
        return lambda _: F.struct(*sure)
    return grade


def score_documents(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """doc_id, expected_grade, p_not_toxic, p_good of every document."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _grade(model)(text_or_empty()).alias("g")
    ).select("doc_id", "g.*")


def keep_good(docs: DataFrame, model: OrdinalModel | None, at: float = KEEP_AT) -> DataFrame:
    """The rows of `docs` whose P(grade >= 2) is at least `at`, with all their columns."""
    if model is None:
        return docs
    graded = docs.select(F.struct("*").alias("row"), _grade(model)(text_or_empty()).alias("g"))
    return graded.where(F.col("g.p_good") >= at).select("row.*")
