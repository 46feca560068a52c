"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score:
P(grade > k) = sigmoid(w.x - threshold_k). The first threshold is free and each next one is the one before plus the
exponential of a free number, so they can't cross.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linear import BITS, Adam, collect_features, score_blocks, sigmoid, unit_rows

#: Labelled rows that are fitted on at most: those with the smallest hash of their id.
MAX_FIT_ROWS = 4000


@dataclass
class OrdinalModel:
    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > grades[k]) for each k but the last."""
        return sigmoid(score[:, None] - self.thresholds)

    def expected(self, score: np.ndarray) -> np.ndarray:
        if not len(self.grades):
            return np.full(len(score), np.nan)
        return self.grades[0] + self.tails(score) @ np.diff(self.grades)

    def tail(self, score: np.ndarray, at_least: float) -> np.ndarray:
        """P(grade >= at_least)."""
        if not len(self.grades):
            return np.full(len(score), np.nan)
        k = int(np.searchsorted(self.grades, at_least))
        if k == 0:
            return np.ones(len(score))
        return np.zeros(len(score)) if k == len(self.grades) else self.tails(score)[:, k - 1]


def fit_ordinal(indptr, index, value, grade: np.ndarray, *, bits: int = BITS, rounds: int = 150, l2: float = 1e-3) -> OrdinalModel:
    """Maximum likelihood with an L2 prior, by full-batch Adam from a fixed start."""
    grades, y = np.unique(grade.astype(float), return_inverse=True)
    k, n = len(grades), len(y)
    weights = np.zeros(1 << bits)
    if k < 2:
        return OrdinalModel(grades, weights, np.empty(0))
    value = unit_rows(indptr, value)
    used, local = np.unique(index, return_inverse=True)
    local = local.astype(np.int32)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(indptr))
    share = np.cumsum(np.bincount(y, minlength=k))[:-1] / n
    start = np.log(share / (1 - share))
    x = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m = len(used)
    adam = Adam(len(x), 0.1)
    for _ in range(rounds):
        w, free = x[:m], x[m:]
        theta = np.concatenate([[-np.inf], np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])), [np.inf]])
        eta = np.bincount(row, value * w[local], n)
        hi, lo = sigmoid(theta[y + 1] - eta), sigmoid(theta[y] - eta)
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_eta = (d_hi - d_lo) / n
        g_theta = (np.bincount(y, -d_hi, k)[: k - 1] + np.bincount(y - 1 + (y == 0) * k, d_lo * (y > 0), k)[: k - 1]) / n
        back = np.cumsum(g_theta[::-1])[::-1]  # each threshold moves all above it
        g_free = np.concatenate([back[:1], back[1:] * np.exp(free[1:])])
        g_w = np.bincount(local, value * g_eta[row], m) + l2 / n * w
        x = adam.step(x, np.concatenate([g_w, g_free]))
    weights[used] = x[:m]
    return OrdinalModel(grades, weights, np.cumsum(np.concatenate([x[m : m + 1], np.exp(x[m + 1 :])])))


def fit_quality(docs: DataFrame, labels: DataFrame, *, text_col="text", id_col="doc_id", grade_col="quality", max_rows: int = MAX_FIT_ROWS) -> OrdinalModel:
    """Fits on the labelled rows with the smallest hash of their id, ``max_rows`` at most; null grades are left out."""
    chosen = labels.filter(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_sm_id"), F.col(grade_col).cast("double").alias("_sm_grade"))
    chosen = chosen.orderBy(F.md5(F.col("_sm_id").cast("string")), "_sm_id", "_sm_grade").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_sm_id"), F.coalesce(text_col, F.lit("")).alias("_sm_text")).join(F.broadcast(chosen), "_sm_id")
    indptr, index, value, labels_ = collect_features(rows, "_sm_text", ["_sm_grade"])
    return fit_ordinal(indptr, index, value, labels_["_sm_grade"])


def score_quality(docs: DataFrame, model: OrdinalModel, *, text_col: str = "text", at_least: float | None = None) -> DataFrame:
    """Every column of ``docs`` plus ``expected_grade`` and ``tail_probability`` (of a grade of ``at_least``, by default the highest).

    Null and empty texts have no features and get what the thresholds alone say. Without any label both are
    null. Rows are scored one by one from whole texts, so repeated rows get equal scores; nothing is shuffled.
    """
    docs = docs.drop("expected_grade", "tail_probability")
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    least = at_least if at_least is not None else (float(model.grades[-1]) if len(model.grades) else 0.0)

    def run(batches):
        m = sent.value
        for batch in batches:
            score = score_blocks(batch.column(at), m.weights)
            more = [pa.array(x, pa.float64(), from_pandas=True) for x in (m.expected(score), m.tail(score, least))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "expected_grade", "tail_probability"])

    fields = [T.StructField(c, T.DoubleType()) for c in ("expected_grade", "tail_probability")]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
