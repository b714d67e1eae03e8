"""Small logistic learners on bounded samples, for the classifiers of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold_of

HELD_OUT = 2


def sigmoid(z: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-z)) without overflow."""
    return 0.5 * (1 + np.tanh(0.5 * np.clip(z, -60, 60)))


class Adam:
    """First-order steps with running moments."""

    def __init__(self, size: int, rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient**2 - self.v)
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def fit_dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's logistic weights, the last one for the constant; a ridge of ``l2`` on the others."""
    design = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(design.shape[1])
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-3
    scale = np.ones(len(y)) if weight is None else weight
    for _ in range(rounds if len(y) else 0):
        p = sigmoid(design @ w)
        gradient = design.T @ (scale * (p - y)) + ridge * w
        curve = (design * (scale * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def sums_of(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss at ``w``; ``z`` ends in a column of ones."""
    p = sigmoid(z @ w)
    return z.T @ (p - y), (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``bound`` labelled rows outside the held-out fold (by their id hashes): ``docs`` with ``__y``.

    Labels are sampled first, being the small side, and sent to all tasks.  Labels of one id that disagree count by their
    largest; rows that share an id count once, as the one with the smallest hash, so an id that fills the table is a row.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold_of(F.col(id_col)) != HELD_OUT))
    chosen = usable.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label)).cast("int").alias("__y"))
    chosen = bounded_sample(chosen, bound, "__id")
    found = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id"))
    row = F.struct(*docs.columns, "__y")
    return found.groupBy("__id").agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("__row")).select("__row.*")
