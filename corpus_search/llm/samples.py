"""Bounded samples of labelled rows, and small numpy fits on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(labels: DataFrame, label: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label): at most `most` labelled ids, those with the smallest hashes. Null ids and labels
    are left out; of an id with several labels the largest counts."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("double").alias("label"))
    return known.orderBy(F.xxhash64("id"), "id").limit(most)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights (the last is the constant) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + keep * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1, in the middle of its gap between two probabilities."""
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    last = np.append(p[1:] != p[:-1], True)
    f1 = np.where(last, 2 * hits / (np.arange(1, len(p) + 1) + max(1, y.sum())), -1)
    i = int(np.argmax(f1))
    return float((p[i] + (p[i + 1] if i + 1 < len(p) else 0)) / 2)
