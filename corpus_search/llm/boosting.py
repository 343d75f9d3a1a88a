"""Gradient boosted trees of depth two on counted cells of small integer features.

The rows to learn from come as one line per distinct feature vector with its number of positive and
negative rows, so training takes all rows of a corpus at the cost of its distinct vectors, and a
model is a handful of comparisons that turn into one column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 20
RATE = 0.3
RIDGE = 1.0


@dataclass
class Tree:
    """`feature <= cut` goes left; a leaf has no feature."""

    value: float = 0.0
    feature: int = -1
    cut: int = 0
    left: Tree | None = None
    right: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.left.predict(x), self.right.predict(x))

    def column(self, features: list[Column]) -> Column:
        if self.feature < 0:
            return F.lit(float(self.value))
        test = features[self.feature] <= self.cut
        return F.when(test, self.left.column(features)).otherwise(self.right.column(features))


def grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int) -> Tree:
    whole = slope.sum() ** 2 / (curve.sum() + RIDGE)
    best = (1e-9, -1, 0)
    for f in range(x.shape[1] if depth else 0):
        values, index = np.unique(x[:, f], return_inverse=True)
        g = np.cumsum(np.bincount(index, slope, len(values)))[:-1]
        h = np.cumsum(np.bincount(index, curve, len(values)))[:-1]
        gain = g**2 / (h + RIDGE) + (slope.sum() - g) ** 2 / (curve.sum() - h + RIDGE) - whole
        if len(gain) and gain.max() > best[0]:
            best = (gain.max(), f, int(values[np.argmax(gain)]))
    if best[1] < 0:
        return Tree(RATE * slope.sum() / (curve.sum() + RIDGE))
    on = x[:, best[1]] <= best[2]
    return Tree(
        0.0,
        best[1],
        best[2],
        grow(x[on], slope[on], curve[on], depth - 1),
        grow(x[~on], slope[~on], curve[~on], depth - 1),
    )


def boost(x: np.ndarray, yes: np.ndarray, no: np.ndarray) -> list[Tree]:
    """Trees whose sum is the log-odds of a positive row."""
    trees, margin, n = [], np.zeros(len(x)), yes + no
    for _ in range(ROUNDS if len(x) else 0):
        p = 1 / (1 + np.exp(-margin))
        trees.append(grow(x, yes - n * p, n * p * (1 - p), 2))
        margin += trees[-1].predict(x)
    return trees


def margin(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return sum((t.predict(x) for t in trees), np.zeros(len(x)))


def calibrated(m: np.ndarray, yes: np.ndarray, no: np.ndarray) -> tuple[float, float]:
    """Slope and constant of the probability of held-back rows given their margin."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, w = yes - (yes + no) * p, (yes + no) * p * (1 - p) + 1e-9
        h = np.array([[(w * m * m).sum() + 1, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * m).sum() - (a - 1), g.sum()])
        a, b = a + step[0], b + step[1]
    return max(a, 1e-3), b


def least_probability(p: np.ndarray, yes: np.ndarray, no: np.ndarray, precision: float) -> float:
    """The smallest probability from which on the held-back rows are right often enough; over 1 if
    there is none."""
    order = np.argsort(-p, kind="stable")
    p, good = p[order], np.cumsum(yes[order])
    last = np.append(p[1:] != p[:-1], True) if len(p) else np.zeros(0, bool)
    fine = last & (good >= precision * np.cumsum((yes + no)[order])) & (good > 0)
    return float(p[np.flatnonzero(fine)[-1]]) if fine.any() else 2.0
