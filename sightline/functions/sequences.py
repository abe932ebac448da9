"""Alignment of sequences by exact dynamic time warping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def warped(a: np.ndarray, b: np.ndarray, metric: str) -> tuple[float, int]:
    """Least total cost of a warping path, and the length of one such path (the shortest among equals)."""
    if metric == "cosine":
        na, nb = (np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
        cost = 1 - (a / np.where(na > 0, na, 1)) @ (b / np.where(nb > 0, nb, 1)).T
    else:
        cost = np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))
    n, m = cost.shape
    best, steps = np.full((n + 1, m + 1), np.inf), np.zeros((n + 1, m + 1), dtype=np.int64)
    best[0, 0] = 0.0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            total, length = min((best[i - 1, j - 1], steps[i - 1, j - 1]), (best[i - 1, j], steps[i - 1, j]), (best[i, j - 1], steps[i, j - 1]))
            best[i, j], steps[i, j] = cost[i - 1, j - 1] + total, length + 1
    return float(best[n, m]), int(steps[n, m])


def sequence_similarity(a, b) -> float:
    """1 less the cost for each step, clipped; 0 for an empty sequence. Cosine cost."""
    if a is None or b is None or not len(a) or not len(b):
        return 0.0
    total, length = warped(np.array([list(x) for x in a], dtype=float), np.array([list(x) for x in b], dtype=float), "cosine")
    return 1.0 - float(np.clip(total / length, 0, 1))


def sequence_score(a, b) -> float:
    """1 less a hundredth of the cost for each element of the longer sequence, clamped. Euclidean cost."""
    if a is None or b is None or not len(a) or not len(b):
        return 0.0
    total, _ = warped(np.array([list(x) for x in a], dtype=float), np.array([list(x) for x in b], dtype=float), "euclidean")
    return float(min(1.0, max(0.0, 1.0 - total / max(len(a), len(b)) / 100.0)))


def _of_pairs(f):
    def column(a: Column, b: Column) -> Column:
        @F.pandas_udf("double")
        def values(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([f(x, y) for x, y in zip(a, b)], dtype=float)

        return values(a, b)

    return column


dtw_similarity, dtw_score = _of_pairs(sequence_similarity), _of_pairs(sequence_score)
