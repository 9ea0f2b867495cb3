"""Small linear models, trained on the driver from bounded samples, in NumPy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 300, rate: float = 0.5, counted: np.ndarray | None = None, around: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression by Adam over the whole sample, or the rows ``counted`` (flags or shares); the ridge pulls to 0 or ``around``.

    The step falls to 0, so that the end does not depend on rounding.
    """
    d = x.shape[1]
    part = np.ones(len(x)) if counted is None else counted.astype(float)
    part /= max(part.sum(), 1.0)
    centre = np.zeros(d) if around is None else around
    w, b = centre.copy(), 0.0
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        error = (sigmoid(x @ w.astype(x.dtype) + b) - y) * part
        g = np.append(error.astype(x.dtype) @ x + penalty * (w - centre), error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def bounded_sample(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """About ``most`` of ``rows`` at most, chosen by the hash of ``key``: the same rows at every run."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * most / n))
