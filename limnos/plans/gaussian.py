"""Joint fit of a mean and a log-variance.

y ~ N(X b, exp(Z c)): the mean is linear in the standardised features or their degree-2
terms, the log-variance linear in the standardised features.  Two steps alternate, each a
pass that adds up k x k sums and lowers the mean negative log-likelihood:

* weighted least squares for b with weights 1 / variance (its exact minimum), and
* a scoring step for c, that of a Gamma model with log link on the squared residuals,
  halved as long as the likelihood would get worse.

The fit ends when a round lowers the likelihood by less than ``tol``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame

LOG_2PI = math.log(2 * math.pi)
FLOOR = 1e-12           # least variance


def _summed(data: DataFrame, size: int, part) -> np.ndarray:
    """Sum over batches of ``part(columns)``, a vector of ``size`` numbers; one vector per task reaches the driver."""
    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(np.stack([c.to_numpy() for c in batch.columns], axis=1))
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    return sum((np.frombuffer(r["v"]) for r in data.mapInArrow(add, "v binary").collect()), np.zeros(size))


def design(x: np.ndarray, pairs: Sequence[tuple[int, int]]) -> np.ndarray:
    """Columns 1, the features and the products of the pairs."""
    return np.column_stack([np.ones(len(x)), x, *(x[:, i] * x[:, j] for i, j in pairs)])


def weighted_least_squares(data: DataFrame, p: int, pairs: Sequence[tuple[int, int]], variance) -> np.ndarray:
    """Minimum of sum (y - X b)^2 / variance; ``data`` holds the p features, then the label."""
    k = 1 + p + len(pairs)

    def part(v):
        x = design(v[:, :p], pairs)
        w = 1.0 / variance(v[:, :p])
        return np.concatenate([(x.T @ (x * w[:, None])).reshape(-1), x.T @ (w * v[:, p])])

    total = _summed(data, k * k + k, part)
    return np.linalg.lstsq(total[:k * k].reshape(k, k), total[k * k:], rcond=None)[0]


def fit_joint(data: DataFrame, p: int, pairs: Sequence[tuple[int, int]], rounds: int = 50,
              tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(mean coefficients, log-variance coefficients, likelihood after every step)."""
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    k = 1 + p

    def variance_of(c):
        return lambda x: np.maximum(np.exp(np.clip(design(x, ()) @ c, -600, 600)), FLOOR)

    def step_sums(b, c):
        """n, likelihood, score and information of the log-variance at (b, c)."""
        def part(v):
            z = design(v[:, :p], ())
            eta = np.clip(z @ c, math.log(FLOOR), 600)
            ratio = (v[:, p] - design(v[:, :p], pairs) @ b) ** 2 * np.exp(-eta)
            return np.concatenate([[len(v), 0.5 * (LOG_2PI + eta + ratio).sum()], z.T @ (ratio - 1) / 2, (z.T @ z / 2).reshape(-1)])
        total = _summed(data, 2 + k + k * k, part)
        return total[0], total[1] / total[0], total[2:2 + k], total[2 + k:].reshape(k, k)

    try:
        c = np.zeros(k)
        b = weighted_least_squares(data, p, pairs, variance_of(c))
        # start at the constant variance
        n, nll, score, info = step_sums(b, c)
        c[0] = math.log(max(1.0 + 2.0 * score[0] / n, FLOOR))
        n, nll, score, info = step_sums(b, c)
        trace = [nll]
        for _ in range(rounds):
            before = trace[-1]
            size = 1.0
            move = np.linalg.lstsq(info, score, rcond=None)[0]
            while size > 1e-4:
                found = step_sums(b, c + size * move)
                if found[1] <= trace[-1]:
                    c = c + size * move
                    trace.append(found[1])
                    break
                size /= 2
            new = weighted_least_squares(data, p, pairs, variance_of(c))
            found = step_sums(new, c)
            if found[1] <= trace[-1]:
                b = new
                trace.append(found[1])
            else:
                found = step_sums(b, c)
            n, nll, score, info = found
            if before - trace[-1] < tol:
                break
    finally:
        data.unpersist()
    return b, c, trace
