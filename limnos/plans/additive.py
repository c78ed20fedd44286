"""Additive smooth models with a chosen smoothness (M9).

y = intercept + s_1(x_1) + ... ; every s_j is a cubic spline on equal intervals with a penalty on the second
differences of its coefficients, and sums to zero over the rows.  Fit, penalties and every statistic need only the
sums of products of the basis: one aggregate gives the ranges, one the sums (a vector per task), and matrices of
``basis`` x features are solved on them.  The smoothing parameters minimise the restricted likelihood (``REML``)
or generalised cross-validation (``GCV``).

Scoring is a piecewise cubic of built-in expressions; values outside the fitted range take the value at its end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.operators.profile import q
from limnos.plans.moments import REDUCERS, _sum_batch

# cubic B-spline pieces on a unit interval: row = function, column = power of the position
PIECES = np.array([[1, -3, 3, -1], [4, 0, -6, 3], [1, 3, 3, -3], [0, 0, 0, 1]]) / 6.0
SPAN = (-15.0, 20.0)        # of the log smoothing parameters


def spline_basis(x: np.ndarray, lo: float, hi: float, basis: int) -> np.ndarray:
    """(rows, basis) values of the cubic B-splines on ``basis`` - 3 equal intervals."""
    parts = basis - 3
    u = (np.clip(x, lo, hi) - lo) / (hi - lo) * parts
    at = np.minimum(u.astype(int), parts - 1)
    powers = (u - at)[:, None] ** np.arange(4)
    out = np.zeros((len(x), basis))
    out[np.arange(len(x))[:, None], at[:, None] + np.arange(4)] = powers @ PIECES.T
    return out


@dataclass
class AdditiveModel:
    features: list[str]
    label: str
    ranges: list[tuple[float, float]]
    intercept: float
    coefficients: list[np.ndarray]          # of each feature's basis
    lambdas: list[float]
    edf: list[float]
    wald: list[float]
    summary: dict

    def smooth(self, i: int):
        """The value of the i-th smooth as a column expression."""
        lo, hi = self.ranges[i]
        coefs = self.coefficients[i]
        parts = len(coefs) - 3
        x = F.col(q(self.features[i])).cast("double")
        u = F.when(x.isNotNull() & ~F.isnan(x), (F.greatest(F.least(x, F.lit(hi)), F.lit(lo)) - lo) / (hi - lo) * parts)
        at = F.least(F.floor(u), F.lit(parts - 1)).cast("int")
        t = u - at
        cubic = np.stack([coefs[j:j + 4] @ PIECES for j in range(parts)])
        out = F.lit(0.0)
        for power in (3, 2, 1, 0):
            out = out * t + F.get(F.array(*[F.lit(float(c)) for c in cubic[:, power]]), at)
        return out

    def transform(self, df: DataFrame, prediction: str = "prediction", terms: bool = False) -> DataFrame:
        """``df`` with the prediction (NULL where a feature is NULL or NaN) and, with ``terms``, ``s_<feature>``."""
        parts = [self.smooth(i) for i in range(len(self.features))]
        out = df.withColumn(prediction, sum(parts, F.lit(self.intercept)))
        return out.withColumns({f"s_{c}": p for c, p in zip(self.features, parts, strict=True)}) if terms else out

    def terms(self, spark: SparkSession) -> DataFrame:
        """-> (term, edf, lambda, wald): effective degrees of freedom, smoothing parameter, Wald statistic per degree."""
        rows = [(c, float(e), float(v), float(w)) for c, e, v, w in zip(self.features, self.edf, self.lambdas, self.wald, strict=True)]
        return spark.createDataFrame(rows, "term string, edf double, lambda double, wald double")


def _basis_sums(data: DataFrame, ranges, basis: int, centre: float) -> np.ndarray:
    """Sums of products of [1, basis of every feature, y - centre]."""
    k = len(ranges)
    size = 2 + k * basis

    def add(batches):
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                cols = [np.ones((batch.num_rows, 1))]
                cols += [spline_basis(batch.column(i).to_numpy(), *ranges[i], basis) for i in range(k)]
                t = np.hstack([*cols, batch.column(k).to_numpy()[:, None] - centre])
                total += t.T @ t
        yield _sum_batch({0: total})

    def merge(batches):
        total = 0.0
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                total = total + np.frombuffer(raw).reshape(size, size)
        yield _sum_batch({} if isinstance(total, float) else {0: total})

    # two levels: each merging task holds one sum, the driver adds up a fixed number of them
    found = (data.mapInArrow(add, "g int, sums binary").repartition(REDUCERS).mapInArrow(merge, "g int, sums binary").collect())
    return sum(np.frombuffer(r["sums"]).reshape(size, size) for r in found)


def _minimum(f, lo: float, hi: float, points: int = 15, steps: int = 40) -> float:
    """Where a function of one number is least: the best of a grid, then golden sections around it."""
    grid = np.linspace(lo, hi, points)
    i = int(np.argmin([f(v) for v in grid]))
    a, b = grid[max(i - 1, 0)], grid[min(i + 1, points - 1)]
    ratio = (math.sqrt(5) - 1) / 2
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(steps):
        if fc <= fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = f(d)
    return (a + b) / 2


def choose_smoothness(a: np.ndarray, b: np.ndarray, yy: float, n: float, penalties: Sequence[np.ndarray], ranks: Sequence[int],
                      method: str, sweeps: int = 60) -> np.ndarray:
    """Log smoothing parameters that minimise the criterion, one at a time in turn."""
    rho = np.zeros(len(penalties))
    fixed = 1 + len(b) - sum(ranks)

    def score(at):
        p = a + sum(math.exp(r) * s for r, s in zip(at, penalties, strict=True))
        w = np.linalg.solve(p, b)
        if method == "GCV":
            edf = 1 + np.trace(np.linalg.solve(p, a))
            return math.log(max(yy - 2 * w @ b + w @ a @ w, 1e-300)) - 2 * math.log(max(n - edf, 1e-300))
        fit = max(yy - b @ w, 1e-300)
        return ((n - fixed) * math.log(fit) + np.linalg.slogdet(p)[1] - float(np.dot(ranks, at))) / 2

    def along(j, v):
        at = rho.copy()
        at[j] = v
        return score(at)

    for _ in range(sweeps):
        before = rho.copy()
        for j in range(len(rho)):
            rho[j] = _minimum(lambda v, j=j: along(j, v), *SPAN)
        if np.abs(rho - before).max() < 1e-4:
            break
    return rho


def fit_additive(df: DataFrame, features: Sequence[str], label: str, basis: int = 10, method: str = "REML") -> AdditiveModel:
    """M9; rows with a NULL feature or label are dropped, a constant feature is refused."""
    if method not in ("REML", "GCV"):
        raise ValueError(f"unknown method {method}; choose REML or GCV")
    if basis < 5:
        raise ValueError("a smooth needs a basis of 5 functions or more")
    features = list(features)
    k = len(features)
    data = df.select(*(F.col(q(c)).cast("double").alias(f"x{i}") for i, c in enumerate(features)),
                     F.col(q(label)).cast("double").alias("y")).na.drop()
    row = data.agg(F.avg("y").alias("m"), *(f(f"x{i}").alias(f"{n}{i}") for i in range(k) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    ranges = [(row[f"lo{i}"], row[f"hi{i}"]) for i in range(k)]
    for c, (lo, hi) in zip(features, ranges, strict=True):
        if lo is None or not lo < hi:
            raise ValueError(f"feature {c} has no two values")
    sums = _basis_sums(data, ranges, basis, row["m"])
    n = float(sums[0, 0])
    # coefficients free of each smooth's mean: the null space of the basis' column means
    differences = np.diff(np.eye(basis), 2, axis=0)
    free = [np.linalg.qr(sums[0, 1 + i * basis:1 + (i + 1) * basis][:, None], "complete")[0][:, 1:] for i in range(k)]
    change = np.zeros((k * basis, k * (basis - 1)))
    for i in range(k):
        change[i * basis:(i + 1) * basis, i * (basis - 1):(i + 1) * (basis - 1)] = free[i]
    a = change.T @ sums[1:-1, 1:-1] @ change
    b = change.T @ (sums[1:-1, -1] - sums[1:-1, 0] * (sums[0, -1] / n))
    yy = float(sums[-1, -1] - sums[0, -1] ** 2 / n)
    penalties = []
    for i in range(k):
        own = slice(i * (basis - 1), (i + 1) * (basis - 1))
        s = np.zeros_like(a)
        s[own, own] = free[i].T @ differences.T @ differences @ free[i]
        penalties.append(s * (np.trace(a[own, own]) / np.trace(s)))
    rho = choose_smoothness(a, b, yy, n, penalties, [basis - 2] * k, method)
    p = a + sum(math.exp(r) * s for r, s in zip(rho, penalties, strict=True))
    w = np.linalg.solve(p, b)
    hat = np.diag(np.linalg.solve(p, a))
    rss = max(float(yy - 2 * w @ b + w @ a @ w), 0.0)
    edf = 1 + float(hat.sum())
    scale = rss / (n - edf) if n > edf else float("nan")
    cov = np.linalg.inv(p) * scale
    own = [slice(i * (basis - 1), (i + 1) * (basis - 1)) for i in range(k)]
    parts = [float(hat[o].sum()) for o in own]
    wald = [float(w[o] @ np.linalg.solve(cov[o, o], w[o])) / e if scale > 0 else float("nan") for o, e in zip(own, parts, strict=True)]
    share = 1 - rss / yy if yy > 0 else float("nan")
    return AdditiveModel(
        features, label, ranges, float(row["m"] + sums[0, -1] / n), [free[i] @ w[o] for i, o in enumerate(own)],
        [math.exp(r) for r in rho], parts, wald,
        {"n": int(n), "edf": edf, "deviance_explained": share, "scale": scale,
         "adj_r2": 1 - scale * (n - 1) / yy if yy > 0 else float("nan")})
