"""Least squares on folds without refits.

Every linear model of degree-2 terms needs only sums of products of the terms
and the label.  One aggregate over the rows gives those sums per group (fold or
split); a training set is the total minus the held-out group, so a grid of any size over any
number of folds costs no further pass.  Scaling is refitted per training set: the terms
of standardised features are linear in the raw ones, so their sums follow by a change of
basis.  Matrices are k x k, whatever the table.

Features are shifted and scaled once by their overall mean and deviation before products
are taken, which keeps the sums well conditioned.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.operators.features import polynomial_name, polynomial_terms
from limnos.operators.profile import q

REDUCERS = 8


@dataclass
class GroupMoments:
    """Sums of products [1, terms, y] per group; terms are all monomials of the scaled features."""
    features: list[str]
    terms: list[tuple[int, ...]]          # of feature positions, degree 1 first
    sums: dict[int, np.ndarray]

    def of(self, groups) -> np.ndarray:
        size = len(self.terms) + 2
        return sum((self.sums[g] for g in groups if g in self.sums), np.zeros((size, size)))

    def only(self, features: Sequence[str]) -> GroupMoments:
        """The sums of the terms of some features."""
        at = {self.features.index(c): k for k, c in enumerate(features)}
        kept = [k for k, t in enumerate(self.terms) if set(t) <= set(at)]
        terms = [tuple(sorted(at[i] for i in self.terms[k])) for k in kept]
        order = sorted(range(len(kept)), key=lambda k: (len(terms[k]), terms[k]))
        rows = [0, *(1 + kept[k] for k in order), len(self.terms) + 1]
        return GroupMoments(list(features), [terms[k] for k in order], {g: s[np.ix_(rows, rows)] for g, s in self.sums.items()})

    def names(self) -> list[str]:
        return [polynomial_name([self.features[i] for i in t]) for t in self.terms]

    def standardised(self, train: np.ndarray) -> np.ndarray:
        """Change of basis to the terms of features standardised on ``train``."""
        p, size = len(self.features), len(self.terms) + 2
        at = {t: 1 + k for k, t in enumerate(self.terms)}
        n = train[0, 0]
        mean = train[0, 1:p + 1] / n
        # variances from centred sums: G - n m m' has no cancellation left after the overall shift
        sd = np.sqrt(np.maximum(np.diag(train)[1:p + 1] / n - mean ** 2, 0.0))
        sd = np.where(sd > 0, sd, 1.0)
        one = np.zeros((p, size))
        for i in range(p):
            one[i, at[(i,)]], one[i, 0] = 1 / sd[i], -mean[i] / sd[i]
        out = np.zeros((size, size))
        out[0, 0] = out[-1, -1] = 1.0
        for t, row in at.items():
            if len(t) == 1:
                out[row] = one[t[0]]
            else:
                i, j = t
                out[row, at[t]] = 1 / (sd[i] * sd[j])
                out[row, at[(i,)]] += -mean[j] / (sd[i] * sd[j])
                out[row, at[(j,)]] += -mean[i] / (sd[i] * sd[j])
                out[row, 0] = mean[i] * mean[j] / (sd[i] * sd[j])
        return out


def group_moments(df: DataFrame, features: Sequence[str], label: str, group: str | None = None,
                  degree: int = 2) -> GroupMoments:
    """One pass for the shift, one for the sums; rows with a NULL feature or label are dropped.

    ``group``: an integer column (one group 0 without it)."""
    features = list(features)
    p = len(features)
    data = df.select((F.lit(0) if group is None else F.col(q(group)).cast("int")).alias("g"),
                     *(F.col(q(c)).cast("double").alias(f"x{i}") for i, c in enumerate(features)),
                     F.col(q(label)).cast("double").alias("y")).na.drop()
    row = data.agg(*(f(f"x{i}").alias(f"{n}{i}") for i in range(p) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    shift = np.array([row[f"m{i}"] or 0.0 for i in range(p)])
    scale = np.array([row[f"s{i}"] or 1.0 for i in range(p)])
    place = {c: i for i, c in enumerate(features)}
    terms = [tuple(place[c] for c in t) for t in polynomial_terms(features, degree)]
    terms.sort(key=len)
    size = len(terms) + 2

    def add(batches):
        sums = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0).to_numpy()
            u = (np.stack([batch.column(1 + i).to_numpy() for i in range(p)], axis=1) - shift) / scale
            t = np.ones((len(g), size))
            for k, term in enumerate(terms):
                t[:, 1 + k] = u[:, list(term)].prod(axis=1)
            t[:, -1] = batch.column(1 + p).to_numpy()
            for value in np.unique(g).tolist():
                part = t[g == value]
                sums[value] = sums.get(value, 0.0) + part.T @ part
        yield _sum_batch(sums)

    def merge(batches):
        sums = {}
        for batch in batches:
            for g, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[g] = sums.get(g, 0.0) + np.frombuffer(data).reshape(size, size)
        yield _sum_batch(sums)

    found = data.mapInArrow(add, "g int, sums binary").repartition(REDUCERS, "g").mapInArrow(merge, "g int, sums binary")
    return GroupMoments(features, terms, {r["g"]: np.frombuffer(r["sums"]).reshape(size, size) for r in found.collect()})


def _sum_batch(sums: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"g": pa.array(list(sums), pa.int32()), "sums": pa.array(
        [np.ascontiguousarray(s).tobytes() for s in sums.values()], pa.binary())})


# ------------------------------------------------------------ solving on sums

def centred(sums: np.ndarray, chosen: Sequence[int]) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray, float]:
    """(n, means, mean of y, centred products, centred products with y, centred y y) of the chosen terms."""
    at = [1 + c for c in chosen]
    n = sums[0, 0]
    m, my = sums[0, at] / n, sums[0, -1] / n
    return n, m, my, sums[np.ix_(at, at)] - n * np.outer(m, m), sums[at, -1] - n * m * my, sums[-1, -1] - n * my * my


def k_best(sums: np.ndarray, terms: int, k: int | None) -> list[int]:
    """The ``k`` terms of highest |correlation| with the label (ties: the first), in order; all if fewer."""
    chosen = list(range(terms))
    if k is None or k >= terms:
        return chosen
    n, _, _, a, b, yy = centred(sums, chosen)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.abs(b) / np.sqrt(np.diag(a) * yy)
    score = np.where(np.isfinite(score), np.round(score, 12), -1.0)
    return sorted(sorted(chosen, key=lambda c: -score[c])[:k])


def soft(x, t):
    return np.sign(x) * np.maximum(np.abs(x) - t, 0.0)


def coordinate_descent(a: np.ndarray, b: np.ndarray, n: float, alpha: float, l1_ratio: float, start: np.ndarray | None = None,
                       tol: float = 1e-12, rounds: int = 100_000) -> np.ndarray:
    """Minimum of (1/2n)|y - Xw|^2 + alpha (l1 |w| + (1 - l1)/2 |w|^2) from centred products (covariance updates)."""
    a, b = a / n, b / n
    w = np.zeros(len(b)) if start is None else start.copy()
    grad = b - a @ w
    d = np.diag(a)
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(w)):
            if d[j] <= 0:
                continue
            new = soft(grad[j] + d[j] * w[j], alpha * l1_ratio) / (d[j] + alpha * (1 - l1_ratio))
            step = new - w[j]
            if step:
                grad -= a[:, j] * step
                w[j] = new
                moved = max(moved, abs(step) * np.sqrt(d[j]))
        if moved <= tol:
            break
    return w


def solve(sums: np.ndarray, chosen: Sequence[int], kind: str = "ridge", alpha: float = 1.0, l1_ratio: float = 0.5,
          start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(weights, intercept) of a linear kind on the chosen terms."""
    n, m, my, a, b, _ = centred(sums, chosen)
    if kind == "ridge":
        w = np.linalg.solve(a + alpha * np.eye(len(b)), b)
    elif kind in ("linear", "polynomial"):
        w = np.linalg.lstsq(a, b, rcond=None)[0]
    else:
        w = coordinate_descent(a, b, n, alpha, 1.0 if kind == "lasso" else l1_ratio, start)
    return w, float(my - m @ w)


def errors(sums: np.ndarray, chosen: Sequence[int], w: np.ndarray, intercept: float) -> tuple[int, float, float]:
    """(n, mse, R^2) of a fit on the rows behind ``sums``."""
    c = np.zeros(len(sums))
    c[0], c[-1] = -intercept, 1.0
    c[[1 + k for k in chosen]] = -w
    n = sums[0, 0]
    sse = float(c @ sums @ c)
    sst = sums[-1, -1] - sums[0, -1] ** 2 / n
    return int(n), sse / n, 1.0 - sse / sst if sst > 0 else float("nan")


LINEAR_KINDS = ("linear", "polynomial", "ridge", "lasso", "elastic_net")


def fit_points(moments: GroupMoments, train, test, kind: str, points: Sequence[dict]) -> list[tuple[int, float, float]]:
    """(n, mse, R^2) on the ``test`` groups of every grid point fitted on the ``train`` groups.

    Points may set degree, k_best, alpha and l1_ratio.  Penalised paths go from the largest alpha down, each
    starting at the last one's weights."""
    fit, held = moments.of(train), moments.of(test)
    basis = moments.standardised(fit)
    fit, held = basis @ fit @ basis.T, basis @ held @ basis.T
    first = len(moments.features)
    out: list = [None] * len(points)
    warm: dict = {}
    for k in sorted(range(len(points)), key=lambda k: -points[k].get("alpha", 1.0)):
        p = points[k]
        degree = p.get("degree", 2 if kind == "polynomial" else 1)
        chosen = k_best(fit, len(moments.terms) if degree > 1 else first, p.get("k_best"))
        path = (degree, p.get("k_best"), p.get("l1_ratio"))
        w, b = solve(fit, chosen, kind, p.get("alpha", 1.0), p.get("l1_ratio", 0.5), warm.get(path))
        warm[path] = w
        out[k] = errors(held, chosen, w, b)
    return out


def penalised_path(df: DataFrame, features: Sequence[str], label: str, kind: str = "lasso",
                   alphas: Sequence[float] = (1.0, 0.1, 0.01, 0.001), l1_ratios: Sequence[float] = (0.5,),
                   degree: int = 1) -> DataFrame:
    """M4 / M5: coefficients of the standardised terms along a path of penalties, from one aggregate.

    -> (l1_ratio, alpha, term, coefficient, intercept); lasso has l1_ratio 1.  Each fit starts at the weights
    of the next larger alpha."""
    moments = group_moments(df, features, label, degree=degree)
    sums = moments.of([0])
    basis = moments.standardised(sums)
    sums = basis @ sums @ basis.T
    chosen = range(len(moments.terms))
    rows = []
    for ratio in (1.0,) if kind == "lasso" else l1_ratios:
        w = None
        for alpha in sorted(alphas, reverse=True):
            w, b = solve(sums, chosen, kind, alpha, ratio, w)
            rows += [(float(ratio), float(alpha), name, float(c), b) for name, c in zip(moments.names(), w, strict=True)]
    return df.sparkSession.createDataFrame(rows, "l1_ratio double, alpha double, term string, coefficient double, intercept double")
