"""Whitening of embeddings: leading components of the covariance, and each vector's whitened coordinates.

Entries are put on a grid: a vector's entry c becomes floor(scale * c), a whole number.
The components are fitted on each distinct grid vector once (the fit list), so a vector
that a third of the rows repeat counts once.

1. A scan checks the vectors and packs their whole numbers in 2, 4 or 8 bytes an entry;
   a distinct over the packed bytes gives the fit list.  Both are written.
2. One pass sums the fit list exactly; a second one sums the products of the centred
   vectors, a d x d matrix per task, which reducers add up row by row.
3. The driver, which holds only that d x d matrix, makes it tridiagonal by Householder
   reflections, finds the leading eigenvalues by bisection on Sturm counts and their
   vectors by inverse iteration, made orthogonal again within clusters of close
   eigenvalues.
4. The d x k projection is broadcast, and each row is projected where it lies.

Defined results: a vector that is NULL or empty, or holds NULL or non-finite entries,
takes no part; nor does one whose length is not that of most rows (of the longer, if
two lengths tie).  Whole numbers end at +-2**53.  A component whose eigenvalue is below
1e-11 of the trace has no spread to divide by and is left out; so a single distinct vector
gives no component.  An exact ``deviation`` beyond 64 bits is NULL.  A NULL id stays;
rows that repeat are rows of their own; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.runtime import cut_lineage, ship, sum_parts, vector_parts

SCALE = 64
LIMIT = 1 << 53
LOW_BITS = 26           # sums are kept in two halves, so they stay exact
LEAST_SHARE = 1e-11
REDUCERS = 16


# ------------------------------------------------------------ whole-number vectors

def _pack(y: np.ndarray) -> list[bytes]:
    """Each row of whole numbers in the narrowest of 2, 4 or 8 bytes an entry (by its own range)."""
    top = np.maximum(y.max(axis=1), -1 - y.min(axis=1)) if y.shape[1] else np.zeros(len(y), np.int64)
    out = np.empty(len(y), object)
    for kind, lo, hi in (("<i2", -1, 1 << 15), ("<i4", 1 << 15, 1 << 31), ("<i8", 1 << 31, 1 << 63)):
        rows = np.flatnonzero((top >= lo) & (top < hi) if lo > 0 else top < hi)
        if len(rows):
            raw = y[rows].astype(kind).tobytes()
            size = y.shape[1] * np.dtype(kind).itemsize
            out[rows] = [raw[k:k + size] for k in range(0, len(raw), size)]
    return out.tolist()


def unpack(col, dim: int) -> np.ndarray:
    """The whole numbers of a binary column, as (rows, dim)."""
    raw = col.to_pylist()
    width = np.array([len(x) // dim for x in raw])
    out = np.zeros((len(raw), dim), np.int64)
    for w in (2, 4, 8):
        rows = np.flatnonzero(width == w)
        if len(rows):
            out[rows] = np.frombuffer(b"".join([raw[k] for k in rows.tolist()]), f"<i{w}").reshape(-1, dim)
    return out


def grid_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, x) of the rows that take part, ``x`` packed."""

    def run(batches):
        for batch in batches:
            ids, col = batch.column(0), batch.column(1)
            values = pc.cast(pc.list_flatten(col), pa.float64())
            length = pc.fill_null(pc.list_value_length(col), 0).to_numpy().astype(np.int64)
            good = pc.fill_null(pc.is_finite(values), False).to_numpy(zero_copy_only=False)
            flat = np.where(good, pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False), 0.0)
            begin = np.cumsum(length) - length
            bad = np.concatenate([[0], np.cumsum(~good)])
            fit = (length > 0) & (bad[begin + length] == bad[begin])
            grid = np.clip(np.floor(scale * flat), -LIMIT, LIMIT).astype(np.int64)
            for dim in np.unique(length[fit]).tolist():
                rows = np.flatnonzero(fit & (length == dim))
                y = grid[begin[rows][:, None] + np.arange(dim)]
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids.take(pa.array(rows)), "dim": pa.array(np.full(len(rows), dim, np.int32)),
                    "x": pa.array(_pack(y), pa.binary())})

    ship(vectors.sparkSession)
    narrow = vectors.select(vectors[id_col].cast("long").alias("vec_id"),
                            vectors[vec_col].cast("array<double>").alias("v"))
    return narrow.mapInArrow(run, "vec_id long, dim int, x binary")


# ------------------------------------------------------------ eigenvectors of a bounded matrix

def tridiagonal(matrix: np.ndarray):
    """(diagonal, off-diagonal, reflectors): Householder reflections of a symmetric matrix."""
    a, mirrors = np.array(matrix, float), []
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if not np.any(v[1:]):
            mirrors.append(None)
            continue
        end = -size if v[0] >= 0 else size
        v[0] -= end
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = 2.0 * (p - (p @ v) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1, k] = a[k, k + 1] = end
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def sturm_count(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``."""
    tiny = np.finfo(float).tiny
    q = diagonal[0] - at
    count = (q < 0).astype(int)
    for d, e in zip(diagonal[1:], off, strict=True):
        q = d - at - e * e / np.where(np.abs(q) < tiny, tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected down to neighbouring doubles."""
    n = len(diagonal)
    reach = np.append(np.abs(off), 0) + np.append(0, np.abs(off))
    lo = np.full(k, (diagonal - reach).min())
    hi = np.full(k, (diagonal + reach).max() * (1 + 1e-15) + np.finfo(float).tiny)
    below = n - 1 - np.arange(k)
    for _ in range(1100):       # ends by itself when no double lies between
        mid = lo + (hi - lo) / 2
        open_ = (mid > lo) & (mid < hi)
        if not open_.any():
            break
        up = sturm_count(diagonal, off, mid) <= below
        lo, hi = np.where(open_ & up, mid, lo), np.where(open_ & ~up, mid, hi)
    return lo + (hi - lo) / 2


def _solve_shifted(diagonal, off, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """Solution of (T - shift) x = b by elimination with row exchanges; pivots are ``least`` at least."""
    n = len(b)
    main, upper, second = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n
    lower, x = off.tolist(), b.tolist()
    for i in range(n - 1):
        if abs(lower[i]) > abs(main[i]):
            main[i], lower[i] = lower[i], main[i]
            upper[i], main[i + 1] = main[i + 1], upper[i]
            second[i], upper[i + 1] = upper[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(main[i]) < least:
            main[i] = least
        f = lower[i] / main[i]
        main[i + 1] -= f * upper[i]
        upper[i + 1] -= f * second[i]
        x[i + 1] -= f * x[i]
    if abs(main[-1]) < least:
        main[-1] = least
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            x[i] -= upper[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= second[i] * x[i + 2]
        x[i] /= main[i]
    return np.array(x)


def _inverse_iteration(diagonal, off, values: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Unit eigenvectors of the falling ``values`` as columns; close ones are made orthogonal in every round."""
    n, random = len(diagonal), np.random.default_rng(12)
    scale = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0)) or 1.0
    eps = np.finfo(float).eps * scale
    out, cluster, before = np.zeros((n, len(values))), 0, None
    for j, value in enumerate(values.tolist()):
        if j and values[j - 1] - value > 1e-3 * scale:
            cluster = j
        shift = value if before is None or before - value > 10 * eps else before - 10 * eps
        before = shift
        x = random.standard_normal(n)
        for _ in range(rounds):
            x /= np.linalg.norm(x)
            x = _solve_shifted(diagonal, off, shift, x, eps)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[:, cluster:j] @ (out[:, cluster:j].T @ x)
        out[:, j] = x / np.linalg.norm(x)
    return out


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, the k largest."""
    diagonal, off, mirrors = tridiagonal(matrix)
    values = leading_values(diagonal, off, min(k, len(matrix)))
    vectors = _inverse_iteration(diagonal, off, values)
    for at in range(len(mirrors) - 1, -1, -1):
        v = mirrors[at]
        if v is not None:
            vectors[at + 1:] -= 2.0 * np.outer(v, v @ vectors[at + 1:])
    # once more over all of them, as different clusters are orthogonal only up to rounding over their gap
    vectors = np.linalg.qr(vectors)[0] if len(values) else vectors
    return values, vectors


# ------------------------------------------------------------ the operator

@dataclass
class Whitening:
    """n and sums of the fit list, its covariance's leading values and vectors, and the measured error."""
    n: int
    dim: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def explained(self) -> list[float]:
        return (self.values / self.trace).tolist()

    def centred(self, y: np.ndarray) -> np.ndarray:
        """y - S / n: the whole part is taken off exactly, then the fraction."""
        whole = np.array([s // self.n for s in self.sums])
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (y - whole) - rest

    def project(self, y: np.ndarray) -> np.ndarray:
        return self.centred(y) @ (self.vectors / np.sqrt(self.values))


def _sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    def run(batches):
        total = np.zeros(1 + 2 * dim, np.int64)
        for batch in batches:
            y = unpack(batch.column(0), dim)
            total[0] += len(y)
            total[1:1 + dim] += (y >> LOW_BITS).sum(axis=0)
            total[1 + dim:] += (y & (1 << LOW_BITS) - 1).sum(axis=0)
        yield vector_parts(total, 1)

    total = sum_parts(fit.select("x").mapInArrow(run, "part int, counts binary"), 1, 1 + 2 * dim).tolist()
    return total[0], [(h << LOW_BITS) + low for h, low in zip(total[1:1 + dim], total[1 + dim:], strict=True)]


def _products(fit: DataFrame, dim: int, size: int, rows_of) -> np.ndarray:
    """Sum over the fit list of z z', z the rows that ``rows_of`` gives for whole numbers (size columns)."""
    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            z = rows_of(unpack(batch.column(0), dim))
            total += z.T @ z
        yield vector_parts(total.reshape(-1), size, "<f8")

    found = fit.select("x").mapInArrow(run, "part int, counts binary")
    return sum_parts(found, size, size * size, "<f8", REDUCERS).reshape(size, size)


def fit_whitening(points: DataFrame, components: int = 16) -> Whitening | None:
    """The model of the rows of ``grid_vectors`` with one dimension; None without rows."""
    row = points.select("dim").first()
    if row is None:
        return None
    dim = row["dim"]
    fit = cut_lineage(points.select("x").distinct())
    n, sums = _sums(fit, dim)
    model = Whitening(n, dim, sums, np.zeros(0), np.zeros((dim, 0)), 0.0)
    covariance = _products(fit, dim, dim, model.centred) / n
    model.trace = float(np.trace(covariance))
    values, vectors = leading_components(covariance, components)
    kept = values > LEAST_SHARE * model.trace
    model.values, model.vectors = values[kept], vectors[:, kept]
    size = len(model.values)
    if size:
        # a column of ones beside the whitened ones sums them: their mean is taken off the products
        found = _products(fit, dim, size + 1, lambda y: np.hstack([model.project(y), np.ones((len(y), 1))])) / n
        mean = found[:size, size]
        model.identity_error = float(np.abs(found[:size, :size] - np.outer(mean, mean) - np.eye(size)).max())
    return model


def _deviation(model: Whitening, y: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n y - S)**2, exactly; None beyond 64 bits."""
    reach = model.n * float(np.abs(y).max(initial=0)) + max(map(abs, model.sums))
    if model.dim * reach ** 2 < 2.0 ** 62:
        d = model.n * y - np.array(model.sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((model.n * v - s) ** 2 for v, s in zip(row, model.sums, strict=True)) for row in y.tolist()]
    return [x if x < 1 << 63 else None for x in exact]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16,
           scale: int = SCALE) -> tuple[DataFrame, Whitening | None]:
    """(vec_id, deviation, whitened) of every row that takes part, and the model.

    ``whitened`` has an entry per component, numbered by falling eigenvalue; ``deviation`` is the exact sum of
    (n x - S)**2 over the dimensions."""
    spark = vectors.sparkSession
    found = cut_lineage(grid_vectors(vectors, id_col, vec_col, scale))
    most = found.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    points = found.where(F.col("dim") == (most["dim"] if most else 0))
    model = fit_whitening(points, components)
    shared = spark.sparkContext.broadcast(model)      # d x k numbers

    def run(batches):
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            y = unpack(batch.column(1), m.dim)
            w = m.project(y)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0), "deviation": pa.array(_deviation(m, y), pa.int64()),
                "whitened": pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * w.shape[1], w.reshape(-1))})

    return points.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, whitened array<double>"), model
