"""Kernel density on a grid (D14) and a local polynomial smoother.

KDE:
Scott's rule bandwidth h = stddev_samp * n^(-1/5); the grid runs from
min - cut*h to max + cut*h (seaborn's defaults: 200 points, cut 3).

Each row contributes exp(-0.5 ((g - x) / h)^2) to every grid point.  With ``support`` only to grid points within that many
bandwidths: a row then emits a few grid indices via ``sequence``/``explode``,
and the sum is a partial aggregate over at most ``points`` keys.  No grid x rows
cross join.
"""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.operators.profile import q


def scott_bandwidth(df: DataFrame, col: str) -> tuple[float, float, float, int]:
    x = F.col(q(col))
    row = df.agg(F.stddev_samp(x).alias("sd"), F.count(x).alias("n"), F.min(x).alias("lo"),
                 F.max(x).alias("hi")).collect()[0]
    n = int(row["n"])
    sd = row["sd"] or 0.0
    h = sd * n ** (-0.2) if n > 1 and sd > 0 else 1.0
    return h, float(row["lo"]), float(row["hi"]), n


def kde_grid(df: DataFrame, col: str, points: int = 200, cut: float = 3.0, support: float | None = None,
             bandwidth: float | None = None, digits: int | None = 6) -> DataFrame:
    """(idx, x, density) of a Gaussian KDE evaluated on an even grid.

    By default every row adds to every grid point, in one aggregate with partial sums.  With ``support`` a row adds only to the points
    within that many bandwidths (an approximation)."""
    h, lo, hi, n = scott_bandwidth(df, col)
    if bandwidth is not None:
        h = bandwidth
    g0 = lo - cut * h
    g1 = hi + cut * h
    dg = (g1 - g0) / (points - 1)
    x = F.col(q(col))
    if support is None:
        spread = df.where(x.isNotNull()).select((x / F.lit(h)).alias("u"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
        z = F.lit(g0 / h) + F.lit(dg / h) * F.col("i") - F.col("u")
        sums = spread.groupBy("i").agg(F.sum(F.exp(F.lit(-0.5) * z * z)).alias("s"))
        gx, dens = F.lit(g0) + F.lit(dg) * F.col("i"), F.col("s") * F.lit(1.0 / (n * h * math.sqrt(2.0 * math.pi)))
        if digits is not None:
            gx, dens = F.round(gx, digits), F.round(dens, digits)
        return sums.select(F.col("i").cast("bigint").alias("idx"), gx.alias("x"), dens.alias("density"))
    first = F.greatest(F.ceil((x - F.lit(support * h) - F.lit(g0)) / F.lit(dg)), F.lit(0)).cast("int")
    last = F.least(F.floor((x + F.lit(support * h) - F.lit(g0)) / F.lit(dg)), F.lit(points - 1)).cast("int")
    rows = df.where(x.isNotNull()).select(x.alias("x"), F.explode(F.sequence(first, last)).alias("idx"))
    g = F.lit(g0) + F.col("idx") * F.lit(dg)
    z = (g - F.col("x")) / F.lit(h)
    norm = 1.0 / (n * h * math.sqrt(2.0 * math.pi))
    sums = rows.groupBy("idx").agg(F.sum(F.exp(F.lit(-0.5) * z * z)).alias("s"))
    grid = df.sparkSession.range(points).withColumnRenamed("id", "idx").withColumn("idx", F.col("idx").cast("int"))
    out = grid.join(F.broadcast(sums), "idx", "left")
    dens = F.coalesce(F.col("s"), F.lit(0.0)) * F.lit(norm)
    gx = F.lit(g0) + F.col("idx") * F.lit(dg)
    if digits is not None:
        dens, gx = F.round(dens, digits), F.round(gx, digits)
    return out.select(F.col("idx").cast("bigint").alias("idx"), gx.alias("x"), dens.alias("density"))


def kde_by_group(df: DataFrame, groups: Sequence[str], col: str, points: int = 200, cut: float = 3.0,
                 digits: int | None = 6, max_cells: int = 4_000_000) -> DataFrame:
    """D14 per group: (*groups, idx, x, density), each group on its own even grid with Scott's bandwidth.

    Every value adds to every grid point of its group, in one aggregate by (group, point) with partial sums, so a
    task passes on one row per point.  Groups times points must fit ``max_cells``."""
    groups = list(groups)
    x = F.col(q(col)).cast("double")
    rows = df.where(x.isNotNull()).select(*groups, x.alias("_v"))
    stats = rows.groupBy(*groups).agg(
        F.stddev_samp("_v").alias("sd"), F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    stats = [r for r in stats.limit(max_cells // points + 1).collect() if r["n"]]
    if len(stats) * points > max_cells:
        raise ValueError("too many groups for one density each")
    grids = []
    for r in stats:
        sd, n = r["sd"] or 0.0, int(r["n"])
        h = sd * n ** (-0.2) if r["lo"] < r["hi"] else 1.0
        g0 = float(r["lo"]) - cut * h
        grids.append((g0, (float(r["hi"]) + cut * h - g0) / max(points - 1, 1), h, n))
    return _densities(rows, groups, [[r[g] for g in groups] for r in stats], grids, points, digits)


def _densities(rows: DataFrame, groups: list[str], keys: list[list], grids: list[tuple], points: int,
               digits: int | None) -> DataFrame:
    """Density of ``_v`` per group on the grids (g0, step, bandwidth, n); ``rows`` holds the groups and ``_v``."""
    spark = rows.sparkSession
    named = [f"_g{i}" for i in range(len(groups))]
    fields = [f"{n} {rows.schema[g].dataType.simpleString()}" for n, g in zip(named, groups)]
    table = spark.createDataFrame([(*key, i) for i, key in enumerate(keys)], ", ".join([*fields, "_id int"]))
    same = F.lit(True)
    for g, n in zip(groups, named):
        same = same & rows[g].eqNullSafe(table[n])
    numbered = rows.join(F.broadcast(table), same).select("_id", "_v")
    grid = spark.createDataFrame([(i, *g) for i, g in enumerate(grids)], "_id int, g0 double, step double, h double, n long")
    spread = numbered.join(F.broadcast(grid), "_id").select(
        "_id", F.col("_v") / F.col("h"), F.col("g0") / F.col("h"), F.col("step") / F.col("h"),
        F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).toDF("_id", "u", "a", "b", "idx")
    z = F.col("a") + F.col("b") * F.col("idx") - F.col("u")
    sums = spread.groupBy("_id", "idx").agg(F.sum(F.exp(F.lit(-0.5) * z * z)).alias("s")).withColumn("idx", F.col("idx").cast("long"))
    out = sums.join(F.broadcast(grid), "_id").join(F.broadcast(table), "_id").select(
        *(F.col(n).alias(g) for n, g in zip(named, groups)), "idx", (F.col("g0") + F.col("step") * F.col("idx")).alias("x"),
        (F.col("s") / (F.col("n") * F.col("h") * F.lit(math.sqrt(2.0 * math.pi)))).alias("density"))
    return out if digits is None else out.withColumns({c: F.round(c, digits) for c in ("x", "density")})


def _kth_nearest_from_counts(xs, ns, grid, q_near):
    """q-th nearest distance (1-based q) to each grid value from (distinct x, count) pairs:
    the first distinct x, by distance, at which the running count reaches q."""
    import numpy as np
    xs, ns = np.asarray(xs, dtype=float), np.asarray(ns, dtype=np.int64)
    out = []
    for g in grid:
        d = np.abs(xs - g)
        order = np.argsort(d, kind="stable")
        cum = np.cumsum(ns[order])
        out.append(float(d[order][np.searchsorted(cum, q_near)]))
    return out


def loess_curve(df: DataFrame, x: str, y: str, points: int = 80, span: float = 0.75, degree: int = 2,
                accuracy: int = 10000, max_points: int = 200, exact: bool = True,
                small_distinct: int = 200_000) -> DataFrame:
    """D20 (re-aimed R ``loess`` as ``geom_smooth`` calls it: span 0.75,
    local quadratic, 80 evaluation points): local polynomial fit of y on x
    at ``points`` evenly spaced grid values, tricube weights.

    The rows are first aggregated per distinct x (count, sum of y): weights
    depend on x only, so every weighted moment is exact on that table, and
    measurement precision bounds its size.  The bandwidth at grid value g
    is the distance to the q-th nearest x, q = floor(span * n): computed on
    the driver from the distinct-x table when it is proven small
    (<= ``small_distinct`` rows), else by grouped exact selection over the
    grid (``exact=True``) or a bounded sketch (``exact=False``).  Direct
    evaluation at each grid point (R interpolates a kd-tree surface by
    default, so values differ slightly from R).  The weighted sums are
    partial aggregates over the grid index; the (degree+1)^2 normal
    equations are solved per grid point on the driver.

    ``se`` is the standard error of the fit: the residual deviation times the length of the
    smoother's row at the grid point, which further moments (of the squared weights) give.  The residual variance is
    RSS / (n - trace), with fit and leverage between grid points interpolated linearly, one more aggregate.
    -> (idx, x, fit, se, n_local, bandwidth)
    """
    import numpy as np

    if points > max_points:
        raise ValueError(f"points must be <= {max_points}")
    X, Y = F.col(q(x)), F.col(q(y))
    data = df.where(X.isNotNull() & Y.isNotNull()).select(X.cast("double").alias("_x"), Y.cast("double").alias("_y"))
    per_x = data.groupBy("_x").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_sy"),
                                      F.sum(F.col("_y") * F.col("_y")).alias("_syy"))
    row = per_x.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.sum("_n").alias("n"),
                    F.count(F.lit(1)).alias("nd")).collect()[0]
    spark = df.sparkSession
    schema = "idx bigint, x double, fit double, se double, n_local bigint, bandwidth double"
    if row["lo"] is None:
        return spark.createDataFrame([], schema)
    lo, hi, n, n_distinct = float(row["lo"]), float(row["hi"]), int(row["n"]), int(row["nd"])
    grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)] if points > 1 else [lo]
    q_near = max(1, int(math.floor(n * span)))
    if exact and n_distinct <= small_distinct:
        pairs = per_x.select("_x", "_n").collect()  # size proven <= small_distinct
        hs = _kth_nearest_from_counts([r[0] for r in pairs], [r[1] for r in pairs], grid, q_near)
        bw = dict(enumerate(hs))
    else:
        gl = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(g).alias("g")) for i, g in enumerate(grid)])
        paired = data.select("_x", F.explode(gl).alias("_p")).select("_x", "_p.idx", "_p.g")
        if exact:
            from limnos.operators.quantiles import grouped_kth_smallest
            dist = paired.select("idx", F.abs(F.col("_x") - F.col("g")).alias("_d"))
            bw = dict(enumerate(grouped_kth_smallest(dist, "idx", "_d", q_near, len(grid), accuracy=accuracy)))
        else:
            bw = {r["idx"]: float(r["h"]) for r in paired.groupBy("idx").agg(
                F.percentile_approx(F.abs(F.col("_x") - F.col("g")), span, accuracy).alias("h")).collect()}
    hl = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(g).alias("g"), F.lit(float(bw[i]) or 1e-12).alias("h"))
                   for i, g in enumerate(grid)])
    local = (per_x.select("_x", "_n", "_sy", F.explode(hl).alias("_p")).select("_x", "_n", "_sy", "_p.*")
             .withColumn("_u", F.col("_x") - F.col("g")).where(F.abs("_u") < F.col("h")))
    t = F.abs("_u") / F.col("h")
    local = local.withColumn("_w", F.pow(F.lit(1.0) - t * t * t, 3))
    moments = [F.sum(F.col("_w") * F.pow(F.col("_u"), j) * F.col("_n")).alias(f"s{j}") for j in range(2 * degree + 1)]
    squares = [F.sum(F.col("_w") * F.col("_w") * F.pow(F.col("_u"), j) * F.col("_n")).alias(f"v{j}") for j in range(2 * degree + 1)]
    targets = [F.sum(F.col("_w") * F.pow(F.col("_u"), j) * F.col("_sy")).alias(f"t{j}") for j in range(degree + 1)]
    sums = {r["idx"]: r for r in local.groupBy("idx").agg(F.sum("_n").alias("n_local"), *moments, *squares, *targets)
            .collect()}
    fits, leverage, norm = ([None] * len(grid) for _ in range(3))
    for i in sums:
        r = sums[i]
        A, V = (np.array([[r[f"{c}{a + b}"] for b in range(degree + 1)] for a in range(degree + 1)], dtype=float) for c in "sv")
        c = np.array([r[f"t{a}"] for a in range(degree + 1)], dtype=float)
        fits[i] = float(np.linalg.lstsq(A, c, rcond=None)[0][0])
        one = np.linalg.pinv(A, hermitian=True)[0]
        leverage[i], norm[i] = float(one[0]), float(one @ V @ one)
    sigma2 = _residual_variance(per_x, grid, fits, leverage, n)
    out = []
    for i, g in enumerate(grid):
        r = sums.get(i)
        se = None if norm[i] is None or sigma2 is None else math.sqrt(max(sigma2 * norm[i], 0.0))
        out.append((i, g, fits[i], se, int(r["n_local"]) if r else 0, float(bw[i])))
    return spark.createDataFrame(out, schema)


def _residual_variance(per_x: DataFrame, grid, fits, leverage, n: int) -> float | None:
    """RSS / (n - trace) of a curve known on an even grid, linear between its points."""
    if len(grid) < 2 or any(f is None for f in fits) or grid[-1] <= grid[0]:
        return None
    place = (F.col("_x") - F.lit(grid[0])) / F.lit((grid[-1] - grid[0]) / (len(grid) - 1))
    k = F.least(F.floor(place), F.lit(len(grid) - 2)).cast("int")
    part = place - k

    def between(values):
        known = F.array(*map(F.lit, values))
        return F.element_at(known, k + 1) * (F.lit(1.0) - part) + F.element_at(known, k + 2) * part

    f = between(fits)
    row = per_x.agg(F.sum(F.col("_syy") - F.lit(2.0) * f * F.col("_sy") + F.col("_n") * f * f).alias("rss"),
                    F.sum(F.col("_n") * between(leverage)).alias("trace")).first()
    return max(float(row["rss"]), 0.0) / (n - float(row["trace"])) if n > row["trace"] else None
