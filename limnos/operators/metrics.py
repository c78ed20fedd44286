"""Model-quality statistics.

Each is one aggregate (optionally grouped by a split label), i.e. one pass
with map-side partial aggregation; ``calibration_table`` first finds its
percentile edges by exact selection (a few more passes over one column).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.operators.profile import q
from limnos.operators.quantiles import quantiles


def _r(x: Column, digits: int | None) -> Column:
    return F.round(x, digits) if digits is not None else x


def regression_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] | str | None = None,
                       digits: int | None = 6) -> DataFrame:
    """N, MSE, RMSE, MAE, R^2 (optionally per group, e.g. per split -- O7).

    R^2 = 1 - SSE / SST with SST = var_pop(y) * n, i.e. sklearn's r2_score.
    Rows where label or prediction is null are skipped.
    """
    y, p = F.col(q(label)), F.col(q(prediction))
    e = y - p
    valid = y.isNotNull() & p.isNotNull()
    yv = F.when(valid, y)
    ev = F.when(valid, e)
    sse = F.sum(ev * ev)
    aggs = [F.count(ev).alias("n"),
            _r(F.avg(ev * ev), digits).alias("mse"),
            _r(F.sqrt(F.avg(ev * ev)), digits).alias("rmse"),
            _r(F.avg(F.abs(ev)), digits).alias("mae"),
            _r(F.lit(1.0) - F.try_divide(sse, F.var_pop(yv) * F.count(yv)), digits).alias("r2")]
    if by:
        by = [by] if isinstance(by, str) else list(by)
        return df.groupBy(*by).agg(*aggs)
    return df.agg(*aggs)


def gaussian_nll(df: DataFrame, label: str, mean: str, logvar: str, digits: int | None = 6) -> DataFrame:
    """Mean of 0.5 (ln 2 pi + logvar + (y - mu)^2 / exp(logvar)), plus MSE of the mean.

    Both means are over the rows in which label, mean and log-variance are all present."""
    y, mu, lv = F.col(q(label)), F.col(q(mean)), F.col(q(logvar))
    nll = F.lit(0.5) * (F.lit(math.log(2 * math.pi)) + lv + (y - mu) * (y - mu) / F.exp(lv))
    square = F.when(nll.isNotNull(), (y - mu) * (y - mu))
    return df.agg(F.count(nll).alias("n"), _r(F.avg(nll), digits).alias("nll"),
                  _r(F.avg(square), digits).alias("mean_mse"))


def residual_stats(df: DataFrame, label: str, prediction: str, by: Sequence[str] | str | None = None,
                   digits: int | None = 6) -> DataFrame:
    """residual = actual - predicted; mean and population std of residuals."""
    res = F.col(q(label)) - F.col(q(prediction))
    aggs = [F.count(res).alias("n"), _r(F.avg(res), digits).alias("residual_mean"),
            _r(F.stddev_pop(res), digits).alias("residual_std")]
    if by:
        by = [by] if isinstance(by, str) else list(by)
        return df.groupBy(*by).agg(*aggs)
    return df.agg(*aggs)


def linear_trend(df: DataFrame, x: str, y: str, digits: int | None = 6) -> DataFrame:
    """Degree-1 least-squares fit y ~ x and Pearson r (pairwise complete)."""
    X, Y = F.col(q(x)), F.col(q(y))
    return df.agg(F.regr_count(Y, X).alias("n"), _r(F.regr_slope(Y, X), digits).alias("slope"),
                  _r(F.regr_intercept(Y, X), digits).alias("intercept"), _r(F.corr(X, Y), digits).alias("r"))


def uncertainty_distribution(df: DataFrame, sigma: str, logvar: str | None = None,
                             digits: int | None = 6) -> DataFrame:
    """mean/min/max of the predicted sigma (and of the log-variance)."""
    s = F.col(q(sigma))
    aggs = [_r(F.avg(s), digits).alias("sigma_mean"), _r(F.min(s), digits).alias("sigma_min"),
            _r(F.max(s), digits).alias("sigma_max")]
    if logvar:
        lv = F.col(q(logvar))
        aggs += [_r(F.avg(lv), digits).alias("logvar_mean"), _r(F.min(lv), digits).alias("logvar_min"),
                 _r(F.max(lv), digits).alias("logvar_max")]
    return df.agg(*aggs)


def calibration_table(df: DataFrame, sigma: str, abs_error: str, bins: int = 10,
                      include_max: bool = True, exact: bool = True, digits: int | None = 6) -> DataFrame:
    """Percentile bins of sigma; mean sigma and mean |error| per bin.

    Edges are the 0, 1/bins, ..., 1 quantiles of sigma.  Bin of a row =
    1 + number of interior edges <= sigma, so the maximum falls in the last
    bin (the reference's digitize loop drops it: ``include_max=False``
    reproduces that by excluding rows at or above the top edge).  Empty
    bins are omitted.  Edges are literals; binning is a narrow projection
    and the table a partial aggregate over ``bins`` keys.
    """
    probs = [i / bins for i in range(bins + 1)]
    edges = quantiles(df, [sigma], probs, exact=exact)[sigma]
    s = F.col(q(sigma))
    b = F.lit(1)
    for e in edges[1:-1]:
        b = b + F.when(s >= F.lit(e), 1).otherwise(0)
    rows = df.where(s.isNotNull())
    if not include_max:
        rows = rows.where(s < F.lit(edges[-1]))
    return (rows.groupBy(b.cast("bigint").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), _r(F.avg(s), digits).alias("mean_sigma"),
                 _r(F.avg(F.col(q(abs_error))), digits).alias("mean_abs_error")))
