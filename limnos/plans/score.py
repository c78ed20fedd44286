"""Scoring with uncertainty.

Scoring is ``PipelineModel.transform`` plus column expressions: one narrow
map over the input, no shuffle, nothing collected.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.operators.joins import data_grid, enrich_left_join
from limnos.operators.profile import q

# Fixed values of the reference's interval rule: machine epsilon added to
# the variance, 95% normal quantile, and the 1% relative floor on sigma.
EPS = sys.float_info.epsilon  # 2.220446049250313e-16
Z95 = 1.96
MIN_REL_SIGMA = 0.01


def predict_interval(df: DataFrame, mu: str, logvar: str, y_mean: float = 0.0, y_std: float = 1.0,
                     min_rel_sigma: float = MIN_REL_SIGMA, z: float = Z95, eps: float = EPS,
                     out_mean: str = "pred_mean", out_sigma: str = "pred_sigma",
                     out_lower: str = "pred_lower", out_upper: str = "pred_upper") -> DataFrame:
    """O1: back-scale mu, sigma = sqrt(exp(logvar) + eps) * y_std, floor sigma at
    ``min_rel_sigma * |mean|`` (0.01 when scoring; pass 0 for evaluation,
    where the reference applies no floor), bounds mean -/+ z sigma.
    """
    mean = F.col(q(mu)) * F.lit(y_std) + F.lit(y_mean)
    sigma = F.sqrt(F.exp(F.col(q(logvar))) + F.lit(eps)) * F.lit(y_std)
    if min_rel_sigma:
        sigma = F.greatest(sigma, F.lit(min_rel_sigma) * F.abs(mean))
    out = df.withColumns({out_mean: mean, out_sigma: sigma})
    return out.withColumns({out_lower: F.col(out_mean) - F.lit(z) * F.col(out_sigma),
                            out_upper: F.col(out_mean) + F.lit(z) * F.col(out_sigma)})


def score_batch(model, df: DataFrame, roles: Mapping[str, str] | None = None, prefix: str = "DO",
                min_rel_sigma: float = MIN_REL_SIGMA) -> DataFrame:
    """O2: keep every input column and add ``{prefix}_Predicted``,
    ``{prefix}_Uncertainty``, ``{prefix}_LowerCI``, ``{prefix}_UpperCI``.

    ``model`` is a ``GaussianModel`` (mean + log-variance); ``roles`` maps the
    model's feature names to the caller's column names (B2).  A row with a
    null feature gets nulls.
    """
    roles = dict(roles or {})
    feats = model.mean.features
    bound = df.withColumns({f: F.col(q(roles[f])) for f in feats if f in roles and roles[f] != f})
    scored = model.transform(bound, mu="_mu", logvar="_lv")
    known = F.lit(True)
    for f in feats:
        known = known & F.col(q(f)).isNotNull()
    scored = scored.withColumns({c: F.when(known, F.col(c)) for c in ("_mu", "_lv")})   # no NaN from a missing feature
    out = predict_interval(scored, "_mu", "_lv", min_rel_sigma=min_rel_sigma,
                           out_mean=f"{prefix}_Predicted", out_sigma=f"{prefix}_Uncertainty",
                           out_lower=f"{prefix}_LowerCI", out_upper=f"{prefix}_UpperCI")
    added = [f for f in feats if f in roles and roles[f] != f and f not in df.columns]
    return out.drop("_mu", "_lv", *added)


def score(tm, df: DataFrame, prediction: str = "prediction", null_safe: bool = True) -> DataFrame:
    """Transform with a trained model (``TrainedModel``) or a linear
    coefficient map (closed-form fit, with ``(intercept)``); rows with a null
    feature get a null prediction instead of failing (the assembler keeps
    NaN, then the prediction is masked)."""
    if isinstance(tm, Mapping):
        feats = [f for f in tm if f != "(intercept)"]
        out = apply_linear(df, tm, out=prediction)
    else:
        feats = tm.features
        out = tm.transform(df, prediction=prediction)
    if null_safe:
        any_null = F.lit(False)
        for f in feats:
            any_null = any_null | F.col(q(f)).isNull()
        out = out.withColumn(prediction, F.when(any_null, F.lit(None)).otherwise(F.col(prediction)))
    return out


def score_with_temperature(tm, sites: DataFrame, temperatures: DataFrame, keys: Sequence[str],
                           temp_col: str = "ts_celsius", temp_feature: str = "temp", offset: float = 0.0,
                           round_keys: Mapping[str, int] | None = None) -> DataFrame:
    """O3: enrich each site row with the landed surface temperature (E1 left
    join, right side de-duplicated), subtract ``offset``, score; rows without
    a temperature pass through with a null prediction.  Adds
    ``surface_temp`` and ``predicted_do``.
    """
    enriched = enrich_left_join(sites, temperatures, keys, [temp_col], round_keys=round_keys)
    enriched = enriched.withColumn("surface_temp", F.col(q(temp_col)) - F.lit(offset)).drop(temp_col)
    enriched = enriched.withColumn(temp_feature, F.col("surface_temp")) if temp_feature not in sites.columns else enriched
    return score(tm, enriched, prediction="predicted_do")


def residual_interval(scored: DataFrame, label: str, prediction: str, k: float = 2.0,
                      fit_df: DataFrame | None = None, lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Prediction -/+ k * population std of residuals (of ``fit_df``, default ``scored``)."""
    base = fit_df if fit_df is not None else scored
    sd = base.agg(F.stddev_pop(F.col(q(label)) - F.col(q(prediction))).alias("s")).collect()[0]["s"] or 0.0
    p = F.col(q(prediction))
    return scored.withColumns({lower: p - F.lit(k * sd), upper: p + F.lit(k * sd)})


def prediction_surface(tm, df: DataFrame, row_axis: str, col_axis: str, levels: int = 5,
                       fixed: Mapping[str, float] | None = None, digits: int = 6) -> DataFrame:
    """Score an E3 grid over the data ranges of two inputs (other inputs
    fixed) and lay it out ``row_axis`` x ``col_axis``: one row per
    ``row_axis`` level, columns ``<col_axis>_0 .. <col_axis>_{levels-1}``."""
    grid = data_grid(df, {row_axis: levels, col_axis: levels}, fixed, with_index=True)
    scored = score(tm, grid)
    wide = (scored.groupBy(row_axis).pivot(f"{col_axis}__i", list(range(levels)))
            .agg(F.first(F.round("prediction", digits))))
    return wide.select(F.round(F.col(q(row_axis)), digits).alias(row_axis),
                       *[F.col(str(i)).alias(f"{col_axis}_{i}") for i in range(levels)])


def fit_ols_closed_form(df: DataFrame, features: Sequence[str], label: str, ridge: float = 0.0) -> dict[str, float]:
    """M1 via one aggregate: covariances -> normal equations (k x k) solved on the driver.

    Uses ``covar_pop`` (numerically stable running moments), so large
    magnitudes do not cancel.  Rows with any null are dropped first.
    ``ridge`` > 0 solves (S + ridge * diag(S)) b = c (scale-free shrinkage).
    """
    feats = list(features)
    data = df.select(*[F.col(q(c)) for c in feats], F.col(q(label))).na.drop()
    aggs = [F.avg(F.col(q(c))).alias(f"m{i}") for i, c in enumerate(feats)] + [F.avg(F.col(q(label))).alias("my")]
    for i, a in enumerate(feats):
        aggs.append(F.covar_pop(F.col(q(a)), F.col(q(label))).alias(f"cy{i}"))
        for j in range(i, len(feats)):
            aggs.append(F.covar_pop(F.col(q(a)), F.col(q(feats[j]))).alias(f"c{i}_{j}"))
    row = data.agg(*aggs).collect()[0]
    k = len(feats)
    S = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            S[i, j] = S[j, i] = row[f"c{i}_{j}"]
    c = np.array([row[f"cy{i}"] for i in range(k)])
    if ridge:
        S = S + ridge * np.diag(np.diag(S))
    b = np.linalg.lstsq(S, c, rcond=None)[0] if np.linalg.matrix_rank(S) < k else np.linalg.solve(S, c)
    out = {f: float(v) for f, v in zip(feats, b)}
    out["(intercept)"] = float(row["my"] - sum(b[i] * row[f"m{i}"] for i in range(k)))
    return out


def apply_linear(df: DataFrame, coefs: Mapping[str, float], out: str = "prediction") -> DataFrame:
    """Linear predictor from a coefficient map (with ``(intercept)``)."""
    expr = F.lit(coefs.get("(intercept)", 0.0))
    for f, b in coefs.items():
        if f != "(intercept)":
            expr = expr + F.lit(b) * F.col(q(f))
    return df.withColumn(out, expr)


def _moments(df: DataFrame, feats: Sequence[str], label: str):
    data = df.select(*[F.col(q(c)) for c in feats], F.col(q(label))).na.drop()
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(F.col(q(label))).alias("my"), F.var_pop(F.col(q(label))).alias("vy")]
    aggs += [F.avg(F.col(q(c))).alias(f"m{i}") for i, c in enumerate(feats)]
    for i, a in enumerate(feats):
        aggs.append(F.covar_pop(F.col(q(a)), F.col(q(label))).alias(f"cy{i}"))
        for j in range(i, len(feats)):
            aggs.append(F.covar_pop(F.col(q(a)), F.col(q(feats[j]))).alias(f"c{i}_{j}"))
    row = data.agg(*aggs).collect()[0]
    k = len(feats)
    S = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            S[i, j] = S[j, i] = row[f"c{i}_{j}"] or 0.0
    c = np.array([row[f"cy{i}"] or 0.0 for i in range(k)])
    means = np.array([row[f"m{i}"] or 0.0 for i in range(k)])
    return int(row["n"]), S, c, float(row["vy"] or 0.0), means, float(row["my"] or 0.0)


def fit_bayesian_ridge(df: DataFrame, features: Sequence[str], label: str, max_iter: int = 300, tol: float = 1e-3,
                       alpha_1: float = 1e-6, alpha_2: float = 1e-6, lambda_1: float = 1e-6,
                       lambda_2: float = 1e-6) -> dict[str, float]:
    """Bayesian ridge regression (evidence maximisation of the noise and weight
    precisions, as scikit-learn's ``BayesianRidge``) from one Spark aggregate.

    Only the centred sufficient statistics are needed -- n, X'X, X'y, y'y as
    covariances -- so the fit is one pass over the data plus a k x k
    eigen-iteration on the driver.
    """
    feats = list(features)
    n, S, c, vy, means, my = _moments(df, feats, label)
    if n == 0:
        return {**{f: 0.0 for f in feats}, "(intercept)": 0.0}
    xtx, xty, yty = n * S, n * c, n * vy
    evals, evecs = np.linalg.eigh(xtx)
    evals = np.clip(evals, 0.0, None)
    alpha = 1.0 / (vy + np.finfo(float).eps)
    lam = 1.0
    coef_old = None
    xty_rot = evecs.T @ xty
    for _ in range(max_iter):
        coef = evecs @ (xty_rot / (evals + lam / alpha))
        sse = max(yty - 2 * coef @ xty + coef @ xtx @ coef, 0.0)
        gamma = float(np.sum(alpha * evals / (lam + alpha * evals)))
        lam = (gamma + 2 * lambda_1) / (float(coef @ coef) + 2 * lambda_2)
        alpha = (n - gamma + 2 * alpha_1) / (sse + 2 * alpha_2)
        if coef_old is not None and np.sum(np.abs(coef_old - coef)) < tol:
            break
        coef_old = coef
    coef = evecs @ (xty_rot / (evals + lam / alpha))
    out = {f: float(v) for f, v in zip(feats, coef)}
    out["(intercept)"] = float(my - coef @ means)
    return out
