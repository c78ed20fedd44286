"""Registered queries: regressors, coefficients, scoring and intervals
(M1-M14, L3, L4, L6, O1-O6).

Closed-form fits (OLS, ridge on one feature) and every column-level
scoring rule have a DuckDB oracle.  Iterative fits (trees, boosting, CV,
GLM) cannot be matched value-for-value by another engine, so they are
registered without SQL (rows-only) and tested for quality in pytest.
Coefficients are rounded to 4 digits (solver noise ~1e-12 relative on
intercepts of magnitude 1e4).
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from limnos.plans import bindings as B
from limnos.plans.registry import register

KEY = "l_orderkey, l_linenumber"
REV = "l_extendedprice * (1 - l_discount)"


def _li(spark, sf):
    return B.lineitem_revenue(spark, sf)


def _coef_frame(spark, coefs: dict, digits: int = 4):
    rows = [(k, round(float(v), digits)) for k, v in coefs.items()]
    return spark.createDataFrame(rows, "term string, coefficient double")


# ------------------------------------------------------------ closed-form checkable

@register("ols_one_feature", f"""
select '(intercept)' as term, round(regr_intercept({REV}, l_extendedprice), 4) as coefficient from lineitem
union all
select 'l_extendedprice', round(regr_slope({REV}, l_extendedprice), 4) from lineitem""")
def q_ols_one_feature(spark, sf):
    """M1: OLS revenue ~ price with the Spark ML normal-equation solver; coefficients in original units."""
    from limnos.plans.models import original_scale_coefficients, train
    tm = train(_li(spark, sf), ["l_extendedprice"], "revenue", "linear")
    return _coef_frame(spark, original_scale_coefficients(tm))


SQL_OLS2 = f"""
with m as (select var_pop(x1) as s11, var_pop(x2) as s22, covar_pop(x1, x2) as s12,
                  covar_pop(x1, y) as c1, covar_pop(x2, y) as c2, avg(x1) as m1, avg(x2) as m2, avg(y) as my
           from (select l_extendedprice as x1, l_discount as x2, {REV} as y from lineitem) s),
b as (select (s22 * c1 - s12 * c2) / (s11 * s22 - s12 * s12) as b1,
             (s11 * c2 - s12 * c1) / (s11 * s22 - s12 * s12) as b2, m1, m2, my from m)
select '(intercept)' as term, round(my - b1 * m1 - b2 * m2, 4) as coefficient from b
union all select 'l_extendedprice', round(b1, 4) from b
union all select 'l_discount', round(b2, 4) from b"""


@register("ols_two_feature", SQL_OLS2)
def q_ols_two_feature(spark, sf):
    """M1: OLS revenue ~ price + discount (Spark ML, normal equations)."""
    from limnos.plans.models import original_scale_coefficients, train
    tm = train(_li(spark, sf), ["l_extendedprice", "l_discount"], "revenue", "linear")
    return _coef_frame(spark, original_scale_coefficients(tm))


@register("ols_normal_equations", SQL_OLS2)
def q_ols_normal_equations(spark, sf):
    """M1 via one covariance aggregate and a k x k solve (no ML pipeline)."""
    from limnos.plans.score import fit_ols_closed_form
    return _coef_frame(spark, fit_ols_closed_form(_li(spark, sf), ["l_extendedprice", "l_discount"], "revenue"))


RIDGE_ALPHA = 10000.0


@register("ridge_one_feature", f"""
with m as (select count(*) as n, covar_pop(l_quantity, y) as cxy, var_pop(l_quantity) as vx, avg(l_quantity) as mx,
                  avg(y) as my from (select l_quantity, {REV} as y from lineitem) s),
b as (select n * cxy / (vx * (n + {RIDGE_ALPHA})) as b1, mx, my from m)
select '(intercept)' as term, round(my - b1 * mx, 4) as coefficient from b
union all select 'l_quantity', round(b1, 4) from b""")
def q_ridge_one_feature(spark, sf):
    """M3: Ridge(alpha=1e4) on the standardised feature; Spark regParam = alpha * sigma_y / n."""
    from limnos.plans.models import original_scale_coefficients, train
    tm = train(_li(spark, sf), ["l_quantity"], "revenue", "ridge", alpha=RIDGE_ALPHA)
    return _coef_frame(spark, original_scale_coefficients(tm))


@register("coefficient_table", f"""
with m as (select var_pop(x1) as s11, var_pop(x2) as s22, covar_pop(x1, x2) as s12,
                  covar_pop(x1, y) as c1, covar_pop(x2, y) as c2, avg(y) as my
           from (select l_extendedprice as x1, l_discount as x2, {REV} as y from lineitem) s),
b as (select (s22 * c1 - s12 * c2) / (s11 * s22 - s12 * s12) * sqrt(s11) as z1,
             (s11 * c2 - s12 * c1) / (s11 * s22 - s12 * s12) * sqrt(s22) as z2, my from m)
select 'l_extendedprice' as feature, round(z1, 4) as coefficient, round(abs(z1), 4) as abs_coefficient from b
union all select 'l_discount', round(z2, 4), round(abs(z2), 4) from b
union all select '(intercept)', round(my, 4), round(abs(my), 4) from b""")
def q_coefficient_table(spark, sf):
    """Standardised OLS coefficients by |coefficient| (intercept = mean label)."""
    from limnos.plans.models import coefficient_table, train
    tm = train(_li(spark, sf), ["l_extendedprice", "l_discount"], "revenue", "linear")
    t = coefficient_table(tm)
    return t.select("feature", F.round("coefficient", 4).alias("coefficient"),
                    F.round("abs_coefficient", 4).alias("abs_coefficient"))


@register("predict_interval", f"""
with s as (select {KEY}, l_quantity * 1.1 as m, sqrt(exp(ln(l_tax + 0.01)) + 2.220446049250313e-16) as sg from lineitem),
f as (select {KEY}, m, greatest(sg, 0.01 * abs(m)) as sigma from s)
select {KEY}, round(m, 6) as pred_mean, round(sigma, 6) as pred_sigma, round(m - 1.96 * sigma, 6) as pred_lower,
       round(m + 1.96 * sigma, 6) as pred_upper from f""")
def q_predict_interval(spark, sf):
    """O1: (mu, logvar) -> mean, sigma (eps, 1% floor), 95% bounds."""
    from limnos.plans.score import predict_interval
    li = B.table(spark, sf, "lineitem").select(
        *B.LINEITEM_KEY, (F.col("l_quantity") * F.lit(1.1)).alias("mu"), F.ln(F.col("l_tax") + F.lit(0.01)).alias("lv"))
    out = predict_interval(li, "mu", "lv")
    return out.select(*B.LINEITEM_KEY, *[F.round(c, 6).alias(c) for c in
                                         ("pred_mean", "pred_sigma", "pred_lower", "pred_upper")])


@register("residual_interval", f"""
with c as (select regr_slope(l_quantity, l_extendedprice) as b, regr_intercept(l_quantity, l_extendedprice) as a
           from lineitem),
p as (select {KEY}, l_quantity, a + b * l_extendedprice as prediction from lineitem, c),
s as (select stddev_pop(l_quantity - prediction) as sd from p)
select {KEY}, round(prediction, 6) as prediction, round(prediction - 2 * sd, 6) as lower,
       round(prediction + 2 * sd, 6) as upper from p, s""")
def q_residual_interval(spark, sf):
    """Closed-form OLS quantity ~ price, then prediction -/+ 2 * population std of residuals."""
    from limnos.plans.score import apply_linear, fit_ols_closed_form, residual_interval
    li = B.table(spark, sf, "lineitem").select(*B.LINEITEM_KEY, "l_quantity", "l_extendedprice")
    coefs = fit_ols_closed_form(li, ["l_extendedprice"], "l_quantity")
    out = residual_interval(apply_linear(li, coefs), "l_quantity", "prediction", k=2.0)
    return out.select(*B.LINEITEM_KEY, *[F.round(c, 6).alias(c) for c in ("prediction", "lower", "upper")])


def _sql_surface() -> str:
    cols = ", ".join(f"round(max(prediction) filter (where j = {j}), 6) as l_discount_{j}" for j in range(5))
    return f"""
with m as (select var_pop(x1) as s11, var_pop(x2) as s22, covar_pop(x1, x2) as s12, covar_pop(x1, y) as c1,
                  covar_pop(x2, y) as c2, avg(x1) as m1, avg(x2) as m2, avg(y) as my,
                  min(x1) as lo1, max(x1) as hi1, min(x2) as lo2, max(x2) as hi2
           from (select l_quantity as x1, l_discount as x2, {REV} as y from lineitem) s),
b as (select (s22 * c1 - s12 * c2) / (s11 * s22 - s12 * s12) as b1, (s11 * c2 - s12 * c1) / (s11 * s22 - s12 * s12) as b2,
             m1, m2, my, lo1, hi1, lo2, hi2 from m),
g as (select i.range as i, j.range as j, lo1 + (hi1 - lo1) * i.range / 4 as q, lo2 + (hi2 - lo2) * j.range / 4 as d,
             b1, b2, my - b1 * m1 - b2 * m2 as b0 from range(5) i, range(5) j, b),
p as (select i, j, q, b0 + b1 * q + b2 * d as prediction from g)
select round(q, 6) as l_quantity, {cols} from p group by q"""


@register("prediction_grid", _sql_surface())
def q_prediction_grid(spark, sf):
    """E3 + O6: 5 x 5 grid over the quantity and discount ranges, scored by OLS, laid out quantity x discount."""
    from limnos.plans.score import fit_ols_closed_form, prediction_surface
    li = _li(spark, sf)
    coefs = fit_ols_closed_form(li, ["l_quantity", "l_discount"], "revenue")
    return prediction_surface(coefs, li, "l_quantity", "l_discount", levels=5)


@register("score_with_temperature", """
with e as (select event_id, user_id, strftime(ts, '%Y-%m-%d') as day, value from events),
t as (select user_id, strftime(ts, '%Y-%m-%d') as day, avg(value) as ts_celsius from events
      where event_type = 'view' group by 1, 2),
j as (select e.event_id, e.value, t.ts_celsius - 2.0 as surface_temp from e left join t
      on e.user_id = t.user_id and e.day = t.day),
c as (select regr_slope(value, surface_temp) as b, regr_intercept(value, surface_temp) as a from j)
select event_id, round(surface_temp, 6) as surface_temp, round(a + b * surface_temp, 6) as predicted_do from j, c""")
def q_score_with_temperature(spark, sf):
    """O3 + E1: join the landed daily temperature (offset 2), fit DO ~ temp on matched rows, score all rows
    (no temperature -> null prediction)."""
    from limnos.operators.joins import enrich_left_join
    from limnos.plans.score import fit_ols_closed_form, score_with_temperature
    ev = B.table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    temps = ev.where(F.col("event_type") == "view").select("user_id", "day", F.col("value").alias("ts_celsius"))
    sites = ev.select("event_id", "user_id", "day", "value")
    enriched = enrich_left_join(sites, temps, ["user_id", "day"], ["ts_celsius"])
    fit_rows = enriched.withColumn("surface_temp", F.col("ts_celsius") - F.lit(2.0))
    coefs = fit_ols_closed_form(fit_rows, ["surface_temp"], "value")
    out = score_with_temperature(coefs, sites, temps, ["user_id", "day"], temp_feature="surface_temp", offset=2.0)
    return out.select("event_id", F.round("surface_temp", 6).alias("surface_temp"),
                      F.round("predicted_do", 6).alias("predicted_do"))


# ------------------------------------------------------------ iterative fits (rows-only)

FEATS = ["l_extendedprice", "l_discount", "l_quantity", "l_tax"]


@register("train_compare")
def q_train_compare(spark, sf):
    """M13 + M1/M2/M3/M6/M7: fit five regressors on the 80% hash split, leaderboard on the 20%
    with the mean R^2 of 5 hash folds."""
    from limnos.plans.tuning import train_and_compare
    board, _, _ = train_and_compare(_li(spark, sf), FEATS, "revenue", B.LINEITEM_KEY, cv_folds=5,
                                    model_params={"random_forest": {"num_trees": 100}})
    return board


MEASURES = ["l_quantity", "l_extendedprice", "l_tax"]
ENGINEERED = [*MEASURES, "temp_doxy_ratio", "chl_a_doxy_ratio", "chl_a_temp_ratio", "log_chl_a", "temp_squared",
              "doxy_squared"]
PIPELINE_GRID = {"degree": [1, 2], "k_best": [5, 10, 15, None], "alpha": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]}


def _engineered(spark, sf):
    from limnos.operators.features import ratio_features
    return ratio_features(_li(spark, sf), temp="l_quantity", do="l_extendedprice", chl="l_tax")


ENGINEERED_SQL = f"""(select *, l_quantity / nullif(l_extendedprice, 0) as temp_doxy_ratio,
  l_tax / nullif(l_extendedprice, 0) as chl_a_doxy_ratio, l_tax / nullif(l_quantity, 0) as chl_a_temp_ratio,
  ln(1 + l_tax) as log_chl_a, l_quantity * l_quantity as temp_squared, l_extendedprice * l_extendedprice as doxy_squared,
  {REV} / 10000 as revenue, cast({B.sql_bucket(B.LI_KEY_SQL, 5)} as integer) as fold,
  case when {B.sql_bucket(B.LI_KEY_SQL, 100)} < 80 then cast({B.sql_bucket(B.LI_KEY_SQL, 5, 'fold')} as integer) else 5 end as part
  from lineitem)"""


def _grid_points(f_from: int, f_to: int) -> str:
    """The 48 points with their numbers, as SQL."""
    import itertools
    rows = [f"({i}, {d}, {k or 99}, {a!r}, {f_from}, {f_to})" for i, (d, k, a) in enumerate(itertools.product(
        *PIPELINE_GRID.values()))]
    return f"select * from (values {', '.join(rows)}) v(point, degree, k, alpha, f_from, f_to)"


def _sql_tune_ridge() -> str:
    import itertools

    from limnos.plans.sql_ridge import grid_ctes
    names = ", ".join(f"({i}, '{json.dumps(dict(zip(PIPELINE_GRID, c)), sort_keys=True)}')"
                      for i, c in enumerate(itertools.product(*PIPELINE_GRID.values())))
    return "with recursive " + grid_ctes("r", ENGINEERED_SQL, ENGINEERED, "revenue", "fold", 5, _grid_points(0, 4)) + f"""
select params, round(avg(round(mse, 6)), 6) as mean_mse, round(avg(round(r2, 6)), 6) as mean_r2
from r_score join (values {names}) v(id, params) on point = id group by params"""


def _engineered_10k(spark, sf):
    return _engineered(spark, sf).withColumn("revenue", F.col("revenue") / 10000)


@register("tune_ridge", _sql_tune_ridge())
def q_tune_ridge(spark, sf):
    """L4 + L3: degree x k-best x alpha, 48 points on nine features, 5 hash folds, mean CV MSE (best first);
    revenue in 10k units.  One aggregate of products per fold, no refits."""
    from limnos.plans.tuning import grid_search
    return grid_search(_engineered_10k(spark, sf), ENGINEERED, "revenue", B.LINEITEM_KEY, "ridge", PIPELINE_GRID, k=5)


PATH_ALPHAS = [1.0, 0.3, 0.1, 0.03, 0.01, 0.001]
PATH_RATIOS = [0.1, 0.5, 0.9]


def _sql_path(ratios) -> str:
    grid = ", ".join(f"({r!r}, {a!r})" for r in ratios for a in PATH_ALPHAS)
    return f"""
with d as (select cast(l_extendedprice as double) as x, {REV} / 10000 as y from lineitem),
s as (select avg(y) as my, covar_pop(x, y) / stddev_pop(x) as c from d),
g as (select * from (values {grid}) v(l1_ratio, alpha))
select cast(l1_ratio as double) as l1_ratio, cast(alpha as double) as alpha, 'l_extendedprice' as term,
       round(sign(c) * greatest(abs(c) - alpha * l1_ratio, 0) / (1 + alpha * (1 - l1_ratio)), 6) as coefficient,
       round(my, 6) as intercept from s, g"""


def _path(spark, sf, kind):
    from limnos.plans.moments import penalised_path
    li = _li(spark, sf).withColumn("revenue", F.col("revenue") / 10000)
    out = penalised_path(li, ["l_extendedprice"], "revenue", kind, PATH_ALPHAS, PATH_RATIOS)
    return out.withColumns({c: F.round(c, 6) for c in ("coefficient", "intercept")})


@register("lasso_path", _sql_path([1.0]))
def q_lasso_path(spark, sf):
    """M4: lasso coefficient of the standardised price along a path of alphas (revenue in 10k units), by
    coordinate descent on the products of one aggregate; SQL is the soft threshold."""
    return _path(spark, sf, "lasso")


@register("elastic_net_path", _sql_path(PATH_RATIOS))
def q_elastic_net_path(spark, sf):
    """M5: the same for the elastic net, three mixing ratios."""
    return _path(spark, sf, "elastic_net")


def _sql_cv_scores() -> str:
    from limnos.plans.sql_ridge import grid_ctes, predictions
    feats = ["l_extendedprice", "l_discount"]
    src = f"(select *, {REV} / 10000 as revenue, cast({B.sql_bucket(B.LI_KEY_SQL, 5)} as integer) as fold from lineitem)"
    fits = grid_ctes("r", src, feats, "revenue", "fold", 5, "select 0 as point, 2 as degree, 99 as k, 0.0 as alpha, 0 as f_from, 4 as f_to")
    return f"""with recursive {fits},
p as (select t.f, t.y, {predictions('r', feats)} as pred from r_t t join r_fit fit on t.f = fit.f where held)
select cast(f as integer) as fold, count(*) as n, round(avg((y - pred) * (y - pred)), 6) as mse,
       round(sqrt(avg((y - pred) * (y - pred))), 6) as rmse, round(avg(abs(y - pred)), 6) as mae,
       round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(y)), 6) as r2 from p group by f"""


@register("cv_scores", _sql_cv_scores())
def q_cv_scores(spark, sf):
    """L3 + M2: per-fold metrics of polynomial OLS with 5 hash folds (revenue in 10k units)."""
    from limnos.plans.tuning import cross_val_scores
    li = _li(spark, sf).withColumn("revenue", F.col("revenue") / 10000)
    return cross_val_scores(li, ["l_extendedprice", "l_discount"], "revenue", B.LINEITEM_KEY, "polynomial", 5)


@register("importance")
def q_importance(spark, sf):
    """Impurity importances of a random forest (100 trees)."""
    from limnos.plans.models import importance_table, train
    tm = train(_li(spark, sf), FEATS, "revenue", "random_forest", num_trees=100)
    return importance_table(tm)


@register("hetero_gaussian")
def q_hetero_gaussian(spark, sf):
    """M10 + O2: polynomial mean and log-variance fitted together, batch scored with 95% intervals."""
    from limnos.plans.models import train_gaussian
    from limnos.plans.score import score_batch
    li = B.table(spark, sf, "lineitem").select(*B.LINEITEM_KEY, "l_quantity", "l_extendedprice", "l_discount")
    gm = train_gaussian(li, ["l_quantity", "l_extendedprice"], "l_discount", mean_kind="polynomial")
    return score_batch(gm, li)


@register("weighted_step", """
with d as (select (cast(l_quantity as double) - avg(l_quantity) over ()) / stddev_pop(l_quantity) over () as x,
                  cast(l_discount as double) as y from lineitem),
w as (select x, y, exp(-(0.3 * x - 1)) as w from d),
s as (select sum(w) as s, sum(w * x) as sx, sum(w * y) as sy, sum(w * x * x) as sxx, sum(w * x * y) as sxy from w)
select '(intercept)' as term, round((sy * sxx - sx * sxy) / (s * sxx - sx * sx), 6) as coefficient from s
union all select 'l_quantity', round((s * sxy - sx * sy) / (s * sxx - sx * sx), 6) from s""")
def q_weighted_step(spark, sf):
    """The mean step of the joint fit: discount on standardised quantity, weighted with 1 / exp(0.3 z - 1)."""
    import numpy as np

    from limnos.operators.features import fit_standardizer
    from limnos.plans.gaussian import weighted_least_squares
    li = B.table(spark, sf, "lineitem")
    (m, sd), = fit_standardizer(li, ["l_quantity"]).values()
    data = li.select(((F.col("l_quantity") - m) / sd).alias("x"), F.col("l_discount").cast("double").alias("y"))
    b = weighted_least_squares(data, 1, (), lambda x: np.exp(0.3 * x[:, 0] - 1))
    return spark.createDataFrame([("(intercept)", round(float(b[0]), 6)), ("l_quantity", round(float(b[1]), 6))],
                                 "term string, coefficient double")


def _sql_boosted_first_tree() -> str:
    cells = """select {side} feature, v, sum(sum(g)) over w as gl, sum(count(*)) over w as hl,
      sum(sum(g)) over t as tg, sum(count(*)) over t as th
    from {rows} group by {side} feature, v
    window w as (partition by {side} feature order by v), t as (partition by {side} feature)"""
    gain = "gl * gl / (hl + 1) + (tg - gl) * (tg - gl) / (th - hl + 1) - tg * tg / (th + 1)"
    return f"""
with src as (select row_number() over () as i, cast(l_quantity as double) as l_quantity, cast(l_discount as double) as l_discount,
               cast(l_tax as double) as l_tax, cast(l_extendedprice as double) / 10000 as y from lineitem),
v as (select s.*, (select avg(y) from src) - y as g from src s),
l as (select i, feature, v, g from v unpivot (v for feature in (l_quantity, l_discount, l_tax))),
c as ({cells.format(side="", rows="l")}),
top as (select *, {gain} as gain from c where hl < th order by gain desc, feature, v limit 1),
side as (select v.i, case when case top.feature when 'l_quantity' then l_quantity when 'l_discount' then l_discount else l_tax end
           <= top.v then 1 else 2 end as node from v, top),
l2 as (select node, feature, v, g from l join side using (i)),
c2 as ({cells.format(side="node,", rows="l2")}),
nxt as (select *, {gain} as gain from c2 where hl < th order by gain desc, node, feature, v limit 1),
taken as (select 0 as node, feature, v, gain, gl, hl, tg, th from top union all select node, feature, v, gain, gl, hl, tg, th from nxt)
select 0 as tree, cast(node as integer) as node, feature, v as threshold, round(gain, 4) as gain, cast(th as double) as n_rows,
  round(-0.1 * gl / (hl + 1), 6) as left_value, round(-0.1 * (tg - gl) / (th - hl + 1), 6) as right_value from taken"""


def _boost_input(spark, sf):
    return _li(spark, sf).withColumn("y", F.col("l_extendedprice").cast("double") / 10000)


@register("boosted_first_tree", _sql_boosted_first_tree())
def q_boosted_first_tree(spark, sf):
    """M8: the first tree of second-order boosting, 3 leaves grown best first."""
    from limnos.plans.boosting import train_boosted
    model = train_boosted(_boost_input(spark, sf), ["l_quantity", "l_discount", "l_tax"], "y", rounds=1, max_depth=None, max_leaves=3)
    return model.splits(spark).withColumns({"gain": F.round("gain", 4), "left_value": F.round("left_value", 6),
                                            "right_value": F.round("right_value", 6)})


@register("boosted_fit")
def q_boosted_fit(spark, sf):
    """M8: 50 trees of depth 3 on the 80% split; errors on both splits."""
    from limnos.operators.metrics import regression_metrics
    from limnos.operators.split import hash_split
    from limnos.plans.models import train
    data = hash_split(_boost_input(spark, sf), B.LINEITEM_KEY)
    tm = train(data.where(F.col("split") == "train"), ["l_quantity", "l_discount", "l_tax"], "y", "boosted", max_iter=50, max_depth=3)
    return regression_metrics(tm.transform(data), "y", "prediction", by="split")


@register("tune_boosted")
def q_tune_boosted(spark, sf):
    """L4 / M8: number of trees and step of second-order boosting by 3-fold errors."""
    from limnos.plans.tuning import grid_search
    return grid_search(_boost_input(spark, sf), ["l_quantity", "l_discount", "l_tax"], "y", B.LINEITEM_KEY, "boosted",
                       {"max_iter": [5, 10], "step_size": [0.1, 0.2]}, k=3, max_depth=3)


@register("additive_fit")
def q_additive_fit(spark, sf):
    """M9: hinge basis at 5 quantile knots per feature + ridge; adjusted R^2."""
    from limnos.plans.models import adjusted_r2, hinge_basis, train
    from limnos.operators.metrics import regression_metrics
    li = _li(spark, sf)
    based, names = hinge_basis(li, ["l_quantity", "l_discount"], knots=5)
    feats = ["l_quantity", "l_discount", *names]
    tm = train(based, feats, "revenue", "ridge", alpha=1.0)
    m = regression_metrics(tm.transform(based), "revenue", "prediction").collect()[0]
    n, r2 = int(m["n"]), float(m["r2"])
    return spark.createDataFrame([(n, len(feats), r2, adjusted_r2(r2, n, len(feats)))],
                                 "n bigint, n_terms int, r2 double, adj_r2 double")


@register("additive_smooth")
def q_additive_smooth(spark, sf):
    """M9: penalised splines of three measures, smoothness by REML; a row per smooth with the model's statistics."""
    from limnos.plans.additive import fit_additive
    model = fit_additive(_boost_input(spark, sf), ["l_quantity", "l_discount", "l_tax"], "y")
    return model.terms(spark).withColumns({c: F.lit(v) for c, v in model.summary.items()})


def _sql_basic_vs_enhanced() -> str:
    from limnos.plans.sql_ridge import grid_ctes
    grid = grid_ctes("r", ENGINEERED_SQL, ENGINEERED, "revenue", "part", 5, _grid_points(0, 4) + " union all " + _grid_points(5, 5))
    basic = grid_ctes("q", ENGINEERED_SQL, MEASURES, "revenue", "part", 5,
                      "select point, 1 as degree, 99 as k, alpha, 5 as f_from, 5 as f_to from (" + _grid_points(5, 5)
                      + ") join best using (point)")
    return f"""
with recursive {grid},
best as (select point from r_score where f < 5 group by point
         order by round(avg(round(mse, 6)), 6), point limit 1),
{basic},
v as (select round(q.r2, 6) as basic_r2, round(sqrt(q.mse), 6) as basic_rmse, round(r.r2, 6) as enhanced_r2,
             round(sqrt(r.mse), 6) as enhanced_rmse
      from q_score q, r_score r join best using (point) where r.f = 5)
select *, enhanced_r2 - basic_r2 as r2_gain, enhanced_rmse - basic_rmse as rmse_change from v"""


@register("basic_vs_enhanced", _sql_basic_vs_enhanced())
def q_basic_vs_enhanced(spark, sf):
    """Ridge on the three measures vs the tuned pipeline (L4's grid) on them and the six ratio features;
    revenue in 10k units, grid and both fits from one aggregate of products."""
    from limnos.plans.tuning import basic_vs_enhanced
    return basic_vs_enhanced(_engineered_10k(spark, sf), MEASURES, ENGINEERED, "revenue", B.LINEITEM_KEY,
                             enhanced_kind="ridge", grid=PIPELINE_GRID)


@register("experiment_choice")
def q_experiment_choice(spark, sf):
    """Baseline features vs the six engineered ratio features, all models; best by test RMSE."""
    from limnos.plans.tuning import choose_experiment, train_and_compare
    li = _engineered(spark, sf)
    kinds = ("linear", "ridge", "lasso", "elastic_net", "random_forest", "gbm")
    base, _, _ = train_and_compare(li, MEASURES, "revenue", B.LINEITEM_KEY, kinds=kinds)
    eng, _, _ = train_and_compare(li, ENGINEERED, "revenue", B.LINEITEM_KEY, kinds=kinds)
    return choose_experiment({"baseline": base, "engineered": eng})


PH_FEATURES = ["l_tax", "l_quantity", "l_discount", "temp_do_interaction", "chla_temp_interaction", "chla_do_interaction",
               "do_temp_ratio", "chla_do_ratio", "chla_squared", "temp_squared", "do_squared", "chla_log", "temp_log", "do_log"]


def _sql_ph_scoring() -> str:
    from limnos.plans.sql_ridge import grid_ctes, predictions
    src = """(select *, l_extendedprice / 10000 as y, l_quantity * l_discount as temp_do_interaction,
      l_tax * l_quantity as chla_temp_interaction, l_tax * l_discount as chla_do_interaction,
      l_discount / (l_quantity + 1e-5) as do_temp_ratio, l_tax / (l_discount + 1e-5) as chla_do_ratio, l_tax * l_tax as chla_squared,
      l_quantity * l_quantity as temp_squared, l_discount * l_discount as do_squared, ln(l_tax + 1e-5) as chla_log,
      ln(l_quantity + 1e-5) as temp_log, ln(l_discount + 1e-5) as do_log, 0 as part from lineitem)"""
    fit = grid_ctes("r", src, PH_FEATURES, "y", "part", 1,
                    "select 0 as point, 1 as degree, 99 as k, 1.0 as alpha, 1 as f_from, 1 as f_to", degree=1)
    scaled = ", ".join(f"(cast({c} as double) - m{i}) / s{i} as t{i}" for i, c in enumerate(PH_FEATURES))
    return f"""with recursive {fit},
z as (select l_orderkey, l_linenumber, {scaled} from {src} src, r_st)
select l_orderkey, l_linenumber, round({predictions('r', PH_FEATURES, 1)}, 4) as prediction from z, r_fit"""


@register("ph_scoring", _sql_ph_scoring())
def q_ph_scoring(spark, sf):
    """O4 + K3: rebuild the interaction features, fit ridge (price in 10k units), score every row (null-safe)."""
    from limnos.operators.features import interaction_features
    from limnos.plans.models import train
    from limnos.plans.score import score
    li = interaction_features(B.table(spark, sf, "lineitem"), chla="l_tax", temp="l_quantity", do="l_discount")
    li = li.withColumn("y", F.col("l_extendedprice") / 10000)
    tm = train(li, PH_FEATURES, "y", "ridge", alpha=1.0)
    return score(tm, li).select(*B.LINEITEM_KEY, F.round("prediction", 4).alias("prediction"))


@register("model_round_trip", f"""
with c as (select regr_slope({REV} / 10000, l_extendedprice / 10000) as b, regr_intercept({REV} / 10000, l_extendedprice / 10000) as a,
                  min(l_extendedprice / 10000) as lo, max(l_extendedprice / 10000) as hi from lineitem),
g as (select range as level, lo + (hi - lo) * range / 4 as price from range(5), c)
select cast(level as bigint) as level, round(price, 6) as price, round(a + b * price, 6) as prediction from g, c""")
def q_model_round_trip(spark, sf):
    """A9 + A10: a model saved, loaded again and applied to inline rows (five prices between the least and the largest)."""
    import uuid

    from limnos.plans.models import load_model, save_model, train
    from limnos.session import ensure_checkpoint_dir
    from limnos.sources.ingest import inline_rows
    li = _li(spark, sf).select((F.col("l_extendedprice") / 10000).alias("price"), (F.col("revenue") / 10000).alias("revenue"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    save_model(train(li, ["price"], "revenue", "linear"), path)
    lo, hi = li.agg(F.min("price"), F.max("price")).first()
    rows = inline_rows(spark, [(i, float(lo) + (float(hi) - float(lo)) * i / 4) for i in range(5)], "level bigint, price double")
    return load_model(path).transform(rows).select("level", F.round("price", 6).alias("price"),
                                                   F.round("prediction", 6).alias("prediction"))


SQL_LOESS = """
with d as (select cast(l_quantity as double) as x, cast(l_discount as double) as y from lineitem
           where l_quantity is not null and l_discount is not null),
r as (select min(x) as lo, max(x) as hi, count(*) as n from d),
g as (select range as idx, lo + (hi - lo) * range / 79 as gx, n from range(80), r),
dist as (select g.idx, g.gx, g.n, d.x, d.y, abs(d.x - g.gx) as dd from g, d),
rk as (select idx, dd, row_number() over (partition by idx order by dd) as rn, n from dist),
h as (select idx, max(dd) as h from rk where rn <= cast(floor(n * 0.75) as bigint) group by idx),
w as (select dist.idx, dist.gx, dist.x - dist.gx as u, dist.y, h.h,
             pow(1 - (dist.dd / h.h) * (dist.dd / h.h) * (dist.dd / h.h), 3) as wt
      from dist join h on dist.idx = h.idx where dist.dd < h.h),
s as (select idx, gx, h, count(*) as n_local, sum(wt) as s0, sum(wt * u) as s1, sum(wt * u * u) as s2,
             sum(wt * u * u * u) as s3, sum(wt * u * u * u * u) as s4, sum(wt * y) as t0, sum(wt * u * y) as t1,
             sum(wt * u * u * y) as t2, sum(wt * wt) as v0, sum(wt * wt * u) as v1, sum(wt * wt * u * u) as v2,
             sum(wt * wt * u * u * u) as v3, sum(wt * wt * u * u * u * u) as v4 from w group by idx, gx, h),
det as (select *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) as det from s),
a as (select *, (s2 * s4 - s3 * s3) / det as a0, -(s1 * s4 - s2 * s3) / det as a1, (s1 * s3 - s2 * s2) / det as a2 from det),
f as (select *, a0 * t0 + a1 * t1 + a2 * t2 as fit,
             v0 * a0 * a0 + 2 * v1 * a0 * a1 + v2 * (a1 * a1 + 2 * a0 * a2) + 2 * v3 * a1 * a2 + v4 * a2 * a2 as nrm from a),
k as (select x, y, least(cast(floor((x - lo) / ((hi - lo) / 79)) as bigint), 78) as k, (x - lo) / ((hi - lo) / 79) as place from d, r),
e as (select k.y - (l.fit * (1 - (place - k)) + u.fit * (place - k)) as res, l.a0 * (1 - (place - k)) + u.a0 * (place - k) as lev
      from k join f l on l.idx = k.k join f u on u.idx = k.k + 1),
v as (select sum(res * res) / (count(*) - sum(lev)) as sigma2 from e)
select cast(idx as bigint) as idx, round(gx, 6) as x, round(fit, 6) as fit, round(sqrt(sigma2 * nrm), 6) as se,
       n_local, round(h, 6) as bandwidth from f, v"""


@register("loess_curve", SQL_LOESS)
def q_loess_curve(spark, sf):
    """Local quadratic smooth of discount on quantity at 80 grid points (span 0.75, tricube,
    exact q-th-nearest bandwidth by grouped selection) with its standard error."""
    from limnos.operators.smooth import loess_curve
    out = loess_curve(B.table(spark, sf, "lineitem"), "l_quantity", "l_discount")
    return out.select("idx", F.round("x", 6).alias("x"), F.round("fit", 6).alias("fit"), F.round("se", 6).alias("se"), "n_local",
                      F.round("bandwidth", 6).alias("bandwidth"))


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    """MSE increase per permuted feature for a random forest (100 trees), on orders (unique key):
    total price by order key, customer, date and year."""
    from limnos.plans.models import permutation_importance, train
    o = B.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"),
        F.col("o_custkey").cast("double").alias("customer"), F.dayofyear("o_orderdate").cast("double").alias("day"),
        F.year("o_orderdate").cast("double").alias("year"))
    tm = train(o, ["customer", "day", "year"], "o_totalprice", "random_forest", num_trees=100)
    return permutation_importance(tm, o, "o_orderkey")


SQL_PERMUTED = """
with d as (select o_orderkey, o_totalprice / 10000 as y, cast(o_custkey as double) as customer,
                  cast(extract(doy from o_orderdate) as double) as day from orders),
m as (select var_pop(customer) as s11, var_pop(day) as s22, covar_pop(customer, day) as s12, covar_pop(customer, y) as c1,
             covar_pop(day, y) as c2, avg(y) as my, avg(customer) as m1, avg(day) as m2 from d),
b as (select (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) as b1, (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) as b2, * from m),
r as (select *, row_number() over (order by md5(cast(o_orderkey as varchar) || ':42')) as rn, count(*) over () as n from d),
p as (select r.y, r.customer, r.day, o.customer as customer2, o.day as day2 from r join r o on o.rn = r.rn % r.n + 1),
e as (select avg(pow(y - my - b1 * (customer - m1) - b2 * (day - m2), 2)) as base,
             avg(pow(y - my - b1 * (customer2 - m1) - b2 * (day - m2), 2)) as e1,
             avg(pow(y - my - b1 * (customer - m1) - b2 * (day2 - m2), 2)) as e2 from p, b)
select 'customer' as feature, round(e1 - base, 6) as mse_increase, round((e1 - base) / base * 100, 6) as pct_increase from e
union all select 'day', round(e2 - base, 6), round((e2 - base) / base * 100, 6) from e"""


@register("permutation_importance_ols", SQL_PERMUTED)
def q_permutation_importance_ols(spark, sf):
    """MSE increase per permuted feature of a least-squares fit on orders (price in 10k units by customer and day)."""
    from limnos.plans.models import permutation_importance, train
    o = B.table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 10000).cast("double").alias("y"),
        F.col("o_custkey").cast("double").alias("customer"), F.dayofyear("o_orderdate").cast("double").alias("day"))
    out = permutation_importance(train(o, ["customer", "day"], "y", "linear"), o, "o_orderkey")
    return out.withColumns({c: F.round(c, 6) for c in ("mse_increase", "pct_increase")})


def _sql_cv_ols() -> str:
    fold = B.sql_bucket(B.LI_KEY_SQL, 5)
    e = "(y - pred)"
    return f"""
with d as (select l_extendedprice / 10000 as x, l_extendedprice * (1 - l_discount) / 10000 as y,
                  cast({fold} as integer) as fold from lineitem),
c as (select f.range as fold, regr_slope(d.y, d.x) as b, regr_intercept(d.y, d.x) as a
      from range(5) f, d where d.fold <> f.range group by f.range),
p as (select d.fold, d.y, c.a + c.b * d.x as pred from d join c on d.fold = c.fold)
select cast(fold as integer) as fold, count(*) as n, round(avg({e} * {e}), 6) as mse,
       round(sqrt(avg({e} * {e})), 6) as rmse, round(avg(abs({e})), 6) as mae,
       round(1 - sum({e} * {e}) / (var_pop(y) * count(y)), 6) as r2 from p group by fold"""


@register("cv_ols_folds", _sql_cv_ols())
def q_cv_ols_folds(spark, sf):
    """L3: 5 hash folds, OLS refitted on the other four folds (scaler refitted too), metrics on each fold
    (revenue on price, in 10k units)."""
    from limnos.plans.tuning import cross_val_scores
    li = B.table(spark, sf, "lineitem").select(
        *B.LINEITEM_KEY, (F.col("l_extendedprice") / 10000).alias("x"),
        (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount")) / 10000).alias("y"))
    return cross_val_scores(li, ["x"], "y", B.LINEITEM_KEY, "linear", 5)


RIDGE_GRID = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]


def _sql_ridge_grid() -> str:
    fold = B.sql_bucket(B.LI_KEY_SQL, 5)
    grid = ", ".join(f"('{json.dumps({'alpha': a})}', {a!r})" for a in RIDGE_GRID)
    e = "(y - pred)"
    return f"""
with d as (select l_extendedprice / 10000 as x, l_extendedprice * (1 - l_discount) / 10000 as y,
                  cast({fold} as integer) as fold from lineitem),
g as (select * from (values {grid}) t(params, alpha)),
st as (select f.range as fold, count(*) as n, covar_pop(d.x, d.y) as cxy, var_pop(d.x) as vx, avg(d.x) as mx,
              avg(d.y) as my from range(5) f, d where d.fold <> f.range group by f.range),
c as (select g.params, st.fold, st.n * st.cxy / (st.vx * (st.n + g.alpha)) as b, st.mx, st.my from g, st),
p as (select c.params, d.fold, d.y, c.my + c.b * (d.x - c.mx) as pred from c join d on d.fold = c.fold),
m as (select params, fold, round(avg({e} * {e}), 6) as mse,
             round(1 - sum({e} * {e}) / (var_pop(y) * count(y)), 6) as r2 from p group by params, fold)
select params, round(avg(mse), 6) as mean_mse, round(avg(r2), 6) as mean_r2 from m group by params"""


@register("tune_ridge_one_feature", _sql_ridge_grid())
def q_tune_ridge_one_feature(spark, sf):
    """L4 + L3: ridge alpha grid over 5 hash folds (scaler and fit per fold), mean CV MSE and R^2
    (revenue on price, in 10k units)."""
    from limnos.plans.tuning import grid_search
    li = B.table(spark, sf, "lineitem").select(
        *B.LINEITEM_KEY, (F.col("l_extendedprice") / 10000).alias("x"),
        (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount")) / 10000).alias("y"))
    return grid_search(li, ["x"], "y", B.LINEITEM_KEY, "ridge", {"alpha": RIDGE_GRID}, k=5)
