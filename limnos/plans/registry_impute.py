"""Registered queries: gap filling (N1-N10, E2) on the events wide table."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.plans import bindings as B
from limnos.plans.registry import register

KEY = "station_day"
T = B.EVENT_TYPES
TARGET = "click"
FEATS = [t for t in T if t != TARGET]


@register("impute_mean", "select station_day, " + ", ".join(
    f"round(coalesce({t}, avg({t}) over ()), 6) as {t}" for t in T) + f" from {B.SQL_EVENTS_WIDE} w")
def q_impute_mean(spark, sf):
    """Every gap filled with its column mean."""
    from limnos.plans.impute import impute_mean
    out = impute_mean(B.events_wide(spark, sf), T)
    return out.select(KEY, *[F.round(t, 6).alias(t) for t in T])


def _sql_knn_core() -> str:
    means = ", ".join(f"avg({f}) as m_{f}" for f in FEATS)
    filled = ", ".join(f"coalesce({f}, m_{f}) as {f}" for f in FEATS)
    stats = ", ".join(f"avg({f}) as a_{f}, stddev_pop({f}) as s_{f}" for f in FEATS)
    zs = ", ".join(f"({f} - a_{f}) / s_{f} as z_{f}" for f in FEATS)
    dist = " + ".join(f"(qr.z_{f} - tr.z_{f}) * (qr.z_{f} - tr.z_{f})" for f in FEATS)
    return f"""
w as (select * from {B.SQL_EVENTS_WIDE} x),
mf as (select {means} from w),
f as (select station_day, {TARGET}, {filled} from w, mf),
sf as (select {stats} from f),
z as (select station_day, {TARGET}, {zs} from f, sf),
tr0 as (select * from z where {TARGET} is not null),
st as (select avg({TARGET}) as mu, stddev_pop({TARGET}) as sd, count(*) as n from tr0),
tr as (select tr0.* from tr0, st where st.n <= 20 or st.sd = 0 or abs(({TARGET} - mu) / sd) <= 3.0),
kk as (select least(20, greatest(3, cast(floor(count(*) * 0.1) as bigint))) as k from tr),
qr as (select * from z where {TARGET} is null),
d as (select qr.station_day as qk, tr.station_day as tk, tr.{TARGET} as y, sqrt({dist}) as dist from qr, tr),
r as (select *, row_number() over (partition by qk order by round(dist, 12), tk) as rn from d),
sel as (select r.* from r, kk where rn <= k),
knn as (select qk as station_day,
               case when count(*) filter (where dist = 0) > 0 then avg(y) filter (where dist = 0)
                    else sum(y / dist) filter (where dist > 0) / sum(1 / dist) filter (where dist > 0) end as pred
        from sel group by qk)"""


@register("impute_knn", "with " + _sql_knn_core().strip() + f"\nselect station_day, round(pred, 6) as {TARGET}_knn from knn")
def q_impute_knn(spark, sf):
    """N4 + E2: exact distance-weighted kNN fill of the click column (band join, no all-pairs)."""
    from limnos.plans.impute import choose_features, fill_knn
    wide = B.events_wide(spark, sf)
    feats = choose_features(wide, TARGET, [TARGET], KEY, top=10)
    out = fill_knn(wide, KEY, TARGET, feats)
    return out.where(F.col(TARGET).isNull()).select(KEY, F.round(f"{TARGET}__knn", 6).alias(f"{TARGET}_knn"))


def _sql_blend() -> str:
    from limnos.plans.impute import blend_weights
    return ("with " + _sql_knn_core().strip() + f""",
ratio as (select cast(count(*) filter (where {TARGET} is null) as double) / count(*) as r from w),
bnd as (select quantile_cont({TARGET}, 0.01) as lo, quantile_cont({TARGET}, 0.99) as hi, avg({TARGET}) as mu from w),
bl as (select w.station_day, w.{TARGET}, least(greatest(
           case when r > 0.5 then {blend_weights(0.6, ['knn', 'mean'])['knn']!r} * knn.pred + {blend_weights(0.6, ['knn', 'mean'])['mean']!r} * mu
                when r > 0.2 then {blend_weights(0.3, ['knn', 'mean'])['knn']!r} * knn.pred + {blend_weights(0.3, ['knn', 'mean'])['mean']!r} * mu
                else {blend_weights(0.1, ['knn', 'mean'])['knn']!r} * knn.pred + {blend_weights(0.1, ['knn', 'mean'])['mean']!r} * mu end,
           lo), hi) as v
       from w left join knn on w.station_day = knn.station_day, ratio, bnd)
select station_day, coalesce({TARGET},
       cast(round_even(cast(cast(v as varchar) as decimal(38, 15)), 2) as double)) as {TARGET} from bl""")


AXES = [f"e{i}" for i in range(10)]
_SPREAD = ", ".join(f"(qr.{a} - tr.{a}) * (qr.{a} - tr.{a})" for a in AXES).replace(", ", " + ")


@register("knn_many_features", f"""
with e as (select vec_id, {", ".join(f"cast(embedding[{i + 1}] as double) as {a}" for i, a in enumerate(AXES))},
             cast(embedding[11] as double) as y, {B.sql_bucket(B.sql_key("vec_id"), 100)} < 80 as held from embeddings
           where {" and ".join(f"embedding[{i + 1}] is not null" for i in range(11))}),
d as (select qr.vec_id, tr.vec_id as tk, tr.y, sqrt({_SPREAD}) as dist from e qr, e tr where not qr.held and tr.held),
r as (select *, row_number() over (partition by vec_id order by round(dist, 12), tk) as rn from d)
select vec_id, round(case when count(*) filter (where dist = 0) > 0 then avg(y) filter (where dist = 0)
         else sum(y / dist) filter (where dist > 0) / sum(1 / dist) filter (where dist > 0) end, 6) as prediction,
  count(*) as n_neighbors, round(max(dist), 6) as kth_distance from r where rn <= 20 group by vec_id""")
def q_knn_many_features(spark, sf):
    """20 nearest by ten features, searched by pivot cells; the test split's eleventh entry predicted."""
    from limnos.operators.neighbors import knn_regress
    from limnos.operators.split import hash_split
    cols = [F.get("embedding", i).cast("double").alias(c) for i, c in enumerate([*AXES, "y"])]
    e = hash_split(B.table(spark, sf, "embeddings").select("vec_id", *cols).na.drop(subset=[*AXES, "y"]), "vec_id")
    found = knn_regress(e.where("split = 'train'"), e.where("split = 'test'"), "vec_id", AXES, "y", 20)
    return found.withColumns({"prediction": F.round("prediction", 6), "kth_distance": F.round("kth_distance", 6)})


@register("impute_blend", _sql_blend())
def q_impute_blend(spark, sf):
    """N7 + N8: blend of kNN and mean fills by missing-ratio weights, clipped to the observed
    1st..99th percentiles, rounded half-even to 2 digits; observed values untouched."""
    from limnos.plans.impute import impute
    out = impute(B.events_wide(spark, sf), KEY, [TARGET], methods=("knn", "mean"))
    return out.select(KEY, TARGET)


@register("impute_mice_linear")
def q_impute_mice(spark, sf):
    """Chained equations (Bayesian ridge from one covariance aggregate per fit, up to 10 rounds, normalised
    stopping rule) over the five characteristics."""
    from limnos.plans.impute import fill_chained
    out = fill_chained(B.events_wide(spark, sf), T, rounds=10, estimator="bayesian_ridge")
    return out.select(KEY, *[F.coalesce(F.col(t), F.col(f"{t}__iterative")).alias(t) for t in T])


@register("impute_ensemble")
def q_impute_ensemble(spark, sf):
    """N8 + N2/N3/N4/N5/N7: kNN + chained equations (Bayesian ridge) + forest (200 trees, depth 15, leaf 2)
    blended per column."""
    from limnos.plans.impute import impute
    out = impute(B.events_wide(spark, sf), KEY, T, methods=("knn", "iterative", "rf"),
                 mice_estimator="bayesian_ridge")
    return out.select(KEY, *T)


@register("evaluate_imputation")
def q_evaluate_imputation(spark, sf):
    """N9 + N10 + L5: hide 10% of observed cells, impute (kNN + chained + forest + boosting), score each method and the blend."""
    from limnos.plans.impute import evaluate_imputation
    return evaluate_imputation(B.events_wide(spark, sf), KEY, T, methods=("knn", "iterative", "rf", "gbm"),
                               per_method=True, mice_estimator="bayesian_ridge")


def _sql_fill_linear() -> str:
    from limnos.plans.sql_ridge import grid_ctes, predictions
    fit = grid_ctes("r", "fitted", FEATS, TARGET, "part", 1,
                    "select 0 as point, 1 as degree, 99 as k, 0.0 as alpha, 1 as f_from, 1 as f_to", degree=1)
    means = ", ".join(f"avg({f}) as m_{f}" for f in FEATS)
    filled = ", ".join(f"coalesce({f}, m_{f}) as {f}" for f in FEATS)
    scaled = ", ".join(f"({c} - m{i}) / s{i} as t{i}" for i, c in enumerate(FEATS))
    return f"""with recursive w as (select * from {B.SQL_EVENTS_WIDE} x),
mf as (select {means} from w where {TARGET} is not null),
f as (select station_day, {TARGET}, {filled} from w, mf),
st as (select avg({TARGET}) as mu, stddev_pop({TARGET}) as sd from f),
fitted as (select f.*, 0 as part from f, st where {TARGET} is not null and abs(({TARGET} - mu) / sd) <= 3.0),
{fit},
z as (select station_day, {scaled} from f, r_st where {TARGET} is null)
select station_day, round({predictions('r', FEATS, 1)}, 6) as {TARGET}_linear from z, r_fit"""


@register("impute_linear", _sql_fill_linear())
def q_impute_linear(spark, sf):
    """N3 / N6 with a linear model in the tree's place: fitted on the observed rows (features filled with their means,
    outliers of the target left out), applied to the missing ones."""
    from limnos.plans.impute import fill_model
    out = fill_model(B.events_wide(spark, sf), TARGET, FEATS, "linear", "__linear")
    return out.where(F.col(TARGET).isNull()).select(KEY, F.round(f"{TARGET}__linear", 6).alias(f"{TARGET}_linear"))


SQL_DENSITIES = f"""
with m as (select station_day, {TARGET} as truth,
                  {TARGET} is not null and {B.sql_bucket('station_day', 1000, TARGET)} < 100 as hidden from {B.SQL_EVENTS_WIDE} x),
mu as (select avg(truth) as mu from m where not hidden),
c as (select 'observed' as method, 'observed' as kind, truth as v from m where truth is not null and not hidden
      union all select 'mean', 'imputed', mu from m, mu where truth is null
      union all select 'mean', 'error', mu - truth from m, mu where hidden),
st as (select method, kind, count(v) as n, min(v) as lo, max(v) as hi,
              case when min(v) < max(v) then stddev_samp(v) * power(count(v), -0.2) else 1.0 end as h from c group by method, kind),
g as (select method, kind, n, h, range as idx, lo - 3.0 * h + range * (((hi + 3.0 * h) - (lo - 3.0 * h)) / 199) as x from range(200), st)
select '{TARGET}' as target, g.method, g.kind, cast(idx as bigint) as idx, round(x, 6) as x,
       round(sum(exp(-0.5 * ((x - v) / h) * ((x - v) / h))) / (n * h * sqrt(2 * pi())), 6) as density
from g join c on g.method = c.method and g.kind = c.kind group by g.method, g.kind, idx, x, n, h"""


@register("imputation_densities", SQL_DENSITIES)
def q_imputation_densities(spark, sf):
    """N9 + N10: densities of observed values, of a mean fill's imputed ones and of its errors on hidden cells."""
    from limnos.plans.impute import imputation_report
    out = imputation_report(B.events_wide(spark, sf), KEY, [TARGET], methods=("mean",))["densities"]
    return out.where(F.col("method") != "blend")


@register("imputation_importances")
def q_imputation_importances(spark, sf):
    """Importances of the forests and boosted trees of every target's fill (boosting of 30 rounds)."""
    from limnos.plans.impute import imputation_report
    return imputation_report(B.events_wide(spark, sf), KEY, T, methods=("rf", "gbm"), rf_params={"num_trees": 50},
                             gbm_params={"max_iter": 30})["importances"]
