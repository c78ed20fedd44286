"""Registered queries: correlation, smoothing, metrics, reshape, filters,
features, splits, joins, ranking (SURVEY 7.3, second batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.plans import bindings as B
from limnos.plans.registry import R, _sql_profile_text, register

MEAS = B.LINEITEM_MEASURES
KEY = "l_orderkey, l_linenumber"
EV_TYPES = ["click", "error", "purchase", "signup", "view"]


# ------------------------------------------------------------ correlation

def _sql_corr(src: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"select '{a}' as col_a, '{b}' as col_b, cast(regr_count({b}, {a}) as bigint) as n, "
                         f"{R(f'corr({a}, {b})')} as r from {src} s")
    return "\nunion all\n".join(parts)


@register("corr_matrix_pairwise", _sql_corr(B.SQL_LINEITEM_MASKED, MEAS))
def q_corr_matrix(spark, sf):
    """D10 (+ L5 nulls): pairwise-complete Pearson r for every pair of lineitem measures."""
    from limnos.operators.correlation import corr_matrix
    return corr_matrix(B.lineitem_masked(spark, sf), MEAS)


SQL_LI_DERIVED = (f"(select *, l_extendedprice * (1 - l_discount) as revenue, "
                  f"l_quantity * l_extendedprice as qty_price from {B.SQL_LINEITEM_MASKED} m)")
CF_TARGETS = ["revenue", "qty_price"]
CF_FEATURES = MEAS + ["revenue", "qty_price"]


def _sql_correlated() -> str:
    parts = []
    for t in CF_TARGETS:
        for f in CF_FEATURES:
            if f == t:
                continue
            parts.append(f"select '{t}' as target, '{f}' as feature, cast(regr_count({t}, {f}) as bigint) as n, "
                         f"corr({t}, {f}) as r from {SQL_LI_DERIVED} d")
    body = "\nunion all\n".join(parts)
    return (f"select target, feature, n, {R('r')} as r, "
            f"cast(row_number() over (partition by target order by abs(r) desc, feature) as integer) as rank "
            f"from ({body}) c where n > 10 and abs(r) > 0.3")


@register("correlated_features", _sql_correlated())
def q_correlated_features(spark, sf):
    """Features with |r| > 0.3, p < 0.05, n > 10 per target, ranked by |r| (p checked in pytest)."""
    from limnos.operators.correlation import correlated_features
    li = B.lineitem_masked(spark, sf).withColumns({
        "revenue": F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount")),
        "qty_price": F.col("l_quantity") * F.col("l_extendedprice")})
    return correlated_features(li, CF_TARGETS, CF_FEATURES).select("target", "feature", "n", "r", "rank")


# ------------------------------------------------------------ smoothing / trends

@register("kde_grid", """
with st as (select stddev_samp(value) as sd, count(value) as n, min(value) as lo, max(value) as hi from events),
bw as (select sd * power(n, -0.2) as h, n, lo, hi from st),
gr as (select lo - 3.0 * h as g0, ((hi + 3.0 * h) - (lo - 3.0 * h)) / 199 as dg, h, n from bw),
g as (select range as idx, g0 + range * dg as x, h, n from range(200), gr)
select cast(idx as bigint) as idx, round(x, 6) as x,
       round(sum(exp(-0.5 * ((x - e.value) / h) * ((x - e.value) / h))) / (n * h * sqrt(2 * pi())), 6) as density
from g, events e where e.value is not null group by idx, x, h, n""")
def q_kde_grid(spark, sf):
    """Gaussian KDE of events.value on 200 grid points (Scott bandwidth, cut 3)."""
    from limnos.operators.smooth import kde_grid
    return kde_grid(B.table(spark, sf, "events"), "value", points=200)


@register("linear_trend", f"""
select cast(regr_count(qty_price, l_quantity) as bigint) as n, {R('regr_slope(qty_price, l_quantity)')} as slope,
       {R('regr_intercept(qty_price, l_quantity)')} as intercept, {R('corr(l_quantity, qty_price)')} as r
from (select l_quantity, l_quantity * l_extendedprice as qty_price from lineitem) s""")
def q_linear_trend(spark, sf):
    """Degree-1 fit of quantity x price on quantity, with r."""
    from limnos.operators.metrics import linear_trend
    li = B.table(spark, sf, "lineitem").withColumn("qty_price", F.col("l_quantity") * F.col("l_extendedprice"))
    return linear_trend(li, "l_quantity", "qty_price")


SQL_CALIB_SRC = ("(select sqrt(l_extendedprice) as sigma, abs(l_extendedprice * (1 - l_discount) - l_extendedprice) "
                 "/ sqrt(l_extendedprice) as abs_error from lineitem)")


def _sql_calibration() -> str:
    edges = ", ".join(f"quantile_cont(sigma, {i / 10}) as e{i}" for i in range(1, 10))
    b = " + ".join(f"(case when sigma >= e{i} then 1 else 0 end)" for i in range(1, 10))
    return (f"with s as {SQL_CALIB_SRC}, e as (select {edges} from s)\n"
            f"select cast(1 + {b} as bigint) as bin, count(*) as n, {R('avg(sigma)')} as mean_sigma, "
            f"{R('avg(abs_error)')} as mean_abs_error from s, e where sigma is not null group by 1")


@register("calibration_bins", _sql_calibration())
def q_calibration_bins(spark, sf):
    """10 percentile bins of a sigma column (sqrt of price), mean sigma and mean |error| per bin."""
    from limnos.operators.metrics import calibration_table
    li = B.table(spark, sf, "lineitem").select(
        F.sqrt("l_extendedprice").alias("sigma"),
        (F.abs(F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount")) - F.col("l_extendedprice"))
         / F.sqrt("l_extendedprice")).alias("abs_error"))
    return calibration_table(li, "sigma", "abs_error", bins=10)


# ------------------------------------------------------------ regression metrics

def _sql_metrics(src: str, y: str, p: str, by: str | None = None) -> str:
    e = f"({y} - {p})"
    sel = (f"count({e}) as n, {R(f'avg({e} * {e})')} as mse, {R(f'sqrt(avg({e} * {e}))')} as rmse, "
           f"{R(f'avg(abs({e}))')} as mae, {R(f'1 - sum({e} * {e}) / (var_pop({y}) * count({y}))')} as r2")
    if by:
        return f"select {by}, {sel} from {src} s group by {by}"
    return f"select {sel} from {src} s"


SQL_LI_PRED = (f"(select {KEY}, l_extendedprice * (1 - l_discount) as revenue, l_extendedprice * 0.95 as pred "
               f"from lineitem)")


def _li_pred(spark, sf):
    li = B.lineitem_revenue(spark, sf)
    return li.withColumn("pred", F.col("l_extendedprice") * F.lit(0.95))


@register("metrics_regression", _sql_metrics(SQL_LI_PRED, "revenue", "pred"))
def q_metrics_regression(spark, sf):
    """MSE, RMSE, MAE, R^2 of a price-based revenue predictor."""
    from limnos.operators.metrics import regression_metrics
    return regression_metrics(_li_pred(spark, sf), "revenue", "pred")


SQL_SPLIT_LI = (f"(select *, case when {B.sql_bucket(B.LI_KEY_SQL, 100)} < 70 then 'train' "
                f"when {B.sql_bucket(B.LI_KEY_SQL, 100)} < 85 then 'val' else 'test' end as split from {SQL_LI_PRED} p)")


def _li_pred_split(spark, sf):
    from limnos.operators.split import hash_split
    return hash_split(_li_pred(spark, sf), B.LINEITEM_KEY, (70, 85), ("train", "val", "test"))


@register("metrics_by_split", _sql_metrics(SQL_SPLIT_LI, "revenue", "pred", by="split"))
def q_metrics_by_split(spark, sf):
    """O7 + L2: the metrics per 70/15/15 hash split, in one grouped aggregate."""
    from limnos.operators.metrics import regression_metrics
    return regression_metrics(_li_pred_split(spark, sf), "revenue", "pred", by="split")


@register("residual_stats", f"""
select split, count(revenue - pred) as n, {R('avg(revenue - pred)')} as residual_mean,
       {R('stddev_pop(revenue - pred)')} as residual_std from {SQL_SPLIT_LI} s group by split""")
def q_residual_stats(spark, sf):
    """Residual mean and population std per split."""
    from limnos.operators.metrics import residual_stats
    return residual_stats(_li_pred_split(spark, sf), "revenue", "pred", by="split")


@register("gaussian_nll", f"""
select count(*) as n, {R('avg(0.5 * (ln(2 * pi()) + lv + (y - mu) * (y - mu) / exp(lv)))')} as nll,
       {R('avg((y - mu) * (y - mu))')} as mean_mse
from (select l_extendedprice * (1 - l_discount) as y, l_extendedprice * 0.95 as mu,
             2 * ln(1 + l_quantity) as lv from lineitem) s""")
def q_gaussian_nll(spark, sf):
    """Gaussian NLL of (mean, log-variance) predictions, plus MSE of the mean."""
    from limnos.operators.metrics import gaussian_nll
    li = B.table(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("y"),
        (F.col("l_extendedprice") * F.lit(0.95)).alias("mu"),
        (F.lit(2) * F.ln(F.lit(1) + F.col("l_quantity"))).alias("lv"))
    return gaussian_nll(li, "y", "mu", "lv")


@register("uncertainty_distribution", f"""
select {R('avg(sigma)')} as sigma_mean, {R('min(sigma)')} as sigma_min, {R('max(sigma)')} as sigma_max,
       {R('avg(lv)')} as logvar_mean, {R('min(lv)')} as logvar_min, {R('max(lv)')} as logvar_max
from (select sqrt(exp(2 * ln(1 + l_quantity))) as sigma, 2 * ln(1 + l_quantity) as lv from lineitem) s""")
def q_uncertainty_distribution(spark, sf):
    """mean/min/max of predicted sigma and log-variance."""
    from limnos.operators.metrics import uncertainty_distribution
    lv = F.lit(2) * F.ln(F.lit(1) + F.col("l_quantity"))
    li = B.table(spark, sf, "lineitem").select(F.sqrt(F.exp(lv)).alias("sigma"), lv.alias("lv"))
    return uncertainty_distribution(li, "sigma", "lv")


# ------------------------------------------------------------ reshape

def _pivot_cols(agg: str, val: str, key: str) -> str:
    return ", ".join(f"{R(f'{agg}({val}) filter (where {key} = {chr(39)}{t}{chr(39)})')} as {t}" for t in EV_TYPES)


@register("pivot_wide", f"""
select user_id, strftime(ts, '%Y-%m-%d') as day, {_pivot_cols('avg', 'value', 'event_type')}
from events group by user_id, strftime(ts, '%Y-%m-%d')""")
def q_pivot_wide(spark, sf):
    """(station, day) x characteristic -> one averaged column per characteristic."""
    from limnos.operators.reshape import pivot_wide
    ev = B.table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = pivot_wide(ev, ["user_id", "day"], "event_type", "value", EV_TYPES)
    return out.select("user_id", "day", *[F.round(t, 6).alias(t) for t in EV_TYPES])


@register("pivot_aligned", f"""
with r as (select event_type, value, row_number() over (partition by event_type order by event_id) as rn from events)
select rn as row_id, {', '.join(f"max(value) filter (where event_type = '{t}') as {t}" for t in EV_TYPES)}
from r group by rn""")
def q_pivot_aligned(spark, sf):
    """C1 + F1: i-th value of every characteristic side by side (ragged ends null)."""
    from limnos.operators.reshape import pivot_aligned
    return pivot_aligned(B.table(spark, sf, "events"), "event_type", "value", "event_id", EV_TYPES)


@register("row_number_in_group", """
select event_id, event_type, row_number() over (partition by event_type order by event_id) as rn from events""")
def q_row_number(spark, sf):
    """sequential number within each characteristic (range-partitioned index, skew-safe)."""
    from limnos.operators.ranking import rank_within_groups
    return rank_within_groups(B.table(spark, sf, "events").select("event_id", "event_type"), "event_type", "event_id")


@register("unpivot_long", f"""
unpivot (select {KEY}, {', '.join(MEAS)} from lineitem) on {', '.join(MEAS)} into name variable value value""")
def q_unpivot_long(spark, sf):
    """Lineitem measures -> (variable, value) rows."""
    from limnos.operators.reshape import unpivot_long
    li = B.table(spark, sf, "lineitem").select(*B.LINEITEM_KEY, *MEAS)
    return unpivot_long(li, B.LINEITEM_KEY, MEAS)


# ------------------------------------------------------------ filters and schema

@register("filter_membership", "select event_id, event_type, value from events where event_type in ('click', 'purchase')")
def q_filter_membership(spark, sf):
    """Keep two characteristics."""
    from limnos.operators.schema import filter_membership
    return filter_membership(B.table(spark, sf, "events"), "event_type", ["click", "purchase"]).select(
        "event_id", "event_type", "value")


@register("filter_boolean", """
select event_id, event_type, value from events
where (event_type = 'purchase' and value > 50) or event_type = 'error' or value < 1""")
def q_filter_boolean(spark, sf):
    """(A and B) or C or D."""
    from limnos.operators.schema import filter_rows
    c = F.col("event_type")
    cond = ((c == "purchase") & (F.col("value") > 50)) | (c == "error") | (F.col("value") < 1)
    return filter_rows(B.table(spark, sf, "events"), cond).select("event_id", "event_type", "value")


@register("drop_missing", f"""
select {KEY}, {', '.join(MEAS)} from {B.SQL_LINEITEM_MASKED} m where l_quantity is not null and l_extendedprice is not null""")
def q_drop_missing(spark, sf):
    """B9 (+ L5 nulls): drop rows with a null quantity or price."""
    from limnos.operators.schema import drop_missing
    return drop_missing(B.lineitem_masked(spark, sf).select(*B.LINEITEM_KEY, *MEAS), ["l_quantity", "l_extendedprice"])


@register("drop_empty_columns", f"""
select {KEY}, l_quantity, l_extendedprice, l_discount from {B.SQL_LINEITEM_MASKED} m where l_tax is null""")
def q_drop_empty_columns(spark, sf):
    """After keeping rows with a missing tax, the tax column is empty and is dropped."""
    from limnos.operators.schema import drop_empty_columns
    return drop_empty_columns(B.lineitem_masked(spark, sf).select(*B.LINEITEM_KEY, *MEAS).where(F.col("l_tax").isNull()))


@register("unit_scale", f"select event_id, {R('value * 0.001 - 2.0')} as value_scaled from events")
def q_unit_scale(spark, sf):
    """X * 0.001 - offset (unit change and temperature offset)."""
    from limnos.operators.schema import unit_scale
    out = unit_scale(B.table(spark, sf, "events"), "value", 0.001, 2.0, out="value_scaled")
    return out.select("event_id", F.round("value_scaled", 6).alias("value_scaled"))


@register("sentinel_to_null", f"""
select {KEY}, l_quantity, case when l_discount = 0 then null else l_discount end as l_discount,
       case when l_tax = 0 then null else l_tax end as l_tax,
       case when trim(l_returnflag) in ('N', 'NA', 'Inf') then null else l_returnflag end as l_returnflag
from lineitem""")
def q_sentinel_to_null(spark, sf):
    """Numeric sentinel 0 ("no reading") and text sentinels -> NULL."""
    from limnos.sources.ingest import sentinels_to_null
    li = B.table(spark, sf, "lineitem").select(*B.LINEITEM_KEY, "l_quantity", "l_discount", "l_tax", "l_returnflag")
    return sentinels_to_null(li, numeric={"l_discount": [0.0], "l_tax": [0.0]},
                             text={"l_returnflag": ["N", "NA", "Inf"]})


# ------------------------------------------------------------ features

def _sql_temporal(c: str) -> str:
    tp = "2 * pi()"
    return (f"hour({c}) as {c}_hour, day({c}) as {c}_day, month({c}) as {c}_month, year({c}) as {c}_year, "
            f"isodow({c}) - 1 as {c}_dayofweek, "
            f"{R(f'sin({tp} * hour({c}) / 24)')} as {c}_hour_sin, {R(f'cos({tp} * hour({c}) / 24)')} as {c}_hour_cos, "
            f"{R(f'sin({tp} * month({c}) / 12)')} as {c}_month_sin, {R(f'cos({tp} * month({c}) / 12)')} as {c}_month_cos")


def _temporal_out(df, c):
    ints = [f"{c}_{p}" for p in ("hour", "day", "month", "year", "dayofweek")]
    flts = [f"{c}_{p}" for p in ("hour_sin", "hour_cos", "month_sin", "month_cos")]
    return [F.col(x).cast("bigint").alias(x) for x in ints] + [F.round(x, 6).alias(x) for x in flts]


@register("temporal_features", f"""
select event_id, {_sql_temporal('ts').replace('hour(ts) as', 'cast(hour(ts) as bigint) as')
                                    .replace('day(ts) as', 'cast(day(ts) as bigint) as')
                                    .replace('month(ts) as', 'cast(month(ts) as bigint) as')
                                    .replace('year(ts) as', 'cast(year(ts) as bigint) as')
                                    .replace('isodow(ts) - 1 as', 'cast(isodow(ts) - 1 as bigint) as')} from events""")
def q_temporal_features(spark, sf):
    """K1 + I9 + I5: date parts (Monday = 0) and cyclic hour/month encodings of events.ts."""
    from limnos.operators.features import temporal_features
    out = temporal_features(B.table(spark, sf, "events").select("event_id", "ts"))
    return out.select("event_id", *_temporal_out(out, "ts"))


@register("temporal_features_orders", f"""
select o_orderkey, {_sql_temporal('o_orderdate').replace('hour(o_orderdate) as', 'cast(hour(o_orderdate) as bigint) as')
                                               .replace('day(o_orderdate) as', 'cast(day(o_orderdate) as bigint) as')
                                               .replace('month(o_orderdate) as', 'cast(month(o_orderdate) as bigint) as')
                                               .replace('year(o_orderdate) as', 'cast(year(o_orderdate) as bigint) as')
                                               .replace('isodow(o_orderdate) - 1 as', 'cast(isodow(o_orderdate) - 1 as bigint) as')} from orders""")
def q_temporal_features_orders(spark, sf):
    """K1 on orders.o_orderdate (dated rows)."""
    from limnos.operators.features import temporal_features
    out = temporal_features(B.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"))
    return out.select("o_orderkey", *_temporal_out(out, "o_orderdate"))


@register("ratio_features", f"""
select {KEY}, {R('l_quantity / nullif(l_discount, 0)')} as temp_doxy_ratio,
       {R('l_tax / nullif(l_discount, 0)')} as chl_a_doxy_ratio, {R('l_tax / nullif(l_quantity, 0)')} as chl_a_temp_ratio,
       {R('ln(1 + l_tax)')} as log_chl_a, {R('l_quantity * l_quantity')} as temp_squared,
       {R('l_discount * l_discount')} as doxy_squared from lineitem""")
def q_ratio_features(spark, sf):
    """K2: the six pH ratio features (roles: temp=quantity, DO=discount, chl=tax; zero divisor -> null)."""
    from limnos.operators.features import ratio_features
    out = ratio_features(B.table(spark, sf, "lineitem"), temp="l_quantity", do="l_discount", chl="l_tax")
    names = ["temp_doxy_ratio", "chl_a_doxy_ratio", "chl_a_temp_ratio", "log_chl_a", "temp_squared", "doxy_squared"]
    return out.select(*B.LINEITEM_KEY, *[F.round(n, 6).alias(n) for n in names])


INTERACTION_NAMES = ["temp_do_interaction", "chla_temp_interaction", "chla_do_interaction", "do_temp_ratio",
                     "chla_do_ratio", "chla_squared", "temp_squared", "do_squared", "chla_log", "temp_log", "do_log"]


@register("interaction_features", f"""
select {KEY}, {R('l_quantity * l_discount')} as temp_do_interaction, {R('l_tax * l_quantity')} as chla_temp_interaction,
       {R('l_tax * l_discount')} as chla_do_interaction, {R('l_discount / (l_quantity + 1e-5)')} as do_temp_ratio,
       {R('l_tax / (l_discount + 1e-5)')} as chla_do_ratio, {R('l_tax * l_tax')} as chla_squared,
       {R('l_quantity * l_quantity')} as temp_squared, {R('l_discount * l_discount')} as do_squared,
       {R('ln(l_tax + 1e-5)')} as chla_log, {R('ln(l_quantity + 1e-5)')} as temp_log,
       {R('ln(l_discount + 1e-5)')} as do_log from lineitem""")
def q_interaction_features(spark, sf):
    """K3: the eleven interaction features (roles: chla=tax, temp=quantity, DO=discount)."""
    from limnos.operators.features import interaction_features
    out = interaction_features(B.table(spark, sf, "lineitem"), chla="l_tax", temp="l_quantity", do="l_discount")
    return out.select(*B.LINEITEM_KEY, *[F.round(n, 6).alias(n) for n in INTERACTION_NAMES])


POLY_COLS = ["l_quantity", "l_discount", "l_tax"]


def _poly_terms():
    from limnos.operators.features import polynomial_name, polynomial_terms
    return [polynomial_name(t) for t in polynomial_terms(POLY_COLS, 2) if len(t) == 2]


@register("polynomial_deg2", f"""
select {KEY}, {', '.join(f'{R(t)} as "{t}"' for t in _poly_terms())} from lineitem""")
def q_polynomial_deg2(spark, sf):
    """K4: all degree-2 monomials of three measures, named explicitly."""
    from limnos.operators.features import polynomial_features
    out = polynomial_features(B.table(spark, sf, "lineitem").select(*B.LINEITEM_KEY, *POLY_COLS), POLY_COLS, 2)
    return out.select(*B.LINEITEM_KEY, *[F.round(F.col(f"`{t}`"), 6).alias(t) for t in _poly_terms()])


def _sql_standardize() -> str:
    b = B.sql_bucket(B.LI_KEY_SQL, 100)
    stats = ", ".join(f"avg({c}) as m_{c}, sqrt(var_pop({c})) as s_{c}" for c in MEAS)
    cols = ", ".join(f"{R(f'({c} - m_{c}) / s_{c}')} as {c}_z" for c in MEAS)
    return f"with st as (select {stats} from lineitem where {b} < 80) select {KEY}, {cols} from lineitem, st"


@register("standardize", _sql_standardize())
def q_standardize(spark, sf):
    """K5: z-scores with mean and population std fitted on the 80% train split only."""
    from limnos.operators.features import standardize
    from limnos.operators.split import hash_split
    li = hash_split(B.table(spark, sf, "lineitem").select(*B.LINEITEM_KEY, *MEAS), B.LINEITEM_KEY)
    out = standardize(li, MEAS, fit_df=li.where(F.col("split") == "train"), suffix="_z")
    return out.select(*B.LINEITEM_KEY, *[F.round(f"{c}_z", 6).alias(f"{c}_z") for c in MEAS])


# ------------------------------------------------------------ splits and masks

def _sql_split_orders(cuts, labels) -> str:
    b = B.sql_bucket("cast(o_orderkey as varchar)", 100)
    case = " ".join(f"when {b} < {c} then '{lab}'" for c, lab in zip(cuts, labels[:-1]))
    return f"select o_orderkey, case {case} else '{labels[-1]}' end as split from orders"


@register("split_hash_80_20", _sql_split_orders((80,), ("train", "test")))
def q_split_80_20(spark, sf):
    """L1: deterministic 80/20 split by md5 of the order key."""
    from limnos.operators.split import hash_split
    return hash_split(B.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@register("split_70_15_15", _sql_split_orders((70, 85), ("train", "val", "test")))
def q_split_70_15_15(spark, sf):
    """L2: deterministic 70/15/15 split."""
    from limnos.operators.split import hash_split
    return hash_split(B.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", (70, 85),
                      ("train", "val", "test"))


@register("fold_counts", f"""
select cast({B.sql_bucket('cast(o_orderkey as varchar)', 5)} as integer) as fold, count(*) as n from orders group by 1""")
def q_fold_counts(spark, sf):
    """L3: 5 hash folds and their sizes."""
    from limnos.operators.split import hash_folds, split_counts
    return split_counts(hash_folds(B.table(spark, sf, "orders"), "o_orderkey", 5), "fold")


@register("mask_holdout", f"""
select event_id, case when value is not null and {B.sql_bucket('cast(event_id as varchar)', 1000, 'value')} < 100
                      then null else value end as value,
       value as value_truth,
       (value is not null and {B.sql_bucket('cast(event_id as varchar)', 1000, 'value')} < 100) as value_masked
from events""")
def q_mask_holdout(spark, sf):
    """Hide 10% of observed values (hash mask), keep the truth."""
    from limnos.operators.split import mask_holdout
    ev = B.table(spark, sf, "events").select("event_id", "value")
    return mask_holdout(ev, "value", "event_id", 0.1, min_masked=11, min_observed=20)


# ------------------------------------------------------------ joins and ranking

@register("enrich_left_join", f"""
with d as (select user_id, strftime(ts, '%Y-%m-%d') as day, avg(value) as daily_view_avg from events
           where event_type = 'view' group by 1, 2),
e as (select event_id, user_id, strftime(ts, '%Y-%m-%d') as day, value from events)
select e.event_id, e.user_id, e.day, e.value, {R('d.daily_view_avg')} as daily_view_avg,
       {R('e.value - d.daily_view_avg')} as anomaly
from e left join d on e.user_id = d.user_id and e.day = d.day""")
def q_enrich_left_join(spark, sf):
    """Left join a de-duplicated per-station-per-day table; unmatched -> null."""
    from limnos.operators.joins import enrich_left_join
    ev = B.table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    right = ev.where(F.col("event_type") == "view").select("user_id", "day", F.col("value").alias("daily_view_avg"))
    out = enrich_left_join(ev.select("event_id", "user_id", "day", "value"), right, ["user_id", "day"],
                           ["daily_view_avg"])
    return out.select("event_id", "user_id", "day", "value", F.round("daily_view_avg", 6).alias("daily_view_avg"),
                      F.round(F.col("value") - F.col("daily_view_avg"), 6).alias("anomaly"))


@register("topk_per_group", f"""
select l_returnflag, l_orderkey, l_linenumber, l_extendedprice, rank from (
  select l_returnflag, l_orderkey, l_linenumber, l_extendedprice,
         row_number() over (partition by l_returnflag order by l_extendedprice desc, l_orderkey, l_linenumber) as rank
  from lineitem) t where rank <= 3""")
def q_topk_per_group(spark, sf):
    """Top 3 prices per return flag (salted two-level top-k)."""
    from limnos.operators.ranking import topk_per_group
    li = B.table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    out = topk_per_group(li, "l_returnflag", "l_extendedprice", 3, tiebreak=["l_orderkey", "l_linenumber"])
    return out.withColumn("rank", F.col("rank").cast("bigint"))


SQL_BOARD_SRC = ("(select l_extendedprice * (1 - l_discount) as y, l_extendedprice as p_price, "
                 "l_extendedprice * 0.95 as p_price_95, l_extendedprice * 0.9 as p_price_90, "
                 "(select avg(l_extendedprice * (1 - l_discount)) from lineitem) as p_mean from lineitem)")
BOARD_MODELS = ["price", "price_95", "price_90", "mean"]


def _sql_board() -> str:
    parts = []
    for m in BOARD_MODELS:
        parts.append(f"select '{m}' as model, " + _sql_metrics(SQL_BOARD_SRC, "y", f"p_{m}")[len("select "):])
    return "\nunion all\n".join(parts)


def _board(spark, sf):
    from limnos.operators.metrics import regression_metrics
    from limnos.operators.outliers import with_scalar_stats
    from limnos.operators.ranking import leaderboard
    li = B.table(spark, sf, "lineitem").select((F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("y"),
                                               "l_extendedprice")
    li = with_scalar_stats(li, li.agg(F.avg("y").alias("p_mean")))
    li = li.withColumns({"p_price": F.col("l_extendedprice"), "p_price_95": F.col("l_extendedprice") * F.lit(0.95),
                         "p_price_90": F.col("l_extendedprice") * F.lit(0.9)})
    return leaderboard([regression_metrics(li, "y", f"p_{m}").select(F.lit(m).alias("model"), "*")
                        for m in BOARD_MODELS])


@register("leaderboard", _sql_board())
def q_leaderboard(spark, sf):
    """H1: one metrics row per candidate predictor, stacked."""
    return _board(spark, sf)


@register("argbest_model", f"""
with b as ({_sql_board()})
select arg_min(model, rmse) as best_model, min(rmse) as best_rmse, arg_max(model, r2) as best_model_r2,
       max(r2) as best_r2 from b""")
def q_argbest_model(spark, sf):
    """Model with min RMSE and model with max R^2 from the leaderboard."""
    from limnos.operators.ranking import argbest_many
    return argbest_many(_board(spark, sf), "model", [("rmse", "min", "best_model", "best_rmse"),
                                                     ("r2", "max", "best_model_r2", "best_r2")])


# ------------------------------------------------------------ selection, folds, text and JSON

@register("select_k_best", f"""
with c as (select 'l_extendedprice' as feature, abs(corr(l_extendedprice, revenue)) as a from {B.SQL_LINEITEM_REVENUE} s
           union all select 'l_discount', abs(corr(l_discount, revenue)) from {B.SQL_LINEITEM_REVENUE} s
           union all select 'l_quantity', abs(corr(l_quantity, revenue)) from {B.SQL_LINEITEM_REVENUE} s
           union all select 'l_tax', abs(corr(l_tax, revenue)) from {B.SQL_LINEITEM_REVENUE} s)
select feature, cast(row_number() over (order by a desc) as integer) as rank from c qualify rank <= 2""")
def q_select_k_best(spark, sf):
    """K6: the 2 measures with the largest F statistic for revenue (F is monotone in |r|)."""
    from limnos.operators.correlation import correlation_stats
    from limnos.operators.features import select_k_best
    li = B.lineitem_revenue(spark, sf)
    chosen = select_k_best(li, MEAS, "revenue", k=2)
    stats = {s["feature"]: abs(s["r"]) for s in correlation_stats(li, ["revenue"], chosen)}
    rows = [(f, i + 1) for i, f in enumerate(sorted(chosen, key=lambda f: -stats[f]))]
    return spark.createDataFrame(rows, "feature string, rank int")


@register("contiguous_folds", """
with r as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i, count(*) over () as n from orders),
p as (select o_orderkey, i, n // 5 as base, n % 5 as extra from r)
select o_orderkey, cast(case when i < extra * (base + 1) then i // (base + 1)
                             else extra + (i - extra * (base + 1)) // base end as integer) as fold from p""")
def q_contiguous_folds(spark, sf):
    """unshuffled 5-fold over the order key (first n mod 5 folds one larger)."""
    from limnos.operators.split import contiguous_folds
    return contiguous_folds(B.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5)


@register("text_and_json", """
select event_id, cast(json_extract_string(props, '$.k') as bigint) as prop_k, lower(trim(event_type)) as kind,
       replace(upper(event_type), 'E', '3') as code from events""")
def q_text_and_json(spark, sf):
    """I11 + I13: JSON path extraction and trim / lower / replace on events."""
    from limnos.functions.scalar import json_field, normalise_text
    ev = B.table(spark, sf, "events")
    return ev.select("event_id", json_field("props", "$.k").cast("bigint").alias("prop_k"),
                     normalise_text("event_type").alias("kind"),
                     F.replace(F.upper("event_type"), F.lit("E"), F.lit("3")).alias("code"))


@register("split_priority", """
select o_orderkey, cast(split_part(o_orderpriority, '-', 1) as integer) as priority_rank,
       lower(split_part(o_orderpriority, '-', 2)) as priority_name from orders""")
def q_split_priority(spark, sf):
    """Split a coded text field into a number and a lower-cased name."""
    o = B.table(spark, sf, "orders")
    parts = F.split("o_orderpriority", "-")
    return o.select("o_orderkey", parts.getItem(0).cast("int").alias("priority_rank"),
                    F.lower(parts.getItem(1)).alias("priority_name"))


DOC_TEXT_COLS = ["text", "lang", "source"]


@register("profile_text_documents", _sql_profile_text("documents", DOC_TEXT_COLS))
def q_profile_text_documents(spark, sf):
    """D5 text skim over whole documents (length range, empties, distinct texts, whitespace-only)."""
    from limnos.operators.profile import profile_text
    return profile_text(B.table(spark, sf, "documents"), DOC_TEXT_COLS)


@register("rank_by_value", """
select l_orderkey, l_linenumber, l_extendedprice,
       row_number() over (order by l_extendedprice, l_orderkey, l_linenumber) as rank from lineitem""")
def q_rank_by_value(spark, sf):
    """position of every line after sorting by price (range-partitioned two-pass index)."""
    from limnos.operators.ranking import rank_by_value
    li = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rank_by_value(li, ["l_extendedprice", "l_orderkey", "l_linenumber"])
