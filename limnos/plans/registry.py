"""Registered driver queries: a Spark callable and, where SQL can express
it, the equivalent DuckDB SQL over the same parquet tables.

Every query reads whole tables (no id subsets, no row caps); floating
outputs are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.plans import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def R(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits})"


# ------------------------------------------------------------ profile (D)

def _sql_describe(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"select '{c}' as \"column\", count({c}) as \"count\", {R(f'avg({c})')} as mean, "
            f"{R(f'stddev_samp({c})')} as std, {R(f'min({c})')} as \"min\", "
            f"{R(f'quantile_cont({c}, 0.25)')} as p25, {R(f'quantile_cont({c}, 0.5)')} as p50, "
            f"{R(f'quantile_cont({c}, 0.75)')} as p75, {R(f'max({c})')} as \"max\" from {src}")
    return "\nunion all\n".join(parts)


@register("describe_numeric", _sql_describe("lineitem", B.LINEITEM_MEASURES))
def q_describe_numeric(spark, sf):
    """D3 on the lineitem measures."""
    from limnos.operators.profile import describe
    return describe(B.table(spark, sf, "lineitem"), B.LINEITEM_MEASURES)


def _sql_missing(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        nm = f"count(*) filter (where {c} is null)"
        parts.append(f"select '{c}' as \"column\", {nm} as n_missing, count(*) as n_rows, "
                     f"{R(f'cast({nm} as double) * 100 / count(*)')} as pct_missing from {src} s")
    return "\nunion all\n".join(parts)


@register("missing_counts", _sql_missing(B.SQL_LINEITEM_MASKED, B.LINEITEM_MEASURES))
def q_missing_counts(spark, sf):
    """D2 (+ L5 mask for the nulls) on lineitem."""
    from limnos.operators.profile import missing_counts
    return missing_counts(B.lineitem_masked(spark, sf), B.LINEITEM_MEASURES)


def _sql_profile_numeric(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        nm = f"count(*) filter (where {c} is null)"
        qs = ", ".join(f"{R(f'quantile_cont({c}, {p})')} as {n}" for p, n in
                       [(0.0, "p0"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (1.0, "p100")])
        b = (f"least(floor(({c} - q.lo) / (case when q.hi > q.lo then q.hi - q.lo else 1.0 end) * 5), 4)")
        hist = " || ' ' || ".join(f"cast(count(*) filter (where {b} = {j}) as varchar)" for j in range(5))
        parts.append(f"select '{c}' as \"column\", {nm} as n_missing, "
                     f"{R(f'cast(count(*) - {nm} as double) / count(*)')} as complete_rate, "
                     f"{R(f'avg({c})')} as mean, {R(f'stddev_samp({c})')} as sd, {qs}, {hist} as hist "
                     f"from {src} s, (select quantile_cont({c}, 0.0) as lo, quantile_cont({c}, 1.0) as hi "
                     f"from {src} s2) q group by q.lo, q.hi")
    return "\nunion all\n".join(parts)


@register("profile_numeric", _sql_profile_numeric(B.SQL_LINEITEM_MASKED, B.LINEITEM_MEASURES))
def q_profile_numeric(spark, sf):
    """D5 numeric skim on masked lineitem."""
    from limnos.operators.profile import profile_numeric
    return profile_numeric(B.lineitem_masked(spark, sf), B.LINEITEM_MEASURES)


def _sql_profile_text(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        nm = f"count(*) filter (where {c} is null)"
        parts.append(
            f"select '{c}' as \"column\", {nm} as n_missing, "
            f"{R(f'cast(count(*) - {nm} as double) / count(*)')} as complete_rate, "
            f"cast(min(length({c})) as bigint) as min_length, cast(max(length({c})) as bigint) as max_length, "
            f"count(*) filter (where {c} = '') as n_empty, count(distinct {c}) as n_unique, "
            f"count(*) filter (where regexp_matches({c}, '^\\s+$')) as n_whitespace from {src}")
    return "\nunion all\n".join(parts)


TEXT_COLS_ORDERS = ["o_orderstatus", "o_orderpriority"]


@register("profile_text", _sql_profile_text("orders", TEXT_COLS_ORDERS))
def q_profile_text(spark, sf):
    """D5 text skim on the orders text columns."""
    from limnos.operators.profile import profile_text
    return profile_text(B.table(spark, sf, "orders"), TEXT_COLS_ORDERS)


@register("level_counts", "select event_type as level, count(*) as n from events group by event_type")
def q_level_counts(spark, sf):
    """D4 + G1: frequency of each characteristic, most frequent first."""
    from limnos.operators.profile import level_counts
    return level_counts(B.table(spark, sf, "events"), "event_type")


def _sql_iqr_report(src: str, cols: list[str], k: float) -> str:
    parts = []
    for c in cols:
        parts.append(f"""
select '{c}' as "column", {R('f.q1')} as q1, {R('f.q3')} as q3, {R('f.lo')} as lower, {R('f.hi')} as upper,
       count(*) filter (where s.{c} < f.lo or s.{c} > f.hi) as n_outliers,
       {R(f'cast(count(*) filter (where s.{c} < f.lo or s.{c} > f.hi) as double) * 100 / count(*)')} as pct_outliers
from {src} s, (select q1, q3, q1 - {k} * (q3 - q1) as lo, q3 + {k} * (q3 - q1) as hi
               from (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {src} t)) f
group by f.q1, f.q3, f.lo, f.hi""")
    return "\nunion all\n".join(parts)


@register("iqr_outlier_report", _sql_iqr_report(B.SQL_EVENTS_MEASURES, ["value", "value_per_hour"], 1.5))
def q_iqr_outlier_report(spark, sf):
    """D7 + D8 on events (value and value per hour), k = 1.5."""
    from limnos.operators.outliers import iqr_outlier_report
    return iqr_outlier_report(B.events_measures(spark, sf), ["value", "value_per_hour"], k=1.5)


@register("iqr_outlier_report_doc_length", _sql_iqr_report("documents", ["n_chars"], 1.5))
def q_iqr_outlier_report_docs(spark, sf):
    """D8 on documents.n_chars (heavy right tail)."""
    from limnos.operators.outliers import iqr_outlier_report
    return iqr_outlier_report(B.table(spark, sf, "documents"), ["n_chars"], k=1.5)


def _sql_iqr_chain(src: str, target: str, cols: list[str], k: float, select: str) -> str:
    ctes = [f"s0 as (select * from {src} x where {target} is not null)"]
    for i, c in enumerate(cols, start=1):
        prev = f"s{i - 1}"
        ctes.append(f"f{i} as (select q1 - {k} * (q3 - q1) as lo, q3 + {k} * (q3 - q1) as hi from "
                    f"(select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {prev}))")
        ctes.append(f"n{i} as (select count(*) as n_out from {prev}, f{i} where {c} < lo or {c} > hi)")
        ctes.append(f"s{i} as (select {prev}.* from {prev}, f{i}, n{i} "
                    f"where n_out = 0 or ({c} >= lo and {c} <= hi))")
    return "with " + ",\n".join(ctes) + f"\nselect {select} from s{len(cols)}"


EV_FENCE_COLS = ["value", "value_per_hour"]


@register("iqr_filter_sequential",
          _sql_iqr_chain(B.SQL_EVENTS_MEASURES, "value", EV_FENCE_COLS, 3.0,
                         "event_id, value, round(value_per_hour, 6) as value_per_hour"))
def q_iqr_filter_sequential(spark, sf):
    """J1 + E4: drop null target, then sequential k=3 fences on value, value per hour."""
    from limnos.plans.clean import clean_measurements
    out = clean_measurements(B.events_measures(spark, sf), "value", EV_FENCE_COLS, k=3.0)
    return out.select("event_id", "value", F.round("value_per_hour", 6).alias("value_per_hour"))


@register("clean_and_describe",
          "with c as (" + _sql_iqr_chain(B.SQL_EVENTS_MEASURES, "value", EV_FENCE_COLS, 3.0, "*") + ")\n"
          + _sql_describe("c", EV_FENCE_COLS))
def q_clean_and_describe(spark, sf):
    """Minimum slice: read -> drop null target -> sequential fences -> describe."""
    from limnos.plans.clean import clean_and_describe
    return clean_and_describe(B.events_measures(spark, sf), "value", EV_FENCE_COLS, k=3.0)


@register("zscore_filter", """
select event_id, value from events, (select avg(value) as mu, stddev_pop(value) as sd from events) st
where value is not null and abs((value - mu) / sd) <= 2.5""")
def q_zscore_filter(spark, sf):
    """|z| <= 2.5 on events.value (population std)."""
    from limnos.operators.outliers import zscore_filter
    return zscore_filter(B.table(spark, sf, "events"), "value", 2.5).select("event_id", "value")


@register("clip_percentile", f"""
select event_id, {R('least(greatest(value, p.lo), p.hi)')} as value_clipped
from events, (select quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi from events) p""")
def q_clip_percentile(spark, sf):
    """J3 + I6: clip events.value to its 1st..99th percentiles."""
    from limnos.operators.outliers import clip_percentile
    out = clip_percentile(B.table(spark, sf, "events"), "value", 1.0, 99.0, out="value_clipped")
    return out.select("event_id", F.round("value_clipped", 6).alias("value_clipped"))


@register("histogram_30", f"""
with r as (select min(value) as lo, max(value) as hi from events),
b as (select cast(least(floor((value - lo) / (hi - lo) * 30), 29) as bigint) as bin from events, r
      where value is not null),
c as (select bin, count(*) as n from b group by bin)
select g.range as bin, {R('lo + g.range * ((hi - lo) / 30)')} as lower,
       {R('lo + (g.range + 1) * ((hi - lo) / 30)')} as upper, coalesce(c.n, 0) as n
from range(30) g cross join r left join c on g.range = c.bin""")
def q_histogram_30(spark, sf):
    """30 equal-width bins of events.value (empty bins kept with 0)."""
    from limnos.operators.profile import histogram
    return histogram(B.table(spark, sf, "events"), "value", 30)


@register("combined_range", f"""
select {R('min(least(l_extendedprice, revenue))')} as range_min,
       {R('max(greatest(l_extendedprice, revenue))')} as range_max from {B.SQL_LINEITEM_REVENUE} s""")
def q_combined_range(spark, sf):
    """Range over price and revenue together."""
    from limnos.operators.profile import combined_range
    out = combined_range(B.lineitem_revenue(spark, sf), "l_extendedprice", "revenue")
    return out.select(F.round("range_min", 6).alias("range_min"), F.round("range_max", 6).alias("range_max"))
