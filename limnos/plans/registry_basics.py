"""Registered queries: schema, projection, ingest and summary operators (A, B1-B6, B12-B14, D1, D6, D9, K7)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from limnos.plans import bindings as B
from limnos.plans.registry import register
from limnos.session import ensure_checkpoint_dir

T = B.EVENT_TYPES


@register("require_columns", "select o_orderkey, o_custkey from orders")
def q_require_columns(spark, sf):
    """B1 + B4: of three wanted columns the two that exist are kept."""
    import warnings

    from limnos.operators.schema import project, require_columns
    orders = B.table(spark, sf, "orders")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return project(orders, require_columns(orders, ["o_orderkey", "o_custkey", "salinity"], mode="any"))


@register("bind_roles", "select event_id, user_id as station, value as temp from events")
def q_bind_roles(spark, sf):
    """B2: caller-named columns under role names, another column kept."""
    from limnos.operators.schema import bind_roles
    events = B.table(spark, sf, "events").select("event_id", "user_id", "value")
    return bind_roles(events, {"station": "user_id", "temp": "value"}, keep_others=True)


@register("rename_columns", "select event_id, event_type as characteristic, value as result from events")
def q_rename_columns(spark, sf):
    """Rename by map; names that do not exist are ignored."""
    from limnos.operators.schema import rename_columns
    events = B.table(spark, sf, "events").select("event_id", "event_type", "value")
    return rename_columns(events, {"event_type": "characteristic", "value": "result", "none": "x"})


@register("project_positions", "select o_orderkey, o_orderstatus from "
                               "(select o_orderkey, o_custkey, o_orderstatus from orders)")
def q_project_positions(spark, sf):
    """Columns 1 and 3."""
    from limnos.operators.schema import project_positions
    return project_positions(B.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), [1, 3])


@register("project_numeric", "select event_id, user_id, value from events")
def q_project_numeric(spark, sf):
    """The numeric columns of four."""
    from limnos.operators.schema import project_numeric
    return project_numeric(B.table(spark, sf, "events").select("event_id", "event_type", "user_id", "value"))


@register("validate_nonnegative", """
select event_id, value - 50 as centred, value - 50 < 0 as quarantined from events""")
def q_validate_nonnegative(spark, sf):
    """Rows of value - 50 split into accepted and quarantined."""
    from limnos.operators.schema import validate_nonnegative
    events = B.table(spark, sf, "events").select("event_id", (F.col("value") - 50).alias("centred"))
    good, bad = validate_nonnegative(events, ["centred"])
    return good.withColumn("quarantined", F.lit(False)).unionByName(bad.withColumn("quarantined", F.lit(True)))


@register("datetime_columns", """
select 'day_text' as "column", count(distinct strftime(ts, '%Y-%m-%d')) as n_days from events""")
def q_datetime_columns(spark, sf):
    """B13 + A5: of two text columns the one that holds dates, parsed and counted."""
    from limnos.operators.schema import datetime_columns
    from limnos.sources.ingest import parse_date_all_or_nothing
    events = B.table(spark, sf, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day_text"))
    found = datetime_columns(events)
    parsed = parse_date_all_or_nothing(events, found[0])
    return parsed.agg(F.lit(",".join(found)).alias("column"), F.count_distinct(F.col(found[0])).alias("n_days"))


@register("normalise_date", "select event_id, strftime(ts, '%Y%m%d') as day_key from events")
def q_normalise_date(spark, sf):
    """A timestamp as a date and a yyyyMMdd key."""
    from limnos.operators.schema import normalise_date
    out = normalise_date(B.table(spark, sf, "events").select("event_id", "ts"), "ts", out="day", key_out="day_key")
    return out.select("event_id", "day_key")


@register("shape", "select count(*) as n_rows, cast(3 as bigint) as n_columns from events")
def q_shape(spark, sf):
    """Rows and columns of three event columns."""
    from limnos.operators.profile import shape
    return shape(B.table(spark, sf, "events").select("event_id", "event_type", "value"))


@register("glimpse", """
with h as (select event_id, user_id, event_type from events order by event_id limit 5)
select 'event_id' as "column", string_agg(cast(event_id as varchar), ', ' order by event_id) as first_values from h
union all select 'user_id', string_agg(cast(user_id as varchar), ', ' order by event_id) from h
union all select 'event_type', string_agg(event_type, ', ' order by event_id) from h""")
def q_glimpse(spark, sf):
    """D6 + A7: the first five values of each column by event_id."""
    from limnos.operators.profile import glimpse
    return glimpse(B.table(spark, sf, "events").select("event_id", "user_id", "event_type"), "event_id", 5).select(
        "column", "first_values")


@register("preview", "select event_id, event_type from events order by event_id limit 5")
def q_preview(spark, sf):
    """The first five rows by event_id."""
    from limnos.sources.ingest import preview
    return preview(B.table(spark, sf, "events").select("event_id", "event_type"), "event_id", 5)


@register("imputation_summary", "\nunion all\n".join(
    f"select '{t}' as \"column\", count(*) filter (where {t} is null) as missing_before, "
    f"round(cast(count(*) filter (where {t} is null) as double) * 100 / count(*), 6) as pct_before, "
    f"cast(0 as bigint) as missing_after, cast(0 as double) as pct_after from {B.SQL_EVENTS_WIDE} w" for t in T))
def q_imputation_summary(spark, sf):
    """D9 + N1: gaps per characteristic before and after mean filling."""
    from limnos.operators.profile import imputation_summary
    from limnos.plans.impute import impute_mean
    wide = B.events_wide(spark, sf)
    return imputation_summary(wide, impute_mean(wide, T), T)


def _sql_scaled() -> str:
    mean = ", ".join(f"avg({t}) as m_{t}" for t in T)
    std = ", ".join(f"stddev_pop(coalesce({t}, m_{t})) as s_{t}" for t in T)
    cols = ", ".join(f"round(coalesce(({t} - m_{t}) / s_{t}, 0), 6) as {t}_z, "
                     f"cast({t} is null as integer) * 1.0::double as {t}_missing" for t in T)
    return (f"with w as (select * from {B.SQL_EVENTS_WIDE} x), m as (select {mean} from w), "
            f"s as (select {std} from w, m) select station_day, {cols} from w, m, s")


@register("scaled_with_missing", _sql_scaled())
def q_scaled_with_missing(spark, sf):
    """K7: standardised characteristics with gaps at 0 and masks."""
    from limnos.operators.features import scaled_with_missing
    out = scaled_with_missing(B.events_wide(spark, sf), T)
    return out.select("station_day", *[F.round(f"{t}_z", 6).alias(f"{t}_z") for t in T], *[f"{t}_missing" for t in T])


@register("csv_round_trip", """
select event_id, event_type, case when value < 10 then null else round(value, 6) end as result,
       strftime(ts, '%Y-%m-%d') as day from events""")
def q_csv_round_trip(spark, sf):
    """Events written as CSV with NA for small values, read back as text under other
    names, coerced to numbers and dates."""
    from limnos.sources.ingest import coerce_numeric, parse_date_all_or_nothing, read_measurements, write_table
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    events = B.table(spark, sf, "events").select(
        "event_id", "event_type", F.when(F.col("value") < 10, F.lit("NA")).otherwise(
            F.round("value", 6).cast("string")).alias("value"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    write_table(events, path, fmt="csv")
    back = read_measurements(spark, path, schema="event_id bigint, event_type string, result string, day string")
    typed = parse_date_all_or_nothing(coerce_numeric(back, ["result"]), "day")
    return typed.select("event_id", "event_type", F.round("result", 6).alias("result"),
                        F.date_format("day", "yyyy-MM-dd").alias("day"))


@register("csv_mixed_encodings", """
select c_custkey, replace(c_name, 'e', 'é') as name, case when c_custkey % 2 = 0 then 'UTF-8' else 'ISO-8859-1' end as written
from customer""")
def q_csv_mixed_encodings(spark, sf):
    """A2: a folder of UTF-8 and Latin-1 files, each decoded by the bytes it holds."""
    from limnos.sources.ingest import read_measurements
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/mixed-{uuid.uuid4().hex}"
    rows = B.table(spark, sf, "customer").select("c_custkey", F.replace("c_name", F.lit("e"), F.lit("é")).alias("name"))
    for k, encoding in enumerate(("UTF-8", "ISO-8859-1")):
        rows.where(F.col("c_custkey") % 2 == k).withColumn("written", F.lit(encoding)).write.mode("append").option(
            "header", True).option("encoding", encoding).csv(path)
    return read_measurements(spark, path, schema="c_custkey bigint, name string, written string")
