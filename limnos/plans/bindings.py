"""Table bindings for the driver test tables.

The driver tables carry no measurement columns, so roles are bound
(SURVEY 7.3): ``lineitem`` is a wide numeric table, ``events`` a long
measurement table (``event_type`` = characteristic, ``value`` = result,
``user_id`` = station), ``orders`` dated rows with a unique key.

Stand-in nulls are made with the library's own hash mask (L5) so the same
cells are null in Spark and in the DuckDB oracle; the helpers below give
both forms.  They only shape the input -- the operators do the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.operators.split import mask_columns

LINEITEM_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_KEY = ["l_orderkey", "l_linenumber"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with a second numeric column: value per hour of day (value / (1 + hour(ts)))."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "ts", "user_id", "event_type", "value",
                     (F.col("value") / (F.lit(1) + F.hour("ts"))).alias("value_per_hour"))


def lineitem_masked(spark: SparkSession, sf_dir: str, frac: float = 0.1) -> DataFrame:
    """lineitem measures with ``frac`` of each column hidden by the hash mask."""
    li = table(spark, sf_dir, "lineitem").select(*LINEITEM_KEY, *LINEITEM_MEASURES, "l_shipdate")
    return mask_columns(li, LINEITEM_MEASURES, LINEITEM_KEY, frac)


def lineitem_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the derived label ``revenue = l_extendedprice * (1 - l_discount)``."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(*LINEITEM_KEY, *LINEITEM_MEASURES, "l_shipdate", "l_returnflag", "l_linestatus",
                     (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("revenue"))


# ----------------------------------------------------------------- SQL side

def sql_key(*cols: str) -> str:
    parts = [f"cast({c} as varchar)" for c in cols]
    return " || '|' || ".join(parts)


def sql_bucket(key_sql: str, modulo: int, salt: str | None = None) -> str:
    text = key_sql if salt is None else f"({key_sql}) || ':{salt}'"
    return f"(cast(('0x' || substr(md5({text}), 1, 8)) as bigint) % {modulo})"


def sql_mask(col: str, key_sql: str, frac: float = 0.1) -> str:
    return f"case when {sql_bucket(key_sql, 1000, col)} < {int(round(frac * 1000))} then null else {col} end"


LI_KEY_SQL = sql_key(*LINEITEM_KEY)

SQL_LINEITEM_MASKED = (
    "(select l_orderkey, l_linenumber, "
    + ", ".join(f"{sql_mask(c, LI_KEY_SQL)} as {c}" for c in LINEITEM_MEASURES)
    + ", l_shipdate from lineitem)"
)

SQL_EVENTS_MEASURES = (
    "(select event_id, ts, user_id, event_type, value, value / (1 + hour(ts)) as value_per_hour from events)"
)

SQL_LINEITEM_REVENUE = (
    "(select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, "
    "l_returnflag, l_linestatus, l_extendedprice * (1 - l_discount) as revenue from lineitem)"
)


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def events_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide measurement table with natural gaps: one row per (station, day),
    one averaged column per characteristic, key ``station_day`` (text)."""
    from limnos.operators.reshape import pivot_wide
    ev = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    wide = pivot_wide(ev, ["user_id", "day"], "event_type", "value", EVENT_TYPES)
    return wide.select(F.concat_ws("|", F.col("user_id").cast("string"), F.col("day")).alias("station_day"),
                       *EVENT_TYPES)


SQL_EVENTS_WIDE = (
    "(select cast(user_id as varchar) || '|' || strftime(ts, '%Y-%m-%d') as station_day, "
    + ", ".join(f"avg(value) filter (where event_type = '{t}') as {t}" for t in EVENT_TYPES)
    + " from events group by user_id, strftime(ts, '%Y-%m-%d'))"
)
