"""Reading, normalising and writing measurement tables.

Conventions: explicit schemas where known (inference only as a
convenience); blank and ``NA`` cells are NULL; NaN and sentinels are
converted to real NULLs at ingest because Spark treats NaN as a value
(sorts last, poisons ``avg``).
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.operators.profile import q


def _csv_reader(spark: SparkSession, schema, header: bool, null_value: str, encoding: str, sep: str):
    r = (spark.read.option("header", header).option("nullValue", null_value).option("encoding", encoding)
         .option("sep", sep).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE"))
    if schema is not None:
        r = r.schema(schema).option("enforceSchema", True)
    else:
        r = r.option("inferSchema", True)
    return r


def invalid_utf8_files(spark: SparkSession, path: str) -> dict[str, bool]:
    """Each file of ``path`` and whether it has a line that is not valid UTF-8 (a row per file).

    The text source hands on the bytes of a line unchanged."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    rows = lines.groupBy("file").agg(F.bool_or(~F.is_valid_utf8("value")).alias("bad")).collect()
    return {unquote(r["file"]): bool(r["bad"]) for r in rows}


def read_measurements(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                      header: bool = True, null_value: str = "NA", sep: str = ",",
                      encodings: Sequence[str] = ("UTF-8", "ISO-8859-1"),
                      numeric_sentinels: Sequence[float] = (), nan_to_null: bool = True) -> DataFrame:
    """A1 + A2 + A3: CSV scan with header, blank/``NA`` -> null, an encoding per file.

    The bytes of every line are checked first; files with a line that is not valid UTF-8 are
    read in the second encoding, all others in the first, so a folder may mix them (Latin-1 decodes
    every byte, so it ends the chain).  Files whose bytes fit the first encoding cost that
    one scan.  With ``schema`` the header line is skipped and names come from the schema (headerless /
    renamed files); without, it is inferred once for all files.
    """
    first, rest = encodings[0], list(encodings[1:])
    odd = invalid_utf8_files(spark, path) if first.upper().replace("-", "") == "UTF8" and rest else {}
    wrong = [f for f, bad in odd.items() if bad]
    if not wrong:
        df = _csv_reader(spark, schema, header, null_value, first, sep).csv(path)
    elif len(wrong) == len(odd):
        df = _csv_reader(spark, schema, header, null_value, rest[0], sep).csv(path)
    else:
        if schema is None:
            schema = _csv_reader(spark, None, header, null_value, rest[-1], sep).csv(path).schema
        right = [f for f, bad in odd.items() if not bad]
        df = _csv_reader(spark, schema, header, null_value, first, sep).csv(right).unionByName(
            _csv_reader(spark, schema, header, null_value, rest[0], sep).csv(wrong))
    if numeric_sentinels:
        num = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
        df = sentinels_to_null(df, numeric={c: list(numeric_sentinels) for c in num})
    if nan_to_null:
        df = nans_to_null(df)
    return df


def nans_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every float/double column."""
    fl = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not fl:
        return df
    return df.withColumns({c: F.when(F.isnan(F.col(q(c))), F.lit(None)).otherwise(F.col(q(c))) for c in fl})


def coerce_numeric(df: DataFrame, cols: Sequence[str], to: str = "double") -> DataFrame:
    """A4: text -> number; unparseable -> NULL (``try_cast`` never raises)."""
    return df.withColumns({c: F.col(q(c)).try_cast(to) for c in cols})


def parse_date_all_or_nothing(df: DataFrame, col: str, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """A5: adopt the parsed date only if every non-empty value parses.

    One aggregate compares ``count_if(trim(c) <> '')`` with the number of
    parsed values; otherwise the strings are kept and a warning is issued.
    """
    x = F.col(q(col))
    parsed = F.to_date(F.try_to_timestamp(x, F.lit(fmt)))
    row = df.agg(F.count_if(F.trim(x) != "").alias("n"), F.count(parsed).alias("p")).collect()[0]
    if row["n"] == row["p"]:
        return df.withColumn(col, parsed)
    warnings.warn(f"{col}: {row['n'] - row['p']} values do not parse as {fmt}; kept as text", stacklevel=2)
    return df


def sentinels_to_null(df: DataFrame, numeric: Mapping[str, Sequence[float]] | None = None,
                      text: Mapping[str, Sequence[str]] | None = None, trim: bool = True) -> DataFrame:
    """Sentinel values -> NULL, per column.

    ``numeric`` maps column -> values (e.g. -999); ``text`` maps column ->
    strings compared after trimming (e.g. ``NA``, ``Inf``).
    """
    repl = {}
    for c, vals in (numeric or {}).items():
        x = F.col(q(c))
        repl[c] = F.when(x.isin([float(v) for v in vals]), F.lit(None)).otherwise(x)
    for c, vals in (text or {}).items():
        x = F.col(q(c))
        probe = F.trim(x.cast("string")) if trim else x.cast("string")
        repl[c] = F.when(probe.isin(list(vals)), F.lit(None)).otherwise(x)
    return df.withColumns(repl) if repl else df


def preview(df: DataFrame, order_by: str | Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows by a key (TakeOrdered: ``n`` rows per task)."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*[F.col(q(k)) for k in keys]).limit(n)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] | None = None) -> None:
    """Write CSV (header, UTF-8) or Parquet; the directory is created."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("encoding", "UTF-8").csv(path)
    else:
        w.parquet(path)


def inline_rows(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """A10: literal rows (e.g. one (chl, temp) pair) as a DataFrame for ``transform``."""
    return spark.createDataFrame(list(rows), schema)


def with_row_id(df: DataFrame, col: str = "row_id") -> DataFrame:
    """Explicit row identity at ingest (unique, increasing within a file split).

    ``monotonically_increasing_id`` is unique but not dense; it is stable
    for the same files and split settings.  Prefer a business key when the
    data has one.
    """
    return df.withColumn(col, F.monotonically_increasing_id())
