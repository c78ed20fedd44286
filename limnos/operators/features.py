"""Feature engineering (K1-K7).

All features are column expressions added with one ``withColumns`` call,
so they fuse into the scan's codegen stage.  Statistics needed by a
feature (means, population std) are one aggregate over the *fit* frame
(the training rows) and are applied as literals.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.functions.scalar import ln_offset, safe_div, weekday0
from limnos.operators.profile import q
from limnos.operators.schema import datetime_columns

TWO_PI = 2.0 * math.pi


def temporal_features(df: DataFrame, cols: Sequence[str] | None = None, drop_source: bool = True,
                      parse_strings: bool = True) -> DataFrame:
    """K1: per datetime column c add c_hour, c_day, c_month, c_year,
    c_dayofweek (Monday = 0) and the cyclic c_hour_sin/cos (period 24),
    c_month_sin/cos (period 12); drop c.

    Default columns: timestamp/date columns plus string columns whose
    every value parses (B13); a string column that fails to parse is left
    alone.
    """
    if cols is None:
        cols = [f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
        if parse_strings:
            cols += datetime_columns(df)
    new = {}
    for c in cols:
        field = df.schema[c].dataType
        ts = F.try_to_timestamp(F.col(q(c))) if isinstance(field, T.StringType) else F.col(q(c))
        hour, month = F.hour(ts), F.month(ts)
        new.update({
            f"{c}_hour": hour, f"{c}_day": F.dayofmonth(ts), f"{c}_month": month, f"{c}_year": F.year(ts),
            f"{c}_dayofweek": weekday0(ts),
            f"{c}_hour_sin": F.sin(F.lit(TWO_PI) * hour / F.lit(24)),
            f"{c}_hour_cos": F.cos(F.lit(TWO_PI) * hour / F.lit(24)),
            f"{c}_month_sin": F.sin(F.lit(TWO_PI) * month / F.lit(12)),
            f"{c}_month_cos": F.cos(F.lit(TWO_PI) * month / F.lit(12)),
        })
    out = df.withColumns(new)
    return out.drop(*cols) if drop_source else out


def ratio_features(df: DataFrame, temp: str, do: str, chl: str) -> DataFrame:
    """K2: the six engineered pH features.

    Fixed output names (they must equal the reference's):
    temp_doxy_ratio, chl_a_doxy_ratio, chl_a_temp_ratio, log_chl_a,
    temp_squared, doxy_squared.  A zero divisor gives NULL (not inf).
    """
    t, d, c = F.col(q(temp)), F.col(q(do)), F.col(q(chl))
    return df.withColumns({
        "temp_doxy_ratio": safe_div(t, d),
        "chl_a_doxy_ratio": safe_div(c, d),
        "chl_a_temp_ratio": safe_div(c, t),
        "log_chl_a": F.log1p(c),
        "temp_squared": t * t,
        "doxy_squared": d * d,
    })


def interaction_features(df: DataFrame, chla: str, temp: str, do: str, eps: float = 1e-5) -> DataFrame:
    """K3: the eleven interaction features (14 with the three inputs).

    Fixed output names (they must equal the reference's):
    temp_do_interaction, chla_temp_interaction, chla_do_interaction,
    do_temp_ratio, chla_do_ratio, chla_squared, temp_squared, do_squared,
    chla_log, temp_log, do_log.  Ratios add 1e-5 to the divisor and logs
    add 1e-5 to the argument; ``try_divide`` / ``ln`` give NULL where NumPy
    would give inf / -inf.
    """
    a, t, d = F.col(q(chla)), F.col(q(temp)), F.col(q(do))
    return df.withColumns({
        "temp_do_interaction": t * d,
        "chla_temp_interaction": a * t,
        "chla_do_interaction": a * d,
        "do_temp_ratio": safe_div(d, t + F.lit(eps)),
        "chla_do_ratio": safe_div(a, d + F.lit(eps)),
        "chla_squared": a * a,
        "temp_squared": t * t,
        "do_squared": d * d,
        "chla_log": ln_offset(a, eps),
        "temp_log": ln_offset(t, eps),
        "do_log": ln_offset(d, eps),
    })


def polynomial_terms(cols: Sequence[str], degree: int = 2, include_bias: bool = False) -> list[tuple[str, ...]]:
    """Monomials in scikit-learn's order: by degree, then lexicographic by position."""
    terms: list[tuple[str, ...]] = [()] if include_bias else []
    for d in range(1, degree + 1):
        terms += list(combinations_with_replacement(list(cols), d))
    return terms


def polynomial_name(term: tuple[str, ...]) -> str:
    return "1" if not term else "*".join(term)


def polynomial_features(df: DataFrame, cols: Sequence[str], degree: int = 2, include_bias: bool = False,
                        keep_linear: bool = True) -> DataFrame:
    """K4: every monomial up to ``degree`` as a named column (``a*b``, ``a*a``).

    Spark's ``PolynomialExpansion`` orders terms differently and drops the
    bias, so terms are built explicitly.
    """
    new = {}
    for term in polynomial_terms(cols, degree, include_bias):
        if len(term) == 1 and keep_linear:
            continue
        expr = F.lit(1.0)
        for c in term:
            expr = expr * F.col(q(c))
        new[polynomial_name(term)] = expr
    return df.withColumns(new)


def fit_standardizer(fit_df: DataFrame, cols: Sequence[str], mean_filled: bool = False) -> dict[str, tuple[float, float]]:
    """Means and *population* std of ``cols`` on the fit (training) rows -- one aggregate.

    ``mean_filled=True`` gives the std of the column after filling its
    nulls with the mean (sqrt(var_pop * n_obs / n_all)), as a scaler fitted
    on a mean-filled matrix sees it.
    """
    aggs = [F.count(F.lit(1)).alias("n_all")]
    for i, c in enumerate(cols):
        x = F.col(q(c)).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"), F.count(x).alias(f"n{i}")]
    row = fit_df.agg(*aggs).collect()[0]
    out = {}
    for i, c in enumerate(cols):
        m, v, n = row[f"m{i}"], row[f"v{i}"], row[f"n{i}"]
        if v is not None and mean_filled and row["n_all"]:
            v = v * n / row["n_all"]
        out[c] = (m, math.sqrt(v) if v is not None else None)
    return out


def standardize(df: DataFrame, cols: Sequence[str], stats: Mapping[str, tuple[float, float]] | None = None,
                fit_df: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """K5: (x - mean) / population std with statistics from ``fit_df`` (train).

    A zero std leaves the centred value (scikit-learn divides by 1).
    """
    stats = stats or fit_standardizer(fit_df if fit_df is not None else df, cols)
    new = {}
    for c in cols:
        m, s = stats[c]
        s = 1.0 if not s else s
        new[c + suffix] = (F.col(q(c)) - F.lit(m)) / F.lit(s)
    return df.withColumns(new)


def unstandardize(df: DataFrame, col: str, mean: float, std: float, out: str | None = None) -> DataFrame:
    """K5 inverse: z * std + mean (for a scaled target)."""
    return df.withColumn(out or col, F.col(q(col)) * F.lit(std or 1.0) + F.lit(mean))


def scaled_with_missing(df: DataFrame, cols: Sequence[str], fit_df: DataFrame | None = None,
                        suffix: str = "_z", mask_suffix: str = "_missing") -> DataFrame:
    """K7: mean-fill, standardise, then set missing cells to 0; add 0/1 masks.

    Filling with the mean then standardising puts filled cells at 0, so
    z = coalesce((x - mean) / std_filled, 0); the std is that of the
    mean-filled column.
    """
    stats = fit_standardizer(fit_df if fit_df is not None else df, cols, mean_filled=True)
    new = {}
    for c in cols:
        m, s = stats[c]
        s = 1.0 if not s else s
        x = F.col(q(c))
        new[c + suffix] = F.coalesce((x - F.lit(m)) / F.lit(s), F.lit(0.0))
        new[c + mask_suffix] = x.isNull().cast("double")
    return df.withColumns(new)


def select_k_best(df: DataFrame, features: Sequence[str], label: str, k: int | None = None) -> list[str]:
    """K6: keep the k features with the largest univariate F statistic
    against a continuous label (all when ``k`` is None).

    Spark ML ``UnivariateFeatureSelector`` (continuous / continuous = F-test,
    ``numTopFeatures``) fitted on one assembled vector; the selection is a
    distributed aggregate, only the chosen indices reach the driver.
    """
    from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler
    feats = list(features)
    if k is None or k >= len(feats):
        return feats
    data = VectorAssembler(inputCols=feats, outputCol="_fv", handleInvalid="skip").transform(
        df.select(*[F.col(q(c)) for c in feats], F.col(q(label))).na.drop())
    sel = UnivariateFeatureSelector(featuresCol="_fv", labelCol=label, outputCol="_sel",
                                    selectionMode="numTopFeatures").setFeatureType("continuous") \
        .setLabelType("continuous").setSelectionThreshold(k)
    model = sel.fit(data)
    return [feats[i] for i in sorted(model.selectedFeatures)]
