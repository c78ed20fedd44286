"""Regressors, coefficient / importance tables and model persistence
(M1-M12, M14, A9).

Every model but the forest (``plans.forest``) and ``boosted`` (``plans.boosting``) is a Spark ML ``PipelineModel``:

    [SQLTransformer: engineered terms]   (optional, e.g. degree-2 monomials)
    SQLTransformer: standardise          (train mean / population std as literals)
    VectorAssembler
    regressor

Standardisation uses population std fitted on the training rows only
(never before the split).  Spark's ``StandardScaler`` uses the sample std,
so the scaler is a persisted SQL statement instead.  Fitting is
distributed: the normal-equation solver aggregates X'X (k x k) with a
tree aggregate, trees grow from distributed histograms; nothing row-sized
reaches the driver.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import (
    GBTRegressor,
    GeneralizedLinearRegression,
    LinearRegression,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.operators.features import fit_standardizer, polynomial_name, polynomial_terms
from limnos.operators.metrics import regression_metrics
from limnos.operators.profile import q
from limnos.plans.boosting import BoostedModel, train_boosted
from limnos.plans.forest import ForestModel, train_forest

OWN_MODELS = {"random_forest": ForestModel, "boosted": BoostedModel}
MODEL_KINDS = ("linear", "polynomial", "ridge", "lasso", "elastic_net", "random_forest", "gbm", "boosted")


def _lit(v: float) -> str:
    return repr(float(v))


def standardizer_stage(stats: Mapping[str, tuple[float, float]], suffix: str = "__z") -> SQLTransformer:
    """SQLTransformer computing (x - mean) / std with fitted literals."""
    cols = ", ".join(f"({q(c)} - {_lit(m)}) / {_lit(s if s else 1.0)} AS {q(c + suffix)}"
                     for c, (m, s) in stats.items())
    return SQLTransformer(statement=f"SELECT *, {cols} FROM __THIS__")


def polynomial_stage(cols: Sequence[str], degree: int = 2) -> tuple[SQLTransformer, list[str]]:
    """SQLTransformer adding all monomials of degree >= 2 (scikit-learn order)."""
    terms = [t for t in polynomial_terms(cols, degree) if len(t) > 1]
    names = [polynomial_name(t) for t in terms]
    exprs = ", ".join(" * ".join(q(c) for c in t) + f" AS {q(n)}" for t, n in zip(terms, names))
    return SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__"), list(cols) + names


@dataclass
class TrainedModel:
    """A fitted pipeline plus what is needed to use and describe it."""
    name: str
    kind: str
    model: PipelineModel | ForestModel | BoostedModel
    features: list[str]
    label: str
    vector_features: list[str] = field(default_factory=list)
    params: dict = field(default_factory=dict)

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        out = self.model.transform(df)
        if prediction != "prediction":
            out = out.withColumnRenamed("prediction", prediction)
        return out.drop("features", *[c for c in out.columns if c.endswith("__z")])

    @property
    def regressor(self):
        return self.model.stages[-1]


def train(df: DataFrame, features: Sequence[str], label: str, kind: str = "linear", name: str | None = None,
          standardize: bool = True, degree: int | None = None, alpha: float = 1.0, l1_ratio: float = 0.5,
          k_best: int | None = None, num_trees: int = 100, max_depth: int | None = None, min_instances: int = 1,
          min_split: int = 2, step_size: float = 0.1, max_iter: int = 100, subsampling: float = 1.0,
          max_leaves: int | None = None, l2: float = 1.0, seed: int = 42) -> TrainedModel:
    """Fit one regressor (M1-M8) on ``df`` (rows with a null feature/label are dropped).

    * ``linear`` (M1): OLS, normal-equation solver.
    * ``polynomial`` (M2): degree-``degree`` monomials (2 by default) of the
      standardised features, then OLS.
    * ``ridge`` (M3): scikit-learn ``Ridge(alpha)`` on standardised features.
      Spark penalises in label-scaled units, so regParam = alpha *
      stddev_pop(y) / n (n, sigma of the training rows).  With ``degree``
      above 1 on their monomials; with ``k_best`` on the terms of the highest
      |correlation| with the label (the order of the F score), all if fewer.
    * ``lasso`` (M4) / ``elastic_net`` (M5): mapped the same way.
    * ``random_forest`` (M6): all features per split (scikit-learn's regression default), grown to
      pure leaves without ``max_depth`` (see ``plans.forest``); trees need no scaler.
    * ``gbm`` (M7): ``GBTRegressor``.
    * ``boosted`` (M8): second-order boosting; ``max_iter`` trees of depth ``max_depth`` (6 by default; without
      limit if only ``max_leaves`` is given) grown best first up to ``max_leaves``.
    """
    if kind not in MODEL_KINDS:
        raise ValueError(f"unknown model kind {kind}; choose from {MODEL_KINDS}")
    features = list(features)
    if kind == "random_forest":
        forest = train_forest(df, features, label, num_trees, max_depth, min_instances, min_split, seed)
        return TrainedModel(name or kind, kind, forest, features, label, features, {"num_trees": num_trees})
    if kind == "boosted":
        depth = 6 if max_depth is None and max_leaves is None else max_depth
        trees = train_boosted(df, features, label, max_iter, step_size, depth, max_leaves, l2, min_instances,
                              subsample=subsampling, seed=seed)
        return TrainedModel(name or kind, kind, trees, features, label, features,
                            {"max_iter": max_iter, "step_size": step_size, "max_depth": depth, "max_leaves": max_leaves})
    data = df.select(*[F.col(q(c)) for c in features], F.col(q(label))).na.drop()
    stages = []
    params: dict = {}
    penalised = kind in ("ridge", "lasso", "elastic_net")
    stats: dict = {}
    if standardize or penalised:
        # one pass: scaler statistics and, for penalised fits, n and sigma of the label
        aggs = [F.count(F.lit(1)).alias("n"), F.stddev_pop(F.col(q(label))).alias("sy")]
        if standardize:
            for i, c in enumerate(features):
                aggs += [F.avg(F.col(q(c))).alias(f"m{i}"), F.stddev_pop(F.col(q(c))).alias(f"s{i}")]
        srow = data.agg(*aggs).collect()[0]
        if standardize:
            stats = {c: (srow[f"m{i}"], srow[f"s{i}"]) for i, c in enumerate(features)}
    zfeat = [c + "__z" for c in features] if standardize else list(features)
    if standardize:
        stages.append(standardizer_stage(stats))
        params["scaler"] = {c: [m, sd] for c, (m, sd) in stats.items()}
    vec_in = zfeat
    if kind == "polynomial" or (kind == "ridge" and (degree or 1) > 1):
        poly, vec_in = polynomial_stage(zfeat, degree or 2)
        stages.append(poly)
    if kind == "ridge" and k_best is not None and k_best < len(vec_in):
        terms = data
        for stage in stages:
            terms = stage.transform(terms)
        corr = terms.agg(*[F.abs(F.corr(F.col(q(c)), F.col(q(label)))) for c in vec_in]).collect()[0]
        score = [-1.0 if r is None or r != r else r for r in corr]
        vec_in = [vec_in[i] for i in sorted(sorted(range(len(vec_in)), key=lambda i: -score[i])[:k_best])]
    stages.append(VectorAssembler(inputCols=vec_in, outputCol="features", handleInvalid="keep"))

    if penalised:
        n, sy = int(srow["n"]), float(srow["sy"] or 0.0)
        params.update(n_train=n, sigma_y=sy, alpha=alpha)
    if kind in ("linear", "polynomial"):
        reg = LinearRegression(labelCol=label, regParam=0.0, solver="normal", standardization=False)
    elif kind == "ridge":
        reg = LinearRegression(labelCol=label, regParam=alpha * sy / n if n else 0.0, elasticNetParam=0.0,
                               solver="normal", standardization=False)
    elif kind == "lasso":
        reg = LinearRegression(labelCol=label, regParam=alpha, elasticNetParam=1.0, standardization=False,
                               maxIter=max_iter * 10, tol=1e-10)
    elif kind == "elastic_net":
        big_r = alpha * (l1_ratio + (1.0 - l1_ratio) * sy)
        reg = LinearRegression(labelCol=label, regParam=big_r, elasticNetParam=(alpha * l1_ratio / big_r) if big_r else 0.0,
                               solver="normal", standardization=False)
        params.update(l1_ratio=l1_ratio)
    else:  # gbm
        reg = GBTRegressor(labelCol=label, maxIter=max_iter, stepSize=step_size, maxDepth=3 if max_depth is None else max_depth,
                           minInstancesPerNode=min_instances, subsamplingRate=subsampling, seed=seed)
    stages.append(reg)
    model = Pipeline(stages=stages).fit(data)
    return TrainedModel(name or kind, kind, model, features, label, vec_in, params)


def evaluate(tm: TrainedModel, df: DataFrame, by: str | None = None) -> DataFrame:
    """D17 of a trained model on ``df`` (optionally per split)."""
    scored = tm.transform(df.na.drop(subset=[*tm.features, tm.label]))
    return regression_metrics(scored, tm.label, "prediction", by=by)


def coefficient_table(tm: TrainedModel, top: int | None = None) -> DataFrame:
    """(feature, coefficient, abs_coefficient) by |coefficient| desc, plus the intercept."""
    reg = tm.regressor
    names = tm.vector_features
    rows = [(n.removesuffix("__z"), float(c), abs(float(c))) for n, c in zip(names, reg.coefficients.toArray())]
    rows.sort(key=lambda r: -r[2])
    if top:
        rows = rows[:top]
    rows.append(("(intercept)", float(reg.intercept), abs(float(reg.intercept))))
    spark = tm.model.stages[0].sparkSession if hasattr(tm.model.stages[0], "sparkSession") else None
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "feature string, coefficient double, abs_coefficient double")


def importance_table(tm: TrainedModel) -> DataFrame:
    """Impurity importances of a tree model, largest first."""
    from pyspark.sql import SparkSession
    imp = tm.model.importances if tm.kind in OWN_MODELS else tm.regressor.featureImportances.toArray()
    rows = sorted(((n.removesuffix("__z"), float(v)) for n, v in zip(tm.vector_features, imp)), key=lambda r: -r[1])
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")


def original_scale_coefficients(tm: TrainedModel, stats: Mapping[str, tuple[float, float]] | None = None) -> dict[str, float]:
    """Linear coefficients mapped back from standardised to original units."""
    stats = stats or {c: tuple(v) for c, v in tm.params["scaler"].items()}
    reg = tm.regressor
    out, icpt = {}, float(reg.intercept)
    for n, c in zip(tm.vector_features, reg.coefficients.toArray()):
        base = n.removesuffix("__z")
        m, s = stats[base]
        s = s or 1.0
        out[base] = float(c) / s
        icpt -= float(c) * m / s
    out["(intercept)"] = icpt
    return out


# ------------------------------------------------------------- persistence

def save_model(tm: TrainedModel, path: str, metrics: Mapping[str, float] | None = None) -> None:
    """Pipeline directory + one-row metadata table (name, kind, features, label, params, metrics)."""
    if tm.kind in OWN_MODELS:
        tm.model.save(f"{path}/pipeline")
    else:
        tm.model.write().overwrite().save(f"{path}/pipeline")
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    meta = [(tm.name, tm.kind, json.dumps(tm.features), tm.label, json.dumps(tm.vector_features),
             json.dumps(tm.params), json.dumps(dict(metrics or {})))]
    spark.createDataFrame(meta, "name string, kind string, features string, label string, vector_features string, "
                                "params string, metrics string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_model(path: str) -> TrainedModel:
    """Load what ``save_model`` wrote."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    row = spark.read.parquet(f"{path}/meta").collect()[0]
    model = OWN_MODELS.get(row["kind"], PipelineModel).load(f"{path}/pipeline")
    return TrainedModel(row["name"], row["kind"], model, json.loads(row["features"]),
                        row["label"], json.loads(row["vector_features"]), json.loads(row["params"]))


# ------------------------------------------------------------- variance model

@dataclass
class GaussianModel:
    """Mean model plus log-variance model: the (mu, logvar) output contract of O1."""
    mean: TrainedModel
    variance: PipelineModel
    label_mean: float
    label_std: float

    def transform(self, df: DataFrame, mu: str = "mu", logvar: str = "logvar") -> DataFrame:
        scored = self.mean.transform(df, prediction=mu)
        out = self.variance.transform(scored).withColumn(logvar, F.ln(F.col("_var")))
        return out.drop("_var", "var_features", *[c for c in out.columns if c.endswith("__v")])


def save_gaussian(gm: GaussianModel, path: str) -> None:
    """A9 for the uncertainty model: the mean model, the variance pipeline and the label moments."""
    save_model(gm.mean, f"{path}/mean", {"label_mean": gm.label_mean, "label_std": gm.label_std})
    gm.variance.write().overwrite().save(f"{path}/variance")


def load_gaussian(path: str) -> GaussianModel:
    """Load what ``save_gaussian`` wrote; usable in another process."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    moments = json.loads(spark.read.parquet(f"{path}/mean/meta").collect()[0]["metrics"])
    return GaussianModel(load_model(f"{path}/mean"), PipelineModel.load(f"{path}/variance"),
                         moments["label_mean"], moments["label_std"])


def _linear_sql(terms: Sequence[str], coefs, name: str, wrap: str = "{}") -> SQLTransformer:
    """A linear combination of columns as a persisted stage."""
    text = " + ".join([_lit(coefs[0]), *(f"({_lit(c)}) * {q(t)}" for t, c in zip(terms, coefs[1:], strict=True))])
    return SQLTransformer(statement=f"SELECT *, {wrap.format(text)} AS {q(name)} FROM __THIS__")


def train_gaussian(df: DataFrame, features: Sequence[str], label: str, mean_kind: str = "polynomial",
                   rounds: int = 50, tol: float = 1e-7, **kwargs) -> GaussianModel:
    """M10 (re-aimed two-headed network): mean and log-variance of the label.

    With a ``linear`` or ``polynomial`` mean both are fitted together (``plans.gaussian``): the mean by least
    squares weighted with 1 / variance, the log-variance by Gamma steps on the squared residuals, in turn until
    the likelihood stops falling; ``trace`` of the mean's params holds it after every step.  Other kinds fit the
    mean on its own, then a Gamma GLM with log link on its squared residuals.
    """
    features = list(features)
    data = df.select(*[F.col(q(c)).cast("double").alias(c) for c in features], F.col(q(label)).cast("double").alias(label)).na.drop()
    stats = fit_standardizer(data, [*features, label])  # one pass: feature scaler + label moments
    label_mean, label_std = stats.pop(label)
    if mean_kind in ("linear", "polynomial") and not kwargs:
        from limnos.plans.gaussian import fit_joint
        place = range(len(features))
        pairs = [(i, j) for i in place for j in place if i <= j] if mean_kind == "polynomial" else []
        scaled = data.select(*[((F.col(q(c)) - F.lit(m)) / F.lit(sd or 1.0)).alias(f"x{i}")
                               for i, (c, (m, sd)) in enumerate(stats.items())], F.col(q(label)).alias("y"))
        b, c, trace = fit_joint(scaled, len(features), pairs, rounds, tol)
        stages, terms = [standardizer_stage(stats)], [f + "__z" for f in features]
        if pairs:
            poly, terms = polynomial_stage(terms, 2)
            stages.append(poly)
        stages.append(_linear_sql(terms, b, "prediction"))
        mean = TrainedModel(mean_kind, mean_kind, PipelineModel(stages), features, label, terms,
                            {"scaler": {f: [m, sd] for f, (m, sd) in stats.items()}, "trace": trace,
                             "coefficients": b.tolist(), "variance": c.tolist()})
        least = math.log(1e-12)
        variance = PipelineModel([standardizer_stage(stats, suffix="__v"), _linear_sql(
            [f + "__v" for f in features], c, "_var", f"exp(greatest(least({{}}, 600.0), {_lit(least)}))")])
        return GaussianModel(mean, variance, float(label_mean), float(label_std or 1.0))
    mean = train(df, features, label, kind=mean_kind, **kwargs)
    scored = mean.transform(data, prediction="_mu")
    resid = scored.withColumn("_r2", F.greatest((F.col(q(label)) - F.col("_mu")) ** 2, F.lit(1e-12)))
    var_pipe = Pipeline(stages=[
        standardizer_stage(stats, suffix="__v"),
        VectorAssembler(inputCols=[c + "__v" for c in features], outputCol="var_features", handleInvalid="keep"),
        GeneralizedLinearRegression(family="gamma", link="log", featuresCol="var_features", labelCol="_r2",
                                    predictionCol="_var", maxIter=50),
    ]).fit(resid)
    return GaussianModel(mean, var_pipe, float(label_mean), float(label_std or 1.0))


def adjusted_r2(r2: float, n: int, p: int) -> float:
    """1 - (1 - R^2)(n - 1)/(n - p - 1)."""
    if n - p - 1 <= 0:
        return float("nan")
    return 1.0 - (1.0 - r2) * (n - 1) / (n - p - 1)


def hinge_basis(df: DataFrame, cols: Sequence[str], knots: int = 5, exact: bool = True) -> tuple[DataFrame, list[str]]:
    """M9 basis: for each feature, hinge terms max(0, x - k_j) at quantile knots."""
    from limnos.operators.quantiles import quantiles
    probs = [(j + 1) / (knots + 1) for j in range(knots)]
    qs = quantiles(df, cols, probs, exact=exact)
    new, names = {}, []
    for c in cols:
        for j, kv in enumerate(qs[c]):
            if kv is None or math.isnan(kv):
                continue
            n = f"{c}__h{j}"
            new[n] = F.greatest(F.col(q(c)) - F.lit(kv), F.lit(0.0))
            names.append(n)
    return df.withColumns(new), names


def with_donor(df: DataFrame, key: Sequence[str] | str, cols: Sequence[str], seed: int = 42) -> DataFrame:
    """``df`` with ``_donor``: the values of ``cols`` of another row.

    Rows are ranked once by a salted md5 of their key (range-partitioned, checkpointed, so a repeated
    task cannot change it), and each takes the values of the next one, the last those of the first: one random
    cycle through all rows.  ``key`` must be unique."""
    from limnos.functions.scalar import key_string
    from limnos.operators.ranking import rank_by_value
    keys = [key] if isinstance(key, str) else list(key)
    text = key_string(*keys)
    base = df.withColumns({"_hash": F.md5(F.concat(text, F.lit(f":{seed}"))), "_text": text})
    ranked = rank_by_value(base, ["_hash", "_text"], out="_rank")
    n = ranked.count()
    donors = ranked.select(((F.col("_rank") + n - 2) % n + 1).alias("_rank"), F.struct(*[F.col(q(c)) for c in cols]).alias("_donor"))
    return ranked.join(donors, "_rank").drop("_rank", "_hash", "_text")


def permute_column(df: DataFrame, col: str, key: Sequence[str] | str, seed: int = 42) -> DataFrame:
    """Replace ``col`` by a permutation of itself across rows (each row takes its donor's value)."""
    joined = with_donor(df, key, [col], seed)
    return joined.withColumn(col, F.col("_donor")[col]).select(*df.columns)


def permutation_importance(tm: TrainedModel, df: DataFrame, key: Sequence[str] | str, seed: int = 42) -> DataFrame:
    """M12 (R ``importance=TRUE``): increase in MSE when one feature is permuted.

    -> (feature, mse_increase, pct_increase) largest first.  One donor per row carries all features; each row is
    scored as it is and once per feature with the donor's value, and one aggregate gives every error.
    """
    from pyspark.sql import SparkSession
    keys = [key] if isinstance(key, str) else list(key)
    data = df.select(*keys, *tm.features, tm.label).na.drop()
    joined = with_donor(data, keys, tm.features, seed)

    def variant(f: str | None):
        cols = [F.col("_donor")[c].alias(c) if c == f else F.col(q(c)) for c in tm.features]
        return F.struct(F.lit(f or "").alias("_permuted"), *cols, F.col(q(tm.label)))

    stacked = joined.select(F.explode(F.array(variant(None), *map(variant, tm.features))).alias("_v")).select("_v.*")
    scores = regression_metrics(tm.transform(stacked), tm.label, "prediction", by="_permuted", digits=None)
    mse = {r["_permuted"]: r["mse"] for r in scores.collect()}
    base = mse[""]
    rows = [(f, float(mse[f] - base), float((mse[f] - base) / base * 100.0) if base else None) for f in tm.features]
    rows.sort(key=lambda r: -r[1])
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, mse_increase double, pct_increase double")
