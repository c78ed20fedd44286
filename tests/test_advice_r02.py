"""Parts of the model queries that were less than the whole job."""

import itertools
import json

import numpy as np

from limnos.plans import registry_models as R
from limnos.plans import tuning
from limnos.plans.models import train


def measures(spark, n=240):
    r = np.random.default_rng(4)
    x = r.normal(size=(n, 3)) * [1.0, 5.0, 0.1]
    y = 2 * x[:, 0] + x[:, 0] * x[:, 1] - x[:, 2] ** 2 + r.normal(size=n) * 0.1
    return x, y, spark.createDataFrame([(i, *map(float, row), float(t)) for i, (row, t) in enumerate(zip(x, y))],
                                       "id long, a double, b double, c double, y double")


def test_ridge_on_the_best_terms_of_degree_two(spark):
    x, y, df = measures(spark)
    z = (x - x.mean(0)) / x.std(0)
    terms = np.column_stack([z, *(z[:, i] * z[:, j] for i, j in itertools.combinations_with_replacement(range(3), 2))])
    score = [abs(np.corrcoef(t, y)[0, 1]) for t in terms.T]
    kept = sorted(np.argsort(score)[-4:])
    t = terms[:, kept] - terms[:, kept].mean(0)
    want = np.linalg.solve(t.T @ t + 10 * np.eye(4), t.T @ (y - y.mean()))
    tm = train(df, ["a", "b", "c"], "y", "ridge", degree=2, k_best=4, alpha=10.0)
    assert np.allclose(tm.regressor.coefficients.toArray(), want, atol=1e-6)
    assert len(train(df, ["a", "b", "c"], "y", "ridge", k_best=15).vector_features) == 3


def test_tuned_comparison_takes_the_best_point(spark):
    _, _, df = measures(spark)
    grid = {"degree": [1, 2], "k_best": [2, None], "alpha": [0.1, 1000.0]}
    found = [json.loads(r["params"]) for r in tuning.grid_search(df, ["a", "b", "c"], "y", "id", "ridge", grid, k=2).collect()]
    assert len(found) == 8 and found[0] == {"alpha": 0.1, "degree": 2, "k_best": None}
    row = tuning.basic_vs_enhanced(df, ["a", "b"], ["a", "b", "c"], "y", "id", enhanced_kind="ridge", grid=grid).first()
    assert row["enhanced_r2"] > 0.95 > row["basic_r2"]


def test_queries_pass_the_whole_lists(monkeypatch):
    calls = []
    for name in ("_engineered", "_engineered_10k"):
        monkeypatch.setattr(R, name, lambda spark, sf: None)
    for name in ("grid_search", "basic_vs_enhanced"):
        monkeypatch.setattr(tuning, name, lambda *a, **k: calls.append((a, k)))
    monkeypatch.setattr(tuning, "train_and_compare", lambda *a, **k: (calls.append((a, k)), None, None))
    monkeypatch.setattr(tuning, "choose_experiment", lambda boards: None)
    R.q_tune_ridge(None, None), R.q_basic_vs_enhanced(None, None), R.q_experiment_choice(None, None)
    tune, compare, base, eng = calls
    assert np.prod([len(v) for v in tune[0][5].values()]) == 48
    assert len(compare[0][1]) == 3 and len(compare[0][2]) == 9 and compare[1]["grid"] is tune[0][5]
    assert len(base[0][1]) == 3 and len(eng[0][1]) == 9 and len(eng[1]["kinds"]) == 6 and base[1] == eng[1]


def test_registered_forests_grow_without_limit(monkeypatch):
    from limnos.plans import models

    calls = []
    monkeypatch.setattr(R, "_li", lambda spark, sf: None)
    monkeypatch.setattr(models, "train", lambda *a, **k: calls.append(k))
    monkeypatch.setattr(models, "importance_table", lambda tm: None)
    monkeypatch.setattr(tuning, "train_and_compare", lambda *a, **k: calls.append(k["model_params"]["random_forest"])
                        or (None, None, None))
    R.q_train_compare(None, None), R.q_importance(None, None)
    assert calls == [{"num_trees": 100}] * 2


def test_permuted_forest_grows_without_limit(spark, monkeypatch):
    from limnos.plans import models

    calls = []
    monkeypatch.setattr(models, "train", lambda *a, **k: calls.append(k))
    monkeypatch.setattr(models, "permutation_importance", lambda *a: None)
    R.q_permutation_importance(spark, "/root/testdata/sf0.001")
    assert calls == [{"num_trees": 100}]
