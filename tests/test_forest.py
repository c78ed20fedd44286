"""Forests: exact trees against a brute-force one, both phases, scoring and persistence."""

import os

import numpy as np
import pandas as pd
import pytest
from conftest import frame

from limnos.operators.metrics import regression_metrics
from limnos.plans import forest
from limnos.plans.models import importance_table, load_model, save_model, train


def brute_tree(x, y, w, depth=None, least=1, region_rows=10 ** 9, edges=None):
    """Nested (feature, threshold, left, right) or a leaf's mean, tried split by split."""
    if len(y) <= region_rows:
        mean = (w * y).sum() / w.sum()
        return brute_node(x, y - mean, w, depth, least, 10 ** 9, None, mean)
    return brute_node(x, y, w, depth, least, region_rows, edges, 0.0)


def brute_node(x, y, w, depth, least, region_rows, edges, mean):
    if len(y) <= region_rows and edges is not None:
        return brute_tree(x, y, w, depth, least)
    total, sum_y = w.sum(), (w * y).sum()
    tie = 1e-10 * (w * y * y).sum()
    if len(set(y)) == 1 or total < 2 or depth == 0:
        return sum_y / total + mean
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        cuts = forest.midpoint(values[:-1], values[1:]) if len(y) <= region_rows else edges[f]
        for t in cuts:
            go = x[:, f] <= t
            wl, wr = w[go].sum(), w[~go].sum()
            if wl < least or wr < least or not wl or not wr:
                continue
            score = (w * y)[go].sum() ** 2 / wl + (w * y)[~go].sum() ** 2 / wr
            if best is None or score > best[0] + (tie if edges is None else 0.0):
                best = score, f, t
    if best is None:
        return sum_y / total + mean
    _, f, t = best
    go = x[:, f] <= t
    below = None if depth is None else depth - 1
    return f, t, *(brute_node(x[g], y[g], w[g], below, least, region_rows, edges, mean) for g in (go, ~go))


def brute_predict(tree, row):
    while isinstance(tree, tuple):
        f, t, left, right = tree
        tree = left if row[f] <= t else right
    return tree


def table(n=500, seed=3, k=3):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, k)), 1)          # many ties
    y = np.round(3 * x[:, 0] - 2 * np.abs(x[:, 1]) + r.normal(size=n)).astype(float) * 4
    return x, y


@pytest.mark.parametrize("depth,least", [(None, 1), (4, 1), (None, 7), (0, 1)])
def test_grow_equals_brute_force(depth, least):
    x, y = table()
    w = np.random.default_rng(5).poisson(1.0, len(y)).astype(float)
    nodes = forest.grow(x, y, w, depth, least)
    tree = brute_tree(x[w > 0], y[w > 0], w[w > 0], depth, least)
    got = nodes.value[nodes.leaf_of(x)]
    assert np.allclose(got, [brute_predict(tree, row) for row in x], atol=1e-9)


def predictions(model, df):
    return df.join(model.transform(df).select("k", "prediction"), "k").orderBy("k").toPandas()["prediction"].to_numpy()


@pytest.fixture(scope="module")
def data(spark):
    x, y = table()
    pdf = pd.DataFrame({"k": range(len(y)), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "row": "r", "part": 1})
    return x, y, frame(spark, pdf).coalesce(1)


def test_forest_without_sampling_is_the_brute_force_tree(data):
    x, y, df = data
    tree = brute_tree(x, y, np.ones(len(y)))
    want = [brute_predict(tree, row) for row in x]
    for trees in (1, 3):
        model = forest.train_forest(df, ["a", "b", "c"], "y", trees, bootstrap=False)
        assert np.allclose(predictions(model, df.repartition(3)), want, atol=1e-9)


def test_top_phase_equals_brute_force_on_its_thresholds(spark, data):
    x, y, df = data
    rows = df.selectExpr("a as x0", "b as x1", "c as x2")
    edges = forest._bin_edges(rows, 3, 16)
    tree = brute_tree(x, y, np.ones(len(y)), region_rows=60, edges=edges)
    model = forest.train_forest(df, ["a", "b", "c"], "y", 2, bootstrap=False, region_rows=60, bins=16)
    assert max(len(t.feature) for t in model.tops) > 10
    assert np.allclose(predictions(model, df), [brute_predict(tree, row) for row in x], atol=1e-9)


def test_bagged_forest_equals_trees_on_the_hashed_weights(data):
    x, y, df = data
    rows = np.arange(len(y))                        # one partition: row numbers in order
    for region_rows in (10 ** 6, 100):
        model = forest.train_forest(df, ["a", "b", "c"], "y", 5, region_rows=region_rows, seed=9)
        assert abs(sum(model.importances) - 1) < 1e-9
        if region_rows > len(y):
            trees = []
            for t in range(5):
                w = forest.sample_weights(rows, t, 9, True)
                trees.append(brute_tree(x[w > 0], y[w > 0], w[w > 0]))
            want = np.mean([[brute_predict(t, row) for row in x] for t in trees], axis=0)
            assert np.allclose(predictions(model, df), want, atol=1e-9)
        assert np.corrcoef(predictions(model, df), y)[0, 1] > 0.9
    w = forest.sample_weights(np.arange(100_000), 3, 1, True)
    assert abs(w.mean() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01


def test_model_roundtrip_nulls_and_importance(spark, data, tmp_path):
    _, _, df = data
    tm = train(df, ["a", "b", "c"], "y", "random_forest", num_trees=10)
    r2 = regression_metrics(tm.transform(df), "y", "prediction").first()["r2"]
    assert r2 > 0.85
    table_ = importance_table(tm).toPandas()
    assert table_.feature.tolist()[0] == "a" and abs(table_.importance.sum() - 1) < 1e-9
    save_model(tm, str(tmp_path / "forest"))
    back = load_model(str(tmp_path / "forest"))
    assert np.allclose(predictions(back, df), predictions(tm, df))
    odd = spark.createDataFrame([(1, None, 0.0, 1.0), (2, 0.1, 0.2, 0.3)], "k int, a double, b double, c double")
    got = {r.k: r.prediction for r in tm.transform(odd).collect()}
    assert got[1] is None and got[2] is not None
    with pytest.raises(ValueError):
        train(df.limit(0), ["a"], "y", "random_forest")


def test_scoring_moves_a_row_per_group_of_trees(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (4000, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=x[:, 0] * 2 + np.sin(3 * x[:, 1]), id=np.arange(4000))
    pdf.loc[::50, "b"] = np.nan
    df = frame(spark, pdf)
    model = forest.train_forest(df, ["a", "b", "c"], "y", 12, max_depth=6, region_rows=500, seed=3)
    assert all(len(t.feature) > 1 for t in model.tops)
    kind, moved = type(df), []
    plain = kind.repartitionById

    def counted(self, *args):
        moved.append(self.where("not is_node").count())
        return plain(self, *args)
    monkeypatch.setattr(kind, "repartitionById", counted)
    grouped = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    monkeypatch.setattr(forest, "HELD_BYTES", 0)        # no tree fits a task: rows go to regions
    by_region = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    assert moved[1] == 12 * 3920 and moved[0] <= moved[1] / 2
    assert len(grouped) == len(by_region) == 4000 and sum(v is None for v in grouped.values()) == 80
    assert all(v is by_region[k] or abs(v - by_region[k]) < 1e-12 for k, v in grouped.items())


def test_parts_of_a_tree_equal_brute_force(monkeypatch):
    x, y = table(n=900, seed=4)
    w = np.random.default_rng(6).poisson(1.0, len(y)).astype(float)
    tree = brute_tree(x[w > 0], y[w > 0], w[w > 0])
    for rows in (1, 40, 10 ** 6):
        monkeypatch.setattr(forest, "PART_ROWS", rows)
        nodes = forest.grow(x, y, w)
        assert (nodes.right[nodes.feature >= 0] == nodes.left[nodes.feature >= 0] + 1).all()
        for chunk in (7, 1 << 14):
            monkeypatch.setattr(forest, "CHUNK_ROWS", chunk)
            assert np.allclose(nodes.value[nodes.leaf_of(x)], [brute_predict(tree, row) for row in x], atol=1e-9)


def test_first_rows_are_scored_without_writing_trees(data):
    x, y, df = data
    model = forest.train_forest(df, ["a", "b", "c"], "y", 5, seed=9)
    first = predictions(model, df.repartition(3))
    assert not os.path.exists(model.path) and abs(sum(model.importances) - 1) < 1e-9
    shares = model.importances
    again = predictions(model, df)                  # trees that are asked for again are written
    assert os.path.exists(model.path) and np.allclose(first, again, atol=1e-9)
    assert np.allclose(model.importances, shares, atol=1e-12)
    alone = forest.train_forest(df, ["a", "b", "c"], "y", 5, seed=9)
    assert np.allclose(alone.importances, shares, atol=1e-12) and not os.path.exists(alone.path)


def test_rows_that_a_task_holds_are_split_exactly(data, monkeypatch):
    x, y, df = data
    monkeypatch.setattr(forest, "REGION_ROWS", 60)
    tree = brute_tree(x, y, np.ones(len(y)))
    model = forest.train_forest(df, ["a", "b", "c"], "y", 2, bootstrap=False, bins=4)
    assert np.allclose(predictions(model, df), [brute_predict(tree, row) for row in x], atol=1e-9)
    monkeypatch.setattr(forest, "HELD_CELLS", 900)      # too many for a task: tops and regions as before
    model = forest.train_forest(df, ["a", "b", "c"], "y", 2, bootstrap=False, bins=4)
    assert all(len(t.feature) > 1 for t in model.tops) and os.path.exists(model.path)


def test_a_bundle_of_trees_is_a_task_with_all_rows(spark, data):
    _, _, df = data
    model = forest.train_forest(df.repartition(4), ["a", "b", "c"], "y", 4)

    def use(bundle, trees, scored):
        yield forest._gain_batch(bundle, np.array([sum(len(nodes.feature) > 1 for _, nodes in trees())]))
    found = model.rows.grown(model.rows.blocks(spark), 4, 2, 3, use, "tree int, gains array<double>").collect()
    assert sorted((r["tree"], r["gains"][0]) for r in found) == [(0, 2.0), (1, 2.0)]
