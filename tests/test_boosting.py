"""Second-order boosting: trees against ones grown a split at a time, scoring, subsamples, grids and persistence."""

import numpy as np
import pandas as pd
import pytest
from conftest import frame

from limnos.plans import boosting
from limnos.plans.models import importance_table, load_model, save_model, train
from limnos.plans.tuning import grid_search


def brute_boost(x, y, w_of, rounds, step, max_leaves, max_depth, l2, least=1.0):
    """Predictions of trees grown one best split at a time over all values."""
    base, score = y.mean(), np.full(len(y), y.mean())
    for number in range(rounds):
        g, w = score - y, w_of(number)
        leaves = [(np.ones(len(y), bool), 0)]

        def best(leaf):
            rows, depth = leaf
            top = (0.0, None)
            if max_depth is not None and depth >= max_depth:
                return top
            gs, hs = (g * w)[rows].sum(), w[rows].sum()
            for f in range(x.shape[1]):
                for t in np.unique(x[:, f])[:-1]:
                    go = rows & (x[:, f] <= t)
                    gl, hl = (g * w)[go].sum(), w[go].sum()
                    if hl < least or hs - hl < least:
                        continue
                    gain = gl ** 2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs ** 2 / (hs + l2)
                    if gain > top[0] * (1 + 1e-10) + 1e-300:
                        top = gain, (f, t)
            return top
        while max_leaves is None or len(leaves) < max_leaves:
            found = [best(leaf) for leaf in leaves]
            i = int(np.argmax([f[0] for f in found]))
            if found[i][1] is None:
                break
            f, t = found[i][1]
            rows, depth = leaves.pop(i)
            leaves += [(rows & (x[:, f] <= t), depth + 1), (rows & (x[:, f] > t), depth + 1)]
        for rows, _ in leaves:
            score[rows] += -step * (g * w)[rows].sum() / (w[rows].sum() + l2)
    return base, score


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 40, 600), rng.integers(0, 30, 600), rng.integers(0, 5, 600)], axis=1).astype(float)
    y = np.sin(x[:, 0] / 6) * 3 + (x[:, 1] > 11) * x[:, 2] + rng.normal(0, 0.2, 600)
    pdf = pd.DataFrame(x, columns=["a", "b c", "d"]).assign(y=y, k=np.arange(600))
    return frame(spark, pdf).cache(), x, y


@pytest.mark.parametrize("leaves,depth", [(9, None), (None, 3)])
def test_trees_equal_one_split_at_a_time(data, leaves, depth):
    df, x, y = data
    tm = boosting.train_boosted(df, ["a", "b c", "d"], "y", rounds=3, step=0.3, max_depth=depth, max_leaves=leaves, refresh=2)
    _, want = brute_boost(x, y, lambda n: np.ones(len(y)), 3, 0.3, leaves, depth, 1.0)
    got = tm.transform(df).orderBy("k").toPandas()["prediction"].to_numpy()
    assert np.allclose(got, want, atol=1e-9)
    assert all(sum(f < 0 for f in t.feature) <= (leaves or 8) for t in tm.trees)


def test_passes_are_levels_not_splits():
    rng = np.random.default_rng(0)
    x = rng.random((1, 5000))
    y = np.sin(20 * x[0])
    codes = (x * 255).astype(np.uint8)
    calls = []

    def best(tree, nodes):
        calls.append(len(nodes))
        at, out = tree.leaf_of(codes), {}
        for node in nodes:
            rows = at == node
            cells = np.stack([np.bincount(codes[0][rows], -y[rows], 256), np.bincount(codes[0][rows], minlength=256)])[:, None]
            out[node] = boosting.best_split(cells, 1.0, 1.0)
        return out
    tree = boosting.grow_tree(best, 32, None, 0.0, 1.0, 0.1)
    assert sum(f < 0 for f in tree.feature) == 32 and len(calls) <= 12


def test_few_edges_subsample_and_null(spark, data):
    df, x, y = data
    tm = train(df, ["a", "b c", "d"], "y", "boosted", max_iter=2, max_leaves=4, subsampling=0.6)
    again = train(df, ["a", "b c", "d"], "y", "boosted", max_iter=2, max_leaves=4, subsampling=0.6)
    assert [t.feature for t in tm.model.trees] == [t.feature for t in again.model.trees]
    assert 200 < tm.model.trees[0].rows[0] < 520 and tm.model.trees[0].rows[0] != tm.model.trees[1].rows[0]
    odd = frame(spark, pd.DataFrame({"a": [1.0, None], "b c": [2.0, 3.0], "d": [1.0, 1.0]}))
    assert [r["prediction"] is None for r in tm.transform(odd).orderBy("b c").collect()] == [False, True]
    flat = frame(spark, pd.DataFrame({"a": [1.0, 1.0], "y": [2.0, 4.0]}))
    assert train(flat, ["a"], "y", "boosted", max_iter=2).model.trees[0].feature == [-1]
    with pytest.raises(ValueError):
        train(flat.where("a > 9"), ["a"], "y", "boosted")


def test_many_bins_take_two_bytes(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.permutation(1000).astype(float)}).assign(y=lambda d: (d["a"] > 777) * 1.0)
    tm = boosting.train_boosted(frame(spark, pdf), ["a"], "y", rounds=1, step=1.0, max_leaves=2, bins=1500, l2=0.0)
    assert tm.splits(spark).first()["threshold"] == 777.0
    assert tm.transform(frame(spark, pdf)).where("abs(prediction - y) > 1e-9").count() == 0


def test_round_trip_importances_and_grid(spark, data, tmp_path):
    df, _, _ = data
    tm = train(df, ["a", "b c", "d"], "y", "boosted", max_iter=2, max_leaves=4)
    save_model(tm, str(tmp_path / "m"))
    back = load_model(str(tmp_path / "m"))
    assert back.transform(df).select("prediction").exceptAll(tm.transform(df).select("prediction")).count() == 0
    shares = {r["feature"]: r["importance"] for r in importance_table(tm).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["a"] > shares["d"]
    found = grid_search(df, ["a", "b c", "d"], "y", "k", "boosted", {"max_iter": [1, 2], "max_leaves": [3]}, k=2).collect()
    alone = grid_search(df, ["a", "b c", "d"], "y", "k", "boosted", {"max_iter": [2], "max_leaves": [3]}, k=2).first()
    assert len(found) == 2 and found[0]["params"] == alone["params"] and found[0]["mean_mse"] == alone["mean_mse"]


def test_bins_of_several_values_are_split_where_the_gain_is_best(spark):
    rng = np.random.default_rng(11)
    x = np.stack([rng.random(3000), np.round(rng.normal(0, 5, 3000), 1), rng.integers(0, 4, 3000)], axis=1)
    x[:5, 1] = 1e6                                  # a rare value beyond the last quantile
    y = 2.0 * (x[:, 0] > 0.30007) + (x[:, 1] > 2.25) * x[:, 2] + 9.0 * (x[:, 1] > 900) + rng.normal(0, 0.3, 3000)
    df = frame(spark, pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, k=np.arange(3000))).repartition(5).cache()
    for leaves, depth in ((6, None), (None, 2)):
        model = boosting.train_boosted(df, ["a", "b", "c"], "y", rounds=3, step=0.3, max_depth=depth, max_leaves=leaves, bins=8,
                                       refresh=2)
        _, want = brute_boost(x, y, lambda n: np.ones(len(y)), 3, 0.3, leaves, depth, 1.0)
        got = model.transform(df).orderBy("k").toPandas()["prediction"].to_numpy()
        assert np.allclose(got, want, atol=1e-9)
        assert any(not np.isnan(c) for t in model.trees for c in t.cut)
    cuts = {r["threshold"] for r in model.splits(spark).where("feature = 'a'").collect()}
    assert cuts <= set(x[:, 0])


def test_few_values_per_bin_need_no_second_pass(spark, data, monkeypatch):
    df, _, _ = data
    monkeypatch.setattr(boosting, "_inside", None)
    model = boosting.train_boosted(df, ["a", "b c", "d"], "y", rounds=1, max_depth=3)
    assert all(np.isnan(c) for c in model.trees[0].cut) and len(model.trees[0].feature) > 3
