"""kNN over many features: pivot cells against all pairs."""

import numpy as np
import pandas as pd
import pytest
from conftest import frame

from limnos.operators import neighbors
from limnos.operators.neighbors import knn_pivots, knn_regress


def brute(train, query, feats, k):
    out = {}
    for _, r in query.iterrows():
        d = np.sqrt(((train[feats].to_numpy() - r[feats].to_numpy(float)) ** 2).sum(axis=1))
        order = sorted(range(len(d)), key=lambda i: (round(d[i], 12), train["id"].iloc[i]))[:k]
        near, y = d[order], train["y"].to_numpy()[order]
        p = y[near == 0].mean() if (near == 0).any() else (y / near).sum() / (1 / near).sum()
        out[int(r["id"])] = (p, len(order), near.max())
    return out


@pytest.mark.parametrize("dims,slice_rows", [(10, 4096), (6, 7)])
def test_pivots_match_all_pairs(spark, monkeypatch, dims, slice_rows):
    monkeypatch.setattr(neighbors, "SLICE", slice_rows)
    rng = np.random.default_rng(dims)
    feats = [f"f{i}" for i in range(dims)]
    centre = rng.normal(0, 6, (12, dims))
    x = centre[rng.integers(0, 12, 500)] + rng.normal(0, 0.5, (500, dims))
    x[:60] = x[0]                                     # a hot vector
    x[60:120] = np.round(x[60:120])
    train = pd.DataFrame(x, columns=feats).assign(y=rng.normal(0, 1, 500), id=np.arange(500))
    query = pd.DataFrame(np.vstack([x[:5], centre + 0.1, rng.normal(0, 20, (20, dims))]), columns=feats)
    query["id"] = np.arange(len(query))
    got = knn_pivots(frame(spark, train), frame(spark, query), "id", feats, "y", 9).toPandas()
    want = brute(train, query, feats, 9)
    assert sorted(got["id"]) == sorted(want)
    for r in got.itertuples():
        p, n, d = want[r.id]
        assert r.n_neighbors == n and abs(r.kth_distance - d) < 1e-9 and abs(r.prediction - p) < 1e-9
    assert got["n_candidates"].min() >= 1 and got.loc[got["id"].between(5, 16), "n_candidates"].mean() < 150


def test_few_rows_none_and_repeated_keys(spark):
    feats = list("abcde")
    train = frame(spark, pd.DataFrame([[1.0] * 5, [2.0] * 5], columns=feats).assign(y=[1.0, 3.0], id=[1, 2]))
    query = frame(spark, pd.DataFrame([[1.0] * 5, [1.5] * 5, [1.5] * 5], columns=feats).assign(id=[7, 8, 8]))
    rows = knn_regress(train, query, "id", feats, "y", 4).orderBy("id").collect()
    assert [(r["id"], round(r["prediction"], 9), r["n_neighbors"]) for r in rows] == [(7, 1.0, 2), (8, 2.0, 2), (8, 2.0, 2)]
    empty = knn_pivots(train.where("id > 9"), query, "id", feats, "y", 4).collect()
    assert len(empty) == 3 and all(r["prediction"] is None and r["n_neighbors"] == 0 for r in empty)


@pytest.mark.parametrize("dims", [3, 8])
def test_what_is_written_follows_queries_not_pairs(spark, monkeypatch, dims):
    rng = np.random.default_rng(dims)
    feats, sizes = [f"f{i}" for i in range(dims)], []
    plain = neighbors.written

    def counted(df):
        out = plain(df)
        sizes.append(out.count())
        return out
    monkeypatch.setattr(neighbors, "written", counted)
    monkeypatch.setattr(neighbors, "FRAGMENT", 300)
    x = rng.normal(0, 1, (1200, dims))
    train = pd.DataFrame(x, columns=feats).assign(y=rng.normal(0, 1, 1200), id=np.arange(1200))
    query = pd.DataFrame(rng.normal(0, 1, (100, dims)), columns=feats).assign(id=np.arange(100))
    query.loc[3, "f0"] = None                         # finds nothing and hides nothing
    got = knn_regress(frame(spark, train), frame(spark, query), "id", feats, "y", 5).toPandas()
    want = brute(train, query.drop(index=3), feats, 5)
    assert sorted(got["id"]) == sorted(want)
    assert max(abs(r.prediction - want[r.id][0]) for r in got.itertuples()) < 1e-9
    # vectors, queries, and per query and fragment at most k found and a count
    assert max(sizes) <= max(1200, 100 * 4 * (5 + 1))


def test_fragments_are_copied_for_queries_not_for_small_tasks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    feats, moved = ["a", "b", "c"], []
    train = spark.createDataFrame(pd.DataFrame(rng.normal(0, 1, (6000, 3)), columns=feats).assign(y=0.5, id=np.arange(6000)))
    query = spark.createDataFrame(pd.DataFrame(rng.normal(0, 1, (24000, 3)), columns=feats).assign(id=np.arange(24000)))
    kind = type(train)
    plain = kind.repartitionById

    def counted(df, *args):
        moved.append(df.where("not asks").count())
        return plain(df, *args)
    monkeypatch.setattr(kind, "repartitionById", counted)
    assert knn_regress(train, query, "id", feats, "y", 5).where("abs(prediction - 0.5) < 1e-9").count() == 24000
    # a copy for each task, or as many as there are queries to a vector
    assert len(moved) == 2 and max(moved) <= 6000 * max(4, spark.sparkContext.defaultParallelism)
