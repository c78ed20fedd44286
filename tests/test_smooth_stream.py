import uuid

import numpy as np
import pandas as pd

from conftest import frame
from limnos.operators.smooth import kde_grid, loess_curve
from limnos.plans.models import train_gaussian
from limnos.streaming import score_stream, start_scoring


def test_kde_integrates_to_one(spark):
    rng = np.random.default_rng(0)
    df = frame(spark, pd.DataFrame({"v": rng.normal(size=2000)}))
    pts = kde_grid(df, "v", points=200, digits=None).orderBy("idx").toPandas()
    area = np.trapezoid(pts.density, pts.x)
    assert abs(area - 1.0) < 0.01


def test_loess_reproduces_low_degree_polynomials(spark):
    x = np.linspace(0, 10, 500)
    df = frame(spark, pd.DataFrame({"x": x, "y": 2 * x + 1, "z": 0.5 * x * x - x + 3}))
    out = loess_curve(df, "x", "y", points=11, degree=1).orderBy("idx").toPandas()
    assert np.allclose(out.fit, 2 * out.x + 1, atol=1e-6)
    assert (out.n_local > 0).all()
    quad = loess_curve(df, "x", "z", points=11).orderBy("idx").toPandas()  # default degree 2
    assert np.allclose(quad.fit, 0.5 * quad.x ** 2 - quad.x + 3, atol=1e-6)


def test_scoring_runs_on_a_stream(spark, tmp_path):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"chl": rng.uniform(0, 1, 200), "temp": rng.uniform(5, 25, 200)})
    pdf["do"] = 12 - 0.2 * pdf.temp + pdf.chl + rng.normal(0, 0.2, 200)
    gm = train_gaussian(frame(spark, pdf), ["chl", "temp"], "do", mean_kind="linear")
    src = tmp_path / "in"
    frame(spark, pdf[["chl", "temp"]]).write.parquet(str(src))
    stream = spark.readStream.schema("chl double, temp double").parquet(str(src))
    name = f"test-{uuid.uuid4().hex}"  # a stream name owns its checkpoint; a fresh one per run
    q = start_scoring(score_stream(gm, stream), str(tmp_path / "out"), name, trigger_once=True)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 200 and "DO_UpperCI" in got.columns


def test_loess_bandwidth_is_qth_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 10, 400)
    x[:50] = 5.0  # ties
    pdf = pd.DataFrame({"x": x, "y": rng.normal(size=400)})
    q_near = int(np.floor(400 * 0.75))
    exp = [np.sort(np.abs(x - g))[q_near - 1] for g in np.linspace(x.min(), x.max(), 9)]
    for small in (200_000, 0):  # driver fast path and grouped selection
        out = loess_curve(frame(spark, pdf), "x", "y", points=9, small_distinct=small).orderBy("idx").toPandas()
        assert np.allclose(out.bandwidth, exp)


def test_densities_per_group_are_those_of_each_group(spark):
    import numpy as np

    from limnos.operators.smooth import kde_by_group, kde_grid
    r = np.random.default_rng(3)
    rows = [(g, m, float(v)) for g, m, k in (("a", "x", 40), ("a", None, 25), (None, "x", 1)) for v in r.normal(size=k)] + [("b", "y", None)]
    df = spark.createDataFrame(rows, "target string, method string, v double")
    out = kde_by_group(df, ["target", "method"], "v", points=30, digits=None).collect()
    assert len(out) == 90
    for target, method in (("a", "x"), ("a", None), (None, "x")):
        part = df.where(df.target.eqNullSafe(target) & df.method.eqNullSafe(method))
        want = [(x.x, x.density) for x in kde_grid(part, "v", points=30, digits=None).orderBy("idx").collect()]
        got = sorted((x.x, x.density) for x in out if (x.target, x.method) == (target, method))
        assert np.allclose(got, sorted(want), rtol=1e-12)


def test_loess_standard_error_equals_the_smoother_matrix(spark):
    import numpy as np

    from limnos.operators.smooth import loess_curve
    r = np.random.default_rng(7)
    x = np.round(r.uniform(0, 10, 150), 1)
    y = np.sin(x) + r.normal(size=150) * 0.3
    out = loess_curve(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"), "x", "y",
                      points=25).orderBy("idx").toPandas()

    def row(g, h):
        w = np.clip(1 - (np.abs(x - g) / h) ** 3, 0, None) ** 3
        b = np.column_stack([np.ones(150), x - g, (x - g) ** 2])
        return np.linalg.solve(b.T @ (b * w[:, None]), (b * w[:, None]).T)[0]

    rows = [row(g, h) for g, h in zip(out.x, out.bandwidth)]
    assert np.allclose(out.fit, [l @ y for l in rows])
    lev = []
    for g, h in zip(out.x, out.bandwidth):
        w = np.clip(1 - (np.abs(x - g) / h) ** 3, 0, None) ** 3
        b = np.column_stack([np.ones(150), x - g, (x - g) ** 2])
        lev.append(np.linalg.inv(b.T @ (b * w[:, None]))[0, 0])
    trace = np.interp(x, out.x, lev).sum()
    sigma2 = ((y - np.interp(x, out.x, out.fit)) ** 2).sum() / (150 - trace)
    assert np.allclose(out.se, [np.sqrt(sigma2 * (l @ l)) for l in rows], rtol=1e-6)
    assert 0.2 < np.sqrt(sigma2) < 0.4
