import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrel.functions import kernels, matrices
from spectrel.operators import gram, spectral

X = np.random.default_rng(0).normal(size=(40, 30)).cumsum(axis=1)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, [float(v) for v in x], float(x[3] - 2 * x[9] + 0.01 * i)) for i, x in enumerate(X)], "id long, x array<double>, y double").repartition(3)


def values(df, column="x"):
    return np.array([r[column] for r in df.orderBy("id").collect()])


def test_native_kernels(rows):
    got = values(rows.withColumn("x", kernels.snv(F.col("x"))))
    assert np.allclose(got, (X - X.mean(1, keepdims=True)) / X.std(1, keepdims=True))
    med = np.median(X, axis=1, keepdims=True)
    mad = 1.4826 * np.median(np.abs(X - med), axis=1, keepdims=True)
    assert np.allclose(values(rows.withColumn("x", kernels.robust_snv(F.col("x")))), (X - med) / mad)
    padded = np.pad(X, ((0, 0), (2, 2)), mode="edge")
    local = np.median(np.lib.stride_tricks.sliding_window_view(padded, 5, axis=1), axis=2)
    assert np.allclose(values(rows.withColumn("x", kernels.moving_median(F.col("x"), 5))), local)
    spiked = X.copy()
    spiked[:, 15] += 500
    r = spiked - np.median(np.lib.stride_tricks.sliding_window_view(np.pad(spiked, ((0, 0), (2, 2)), mode="edge"), 5, axis=1), axis=2)
    df = rows.withColumn("x", F.transform("x", lambda v, i: v + F.when(i == 15, 500.0).otherwise(0.0)))
    repaired = values(df.withColumn("x", kernels.despike(F.col("x"))))
    assert np.allclose(repaired[:, 15], spiked[:, 15] - r[:, 15]) and np.abs(repaired).max() < 100


def test_edge_rows(spark):
    df = spark.createDataFrame([(0, [2.0] * 6), (1, [0.0] * 6), (2, None)], "id long, x array<double>")
    for f in (kernels.snv, kernels.robust_snv, kernels.normalize):
        got = {r["id"]: r["x"] for r in df.withColumn("x", f(F.col("x"))).collect()}
        assert got[1] == [0.0] * 6 and got[2] is None and (f is kernels.normalize or got[0] == [0.0] * 6)
    axes = {"ascending": [1.0, 2.0], "descending": [2.0, 1.0], "duplicate_values": [1.0, 1.0, 2.0], "non_monotonic": [1.0, 3.0, 2.0], "single_point": [1.0], "missing": [], "invalid": [1.0, float("nan")]}
    df = spark.createDataFrame(list(axes.items()), "want string, a array<double>")
    assert all(r["want"] == r["got"] for r in df.select("want", kernels.axis_direction(F.col("a")).alias("got")).collect())


def test_matrices(rows):
    t = np.arange(30.0)
    for order in (2, 3):
        curve = 3 + 2 * t - 0.5 * t**2
        assert np.allclose(matrices.savitzky_golay(30, 7, order) @ curve, curve)
        assert np.allclose(matrices.savitzky_golay(30, 7, order, 1) @ curve, 2 - t)
        assert np.allclose(matrices.savitzky_golay(30, 7, order, 2) @ curve, -1)
    assert np.allclose(matrices.detrend(t) @ (1 + t + t**2), 0, atol=1e-8)
    assert np.allclose(matrices.linear_resample(t[::-1], np.array([0.5, 29.0])) @ t[::-1] ** 1, [0.5, 29.0])
    with pytest.raises(ValueError, match="beyond"):
        matrices.linear_resample(t, np.array([29.5]))
    steps = [matrices.savitzky_golay(30, 7, 2), matrices.whittaker(30, 5.0)]
    assert np.allclose(values(spectral.linear(rows, "x", steps)), X @ steps[0].T @ steps[1].T)


def test_baselines(rows):
    flat = np.tile(np.linspace(0, 5, 30), (4, 1))
    peak = flat + np.exp(-((np.arange(30) - 15) ** 2) / 4.0)
    for f in (spectral.asls, lambda x: spectral.airpls(x, 1e3, 2), spectral.arpls):
        out = f(peak)
        assert np.allclose(out[0], f(peak)[3]) and out[0].argmax() == 15 and abs(out[0][3]) < 0.2
    assert (spectral.rubberband(X) >= -1e-9).all() and np.allclose(spectral.rubberband(flat), 0)
    reference = 1 + np.sin(np.arange(30) / 5.0)
    df = spectral.emsc(rows.withColumn("x", F.transform(F.lit([float(v) for v in reference]), lambda v, i: 2 * v + 3 + 0.1 * i)), "x", reference, np.arange(30.0))
    assert np.allclose(values(df), reference)
    assert values(spectral.transposed(rows.select("id", "x").withColumnRenamed("id", "s"), "s", "x").withColumnRenamed("pos", "id")).shape == (30, 40)


def nipals(x, y, k):
    x, y = x - x.mean(0), y - y.mean()
    w_, p_, q_ = [], [], []
    for _ in range(k):
        w = x.T @ y
        w /= np.linalg.norm(w)
        t = x @ w
        p, q = x.T @ t / (t @ t), y @ t / (t @ t)
        x, y = x - np.outer(t, p), y - q * t
        w_.append(w), p_.append(p), q_.append(q)
    w, p, q = np.array(w_).T, np.array(p_).T, np.array(q_)
    return w @ np.linalg.solve(p.T @ w, q)


def test_regression_from_cross_products(rows):
    y = np.array([r["y"] for r in rows.orderBy("id").collect()])
    g = gram.grams(rows, "x", ["y"])[0]
    model = gram.pls(g, 6)
    for k in (1, 3, 6):
        assert np.allclose(model["coefficients"][k - 1], nipals(X, y, k), atol=1e-8)
    c, yc = X - X.mean(0), y - y.mean()
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    t = c @ vt[:4].T
    assert np.allclose(gram.pcr(g, 4)[0], vt[:4].T @ np.linalg.lstsq(t, yc, rcond=None)[0], atol=1e-8)
    s = X.std(0)
    assert np.allclose(gram.ridge(g, 2.0)[0], np.linalg.solve((c / s).T @ (c / s) + 2 * np.eye(30), (c / s).T @ yc) / s, atol=1e-8)
    folded = rows.withColumn("fold", (F.col("id") % 4).cast("int"))
    curve = gram.cross_validated(gram.grams(folded, "x", ["y"], "fold"), 3)
    want = []
    for f in range(4):
        held = np.arange(40) % 4 == f
        b = nipals(X[~held], y[~held], 3)
        e = (X[held] - X[~held].mean(0)) @ b + y[~held].mean() - y[held]
        want.append(np.sqrt((e**2).mean()))
    assert np.isclose(curve[2]["rmsecv"], np.mean(want))
    assert np.isclose((gram.vip(model) ** 2).mean(), 1)


def test_monitoring(rows):
    reference = gram.monitoring_reference(rows, "x", 0.95)
    c = X - X.mean(0)
    _, sv, vt = np.linalg.svd(c, full_matrices=False)
    k = int(np.searchsorted(np.cumsum(sv**2) / (sv**2).sum(), 0.95) + 1)
    t = c @ vt[:k].T
    t2 = (t**2 / (sv[:k] ** 2 / 39)).sum(1)
    q = ((c - t @ vt[:k]) ** 2).sum(1)
    assert np.isclose(reference["t2_limit"], np.quantile(t2, 0.99)) and np.isclose(reference["q_limit"], np.quantile(q, 0.99))
    got = gram.drift(rows, "x", reference).orderBy("id").collect()
    assert np.allclose([r["t2"] for r in got], t2) and [r["flagged"] for r in got] == [bool(a or b) for a, b in zip(t2 > np.quantile(t2, 0.99) + 1e-9, q > np.quantile(q, 0.99) + 1e-9)]
    d = [r["distance"] for r in gram.mahalanobis(rows, "x", gram.grams(rows, "x")[0]).orderBy("id").collect()]
    assert np.allclose(d, np.sqrt(np.einsum("ij,jk,ik->i", c, np.linalg.pinv(np.cov(X, rowvar=False)), c)))


def test_transposed_in_blocks(spark):
    rows = spark.createDataFrame([(k, [float(k), float(100 * k)]) for k in range(25)], "s long, x array<double>").repartition(3)
    got = {(r["pos"], r["block"]): r["x"] for r in spectral.transposed(rows, "s", "x", 10).collect()}
    assert got == {(p, b): [float(k * (100 if p else 1)) for k in range(10 * b, min(25, 10 * b + 10))] for p in (0, 1) for b in range(3)}


def test_baselines_build_few_matrices_at_once():
    import tracemalloc

    x = np.abs(np.random.default_rng(2).normal(size=(4000, 64))) + 1
    w, penalty = np.random.default_rng(3).random((4000, 64)), spectral._penalty(64, 1e7, 1)
    want = np.array([np.linalg.solve(np.diag(w[k]) + penalty, w[k] * x[k]) for k in range(0, 4000, 97)])
    tracemalloc.start()
    got = spectral._baselines(x, w, penalty)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got[::97], want, rtol=1e-9, atol=0) and peak < 50e6  # all matrices at once: 131 MB and more
    assert spectral._baselines(x[:0], w[:0], penalty).shape == (0, 64)
