import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrel.operators import classes, trees

R = np.random.default_rng(8)
N, P = 180, 12
LABEL = R.choice(["a", "b", "c"], size=N, p=[0.6, 0.25, 0.15])
MEANS = {k: R.normal(size=P) * 1.2 for k in "abc"}
X = np.array([MEANS[k] for k in LABEL]) + R.normal(size=(N, P))
HOT = np.array([[k == c for c in "abc"] for k in LABEL], dtype=float)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, str(LABEL[i]), X[i].tolist()) for i in range(N)], "id long, label string, x array<double>").repartition(3).persist()


def pls2(x, y, k):
    """Components one after another on the rows themselves."""
    xm, ym = x.mean(0), y.mean(0)
    x, y, w_, p_, q_ = x - xm, y - ym, [], [], []
    for _ in range(k):
        w = np.linalg.svd(x.T @ y, full_matrices=False)[0][:, 0]
        t = x @ w
        p, q = x.T @ t / (t @ t), y.T @ t / (t @ t)
        x, y = x - np.outer(t, p), y - np.outer(t, q)
        w_.append(w), p_.append(p), q_.append(q)
    w, p, q = np.array(w_).T, np.array(p_).T, np.array(q_)
    b = w @ np.linalg.solve(p.T @ w, q)
    return b, ym - xm @ b


def balanced(truth, called):
    return np.mean([(called[truth == k] == k).mean() for k in np.unique(truth)])


def test_indicators_equal_a_loop_over_rows(rows):
    for k in (1, 2, 4):
        b, a = pls2(X, HOT, k)
        model = classes.pls_da(rows, "x", "label", k)
        got = {r["id"]: r for r in model.predict(rows, "x").collect()}
        scores = X @ b + a
        assert all(got[i]["predicted"] == "abc"[scores[i].argmax()] for i in range(N))
        e = np.exp(scores - scores.max(1, keepdims=True))
        assert np.allclose([got[i]["probabilities"] for i in range(N)], e / e.sum(1, keepdims=True))


def test_stratified_folds_and_components(rows):
    dealt = classes.stratified_folds(rows, "id", "label", 4)
    sizes = {(r["label"], r["fold"]): r["count"] for r in dealt.groupBy("label", "fold").count().collect()}
    assert all(max(n) - min(n) <= 1 for k in "abc" if (n := [sizes[k, f] for f in range(4)]))
    fold = np.array([r["fold"] for r in dealt.orderBy("id").collect()])
    best, means = classes.choose_components(dealt, "x", "label", ["a", "b", "c"], 5)
    want = []
    for k in range(1, 6):
        each = []
        for f in range(4):
            b, a = pls2(X[fold != f], HOT[fold != f], k)
            each.append(balanced(LABEL[fold == f], np.array(list("abc"))[(X[fold == f] @ b + a).argmax(1)]))
        want.append(np.mean(each))
    assert np.allclose([m for _, m in means], want) and best == int(np.argmax(want)) + 1


def test_logistic_has_no_slope_left(rows):
    model = classes.logistic(rows, "x", "label").model
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    scores = X @ w.T + b
    e = np.exp(scores - scores.max(1, keepdims=True))
    share = np.array([N / (3 * (k == LABEL).sum()) for k in "abc"])
    rest = (e / e.sum(1, keepdims=True) - HOT) * (HOT @ share)[:, None]
    assert np.abs(rest.T @ X + w).max() < 1e-3 * N and np.abs(rest.sum(0)).max() < 1e-3 * N


def test_choice_of_a_family(spark, rows):
    calibration, tuning = rows.where("id < 120"), rows.where("id >= 120")
    found = classes.choose_family(calibration, tuning, "x", "label", "id", most=4, steps=15)
    assert [c["family"] for c in found["candidates"]] == list(classes.FAMILIES)
    best = max(found["candidates"], key=lambda c: (c["balanced_accuracy"], c["macro_f1"], c["mcc"]))
    assert found["family"] == best["family"] and best["balanced_accuracy"] > 0.7
    called = {r["id"]: r["predicted"] for r in found["model"].predict(tuning, "x").collect()}
    assert np.isclose(balanced(LABEL[120:], np.array([called[i] for i in range(120, N)])), best["balanced_accuracy"])
    for wrong in ({"families": ()}, {"families": ("rbf",)}):
        with pytest.raises(ValueError):
            classes.choose_family(calibration, tuning, "x", "label", "id", **wrong)
    with pytest.raises(ValueError):
        classes.class_names(rows.where("label = 'a'"), "label")


def test_trees(spark):
    y = np.where(X[:, 3] > 0, 2.0, 0.0) + np.where(X[:, 7] > 1, 1.0, 0.0) + 0.05 * R.normal(size=N)
    df = spark.createDataFrame([(i, i % 3, X[i].tolist(), float(y[i])) for i in range(N)], "id long, fold int, x array<double>, y double").persist()
    for family, grid in (("forest", [{"trees": 4, "depth": 1}, {"trees": 8, "depth": 5}]), ("boosted", [{"trees": 1, "rate": 0.1, "depth": 2}, {"trees": 6, "rate": 0.5, "depth": 2}])):
        found = trees.chosen(df, "x", "y", family, grid=grid)
        assert found["parameters"] == min(found["grid"], key=lambda g: g[1])[0] and found["rmse"] < 0.95 * y.std()  # better than the mean
        importance = found["trees"].importance()
        assert len(importance) == P and int(np.argmax(importance)) == 3
        again = found["trees"].predict(df, "x")
        assert again.columns == [*df.columns, "prediction"] and again.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.6
    # one tree of one split is the split that brute force finds, at one of the bins' borders
    stump = trees.grown(df, "x", "y", "boosted", {"trees": 1, "rate": 1.0, "depth": 1})
    called = np.array([r["prediction"] for r in stump.predict(df, "x").orderBy("id").collect()])
    best = min(((y - np.where(X[:, j] <= c, y[X[:, j] <= c].mean(), y[X[:, j] > c].mean())) ** 2).sum() for j in range(P) for c in np.sort(X[:, j])[:-1])
    assert best <= ((y - called) ** 2).sum() <= 1.5 * best and len(np.unique(called)) == 2
    with pytest.raises(ValueError):
        trees.chosen(df, "x", "y", "extra")
