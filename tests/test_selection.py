import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrel.operators import gram, selection, splits
from tests.test_spectral import nipals

R = np.random.default_rng(3)
X = R.normal(size=(150, 24)).cumsum(axis=1) + 5
Y = X[:, 4] - 2 * X[:, 17] + 0.05 * R.normal(size=150)


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, [float(v) for v in x], float(y)) for i, (x, y) in enumerate(zip(X, Y, strict=True))], "id long, x array<double>, y double")
    return splits.folds(df, "id", 10).withColumnRenamed("fold", "block").repartition(4).persist()


@pytest.fixture(scope="module")
def blocks(rows):
    return np.array([r["block"] for r in rows.orderBy("id").select("block").collect()])


@pytest.fixture(scope="module")
def by_block(rows):
    return gram.grams(rows, "x", ["y"], "block")


def explicit_error(blocks, names, positions, k):
    errors = []
    for f in range(5):
        held = np.isin(blocks, names[f::5])
        b = nipals(X[~held][:, positions], Y[~held], min(k, len(positions)))
        rest = Y[held] - Y[~held].mean() - (X[held][:, positions] - X[~held][:, positions].mean(0)) @ b
        errors.append(np.sqrt((rest**2).mean()))
    return np.mean(errors)


def test_cars_equals_a_loop_over_rows(by_block, blocks):
    names, random = sorted(by_block), np.random.default_rng(7)
    weights = np.abs(nipals(X, Y, 4))
    for _ in range(12):
        drawn = np.isin(blocks, [names[b] for b in random.choice(len(names), round(0.8 * len(names)), replace=False)])
        weights = weights + np.abs(nipals(X[drawn], Y[drawn], 4))
    best, error = list(range(24)), explicit_error(blocks, names, list(range(24)), 4)
    full = error
    chance = weights**2 + np.finfo(float).eps * max((weights**2).max(), 1)
    for i in range(12):
        kept = int(np.ceil(min(1, max(2 / 24, np.exp(np.log(2 / 24) * i / 11))) * 24))
        draw = sorted(random.choice(24, kept, replace=False, p=chance / chance.sum()).tolist())
        if (e := explicit_error(blocks, names, draw, 4)) < error:
            best, error = draw, e
    got = selection.cars(by_block, samples=12, seed=7, most=4)
    assert got["selected"] == best and {4, 17} <= set(best) and len(best) < 24
    assert np.allclose(got["weights"], weights, rtol=1e-5) and np.isclose(got["error"], error) and np.isclose(got["full_error"], full)
    with pytest.raises(ValueError):
        selection.cars(by_block, samples=1)


def explicit_order(start, most):
    unit, taken = X / np.linalg.norm(X, axis=0), [start]
    while len(taken) < most:
        q, _ = np.linalg.qr(unit[:, taken])
        left = np.linalg.norm(unit - q @ (q.T @ unit), axis=0)
        left[taken] = -1
        taken.append(int(left.argmax()))
    return taken


def test_projections_equal_raw_columns(rows):
    g = gram.grams(rows, "x", ["y"])[0]
    orders = selection.projections(g, 6)
    assert [o.tolist() for o in orders] == [explicit_order(s, 6) for s in range(24)]
    best = (np.inf, None)
    for s in range(24):
        for k in range(1, 7):
            held = sorted(orders[s, :k].tolist())
            a = np.hstack([X[:, held], np.ones((150, 1))])
            hat = a @ np.linalg.pinv(a)
            best = min(best, (np.sqrt((((Y - hat @ Y) / (1 - np.diag(hat))) ** 2).mean()), held), key=lambda b: b[0])
    got = selection.successive_projections(rows, "x", "y", g, most=6)
    assert got["selected"] == best[1] and np.isclose(got["error"], best[0])
    constant = gram.grams(rows.withColumn("x", F.array(F.lit(1.0), F.lit(2.0))), "x", ["y"])[0]
    assert selection.successive_projections(rows, "x", "y", constant)["selected"] == [0, 1]


@pytest.mark.parametrize("alpha,l1", [(0.5, 1.0), (0.05, 1.0), (0.3, 0.5), (0.001, 0.1), (100.0, 0.9)])
def test_elastic_net_is_optimal(rows, alpha, l1):
    g = gram.grams(rows, "x", ["y"])[0]
    w = selection.elastic_net(g, alpha, l1)
    z = (X - X.mean(0)) / X.std(0)
    slope = z.T @ (Y - Y.mean() - z @ w) / 150 - alpha * (1 - l1) * w
    assert np.allclose(slope[w != 0], alpha * l1 * np.sign(w[w != 0]), atol=1e-6)
    assert (np.abs(slope[w == 0]) <= alpha * l1 + 1e-6).all()
    assert np.allclose(w, selection.elastic_net(g, alpha, l1, np.ones(24)), atol=1e-5)
    if l1 == 1.0 and alpha == 0.5:
        assert 0 < (w != 0).sum() < 24


@pytest.mark.parametrize("kind", ["ridge", "lasso", "elastic_net"])
def test_penalty_by_folds(by_block, blocks, kind):
    got = selection.penalised(by_block, kind, alphas=(0.01, 1.0, 30.0), l1_ratios=(0.2, 0.8))
    for alpha, ratio, error in got["grid"]:
        each = []
        for f in by_block:
            train, z = blocks != f, (X - X[blocks != f].mean(0)) / X[blocks != f].std(0)
            if ratio is None:
                w = np.linalg.solve(z[train].T @ z[train] + alpha * np.eye(24), z[train].T @ (Y[train] - Y[train].mean()))
            else:
                w = selection.elastic_net(selection.summed(g for k, g in by_block.items() if k != f), alpha, ratio)
            each.append(((Y[~train] - Y[train].mean() - z[~train] @ w) ** 2).mean())
        assert np.isclose(error, np.mean(each), rtol=1e-6)
    assert got["alpha"] == min(got["grid"], key=lambda g: g[2])[0]
    assert np.abs(X @ got["coefficients"] + got["intercept"] - Y).mean() < 0.5
    with pytest.raises(ValueError):
        selection.penalised(by_block, "net")
