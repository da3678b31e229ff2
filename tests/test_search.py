import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrel.operators import pipeline, search
from tests.test_spectral import nipals

R = np.random.default_rng(21)
X = R.normal(size=(90, 16)).cumsum(axis=1) * (1 + 0.3 * R.random((90, 1))) + 3
Y = X[:, 2] - X[:, 9] + 0.3 * R.normal(size=90)
FOLD = np.where(np.arange(90) < 70, np.arange(90) % 4, search.VALIDATION)
CANDIDATES = [(("snv", {}), ("mean_center", {})), (("msc", {}), ("autoscale", {})), (("sg_smooth", {"window": 5}), ("msc", {})), (("sg_smooth", {"window": 5}), ("mean_center", {}))]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, int(FOLD[i]), X[i].tolist(), float(Y[i])) for i in range(90)], "id long, fold int, x array<double>, y double")
    return df.repartition(3).persist()


def transformed(rows, steps, train, judge):
    fitted = pipeline.fit(rows.where(F.col("id").isin(np.flatnonzero(train).tolist())), steps)
    x = np.array([r["x"] for r in fitted.transform(rows).orderBy("id").collect()])
    return x[train], x[judge]


def explicit(rows, steps, k, train, judge):
    """A model of k components with all steps fitted on `train`, judged by other rows: rmse and r2."""
    a, b = transformed(rows, steps, train, judge)
    beta = nipals(a, Y[train], k)
    e = Y[judge] - Y[train].mean() - (b - a.mean(0)) @ beta
    return np.sqrt((e**2).mean()), 1 - (e**2).sum() / ((Y[judge] - Y[judge].mean()) ** 2).sum()


def test_scores_equal_a_loop_that_refits_every_fold(rows):
    found = search.nested(rows, "x", "y", CANDIDATES[1:3], most=4)
    cal = FOLD >= 0
    for steps, e in zip(CANDIDATES[1:3], found["evaluations"], strict=True):
        for k in (1, 3):
            each = [explicit(rows, steps, k, cal & (FOLD != f), FOLD == f) for f in range(4)]
            trial = next(t for t in e["trials"] if t[0] == k)
            assert np.allclose(trial[1:], np.mean(each, axis=0))
        assert np.allclose((e["val_rmse"], e["val_r2"]), explicit(rows, steps, e["parameters"], cal, ~cal))
        assert e["parameters"] == min(e["trials"], key=lambda t: t[1])[0]


def test_no_fit_sees_the_rows_it_is_judged_by(spark, rows):
    """Other spectra in one fold change nothing that is trained without that fold."""
    changed = rows.withColumn("x", F.when(F.col("fold") == 2, F.transform("x", lambda v: v * v + 7)).otherwise(F.col("x")))
    for a, b in zip(search.cross_products(rows, "x", "y", CANDIDATES), search.cross_products(changed, "x", "y", CANDIDATES), strict=True):
        for family in ("pls", "ridge", "lasso"):
            grid = {"pls": [3], "ridge": [1.0], "lasso": [(0.01, 1.0)]}[family]
            for x, y in zip(search._models(a[2][0], family, grid).values(), search._models(b[2][0], family, grid).values(), strict=True):
                assert np.allclose(x[0], y[0], rtol=1e-5, atol=1e-7)
        assert not np.allclose(search._models(a[1][0], "ridge", [1.0])[1.0][0], search._models(b[1][0], "ridge", [1.0])[1.0][0])


def test_winner_rules(rows):
    found = search.nested(rows, "x", "y", CANDIDATES, families=("pls", "ridge", "pcr"), most=6)
    least = min(e["cv_rmse"] for e in found["evaluations"])
    near = [i for i, e in enumerate(found["evaluations"]) if e["cv_rmse"] <= 1.01 * least]
    assert found["winner"] == min(near, key=lambda i: (search.simplicity(found["evaluations"][i]["steps"]), ("pls", "ridge", "pcr").index(found["evaluations"][i]["family"])))
    combined = search.nested(rows, "x", "y", CANDIDATES, most=6, rule="combined")
    assert combined["winner"] == int(np.argmax([0.7 * e["cv_r2"] + 0.3 * e["val_r2"] for e in combined["evaluations"]]))
    assert all(e["cv_r2"] == max(t[2] for t in e["trials"]) for e in combined["evaluations"])
    for wrong in ({"rule": "best"}, {"families": ("svm",)}):
        with pytest.raises(ValueError):
            search.nested(rows, "x", "y", CANDIDATES[:1], **wrong)


def test_folds_groups_manifest_and_leaks(spark, rows):
    df = rows.withColumn("batch", F.when(F.col("id") < 80, F.col("id") % 13))
    dealt = search.cv_folds(df.drop("fold"), "id", 5, "batch")
    assert dealt.where("batch IS NOT NULL").groupBy("batch").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
    assert dealt.where("batch IS NULL").select("fold").distinct().count() > 1
    a, b = search.fold_manifest(dealt, "id"), search.fold_manifest(dealt.repartition(7), "id")
    assert a == b and a["manifest_id"].startswith("cv_") and sum(f["n"] for f in a["folds"]) == 90
    assert search.fold_manifest(dealt.withColumn("fold", F.when(F.col("id") == 3, 9).otherwise(F.col("fold"))), "id")["manifest_id"] != a["manifest_id"]
    search.refuse_leaks(dealt, "x")
    with pytest.raises(ValueError, match="more than one fold"):
        search.refuse_leaks(dealt.union(dealt.limit(2).withColumn("fold", F.col("fold") + 1)), "x")
    with pytest.raises(ValueError):
        search.cross_products(rows.where("fold = 1"), "x", "y", CANDIDATES[:1])
