import numpy as np
import pytest

from spectrel.functions import matrices
from spectrel.operators import pipeline

X = np.random.default_rng(1).normal(size=(30, 20)).cumsum(axis=1)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, "train" if i < 20 else "test", [float(v) for v in x]) for i, x in enumerate(X)], "id long, role string, x array<double>")


def values(df):
    return np.array([r["x"] for r in df.orderBy("id").collect()])


def test_state_comes_from_training_rows_alone(rows):
    steps = (("sg_smooth", {"window": 5}), ("snv", {}), ("autoscale", {}))
    fitted = pipeline.fit(rows.where("role = 'train'"), steps)
    y = X @ matrices.savitzky_golay(20, 5, 2).T
    y = (y - y.mean(1, keepdims=True)) / y.std(1, keepdims=True)
    assert np.allclose(values(fitted.transform(rows)), (y - y[:20].mean(0)) / y[:20].std(0))
    seen = []
    assert np.allclose(values(fitted.transform(rows, on_step=lambda name, df: seen.append((name, df.count())))), values(fitted.transform(rows)))
    assert seen == [("sg_smooth", 30), ("snv", 30), ("autoscale", 30)]


def test_defaults_run_and_matrices_fuse(rows):
    for steps in pipeline.DEFAULTS:
        assert np.isfinite(values(pipeline.fit(rows.where("role = 'train'"), steps).transform(rows))).all()
    plan = pipeline.fit(rows, (("sg_smooth", {}), ("derivative1", {}), ("detrend", {}))).transform(rows)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("MapInArrow") == 1


def test_bad_pipelines():
    for steps in ((("nope", {}),), (("snv", {}), ("sg_smooth", {})), (("snv", {}), ("msc", {})), (("sg_smooth", {"window": 4}),), (("sg_smooth", {"size": 5}),), (("normalize", {"norm": "l3"}),), (("sg_smooth", {"window": 5.5}),)):
        with pytest.raises(ValueError):
            pipeline.checked(steps)
    assert pipeline.pipeline_id((("snv", {}),)) != pipeline.pipeline_id((("msc", {}),)) and len(pipeline.catalog_hash()) == 64


def test_catalog(spark):
    rows = pipeline.catalog(spark).collect()
    assert {r["method"] for r in rows} == set(pipeline.METHODS)
