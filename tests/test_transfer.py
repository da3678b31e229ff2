import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrel.functions import matrices
from spectrel.operators import splits, transfer
from tests.test_spectral import nipals

R = np.random.default_rng(11)
SOURCE = R.normal(size=(60, 20)).cumsum(axis=1) + 10
TARGET = 1.1 * SOURCE + 0.2 * np.roll(SOURCE, 1, axis=1) + 0.03 * R.normal(size=SOURCE.shape) + np.linspace(0, 1, 20)
AXIS = [1000.0 + 10 * k for k in range(20)]


def frame(spark, x, ids=None):
    ids = [f"s{i}" for i in range(len(x))] if ids is None else ids
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "id string, x array<double>")


@pytest.fixture(scope="module")
def pairs(spark):
    return transfer.paired(frame(spark, SOURCE), frame(spark, TARGET[::-1], [f" s{i} " for i in range(60)][::-1]), "id", "x").persist()


def test_pairs_and_refusals(spark, pairs):
    rows = {r["id"]: r for r in pairs.collect()}
    assert len(rows) == 60 and all(np.allclose(rows[f"s{i}"]["target"], TARGET[i]) and np.allclose(rows[f"s{i}"]["source"], SOURCE[i]) for i in range(60))
    for ids, what in (([None, "a"], "without"), (["a", "a"], "twice"), (["a", "b"], "missing")):
        with pytest.raises(ValueError, match=what):
            transfer.paired(frame(spark, SOURCE[:2], ids), frame(spark, TARGET[:2], ["a", "c"]), "id", "x")
    roles = [r["role"] for r in transfer.pair_roles(pairs).collect()]
    assert sorted(roles) == ["train"] * 45 + ["validation"] * 15
    with pytest.raises(ValueError):
        transfer.pair_roles(pairs.limit(7))


def fitted(pairs, method, **parameters):
    t = transfer.Transfer(method, "lab", "field", AXIS, AXIS, parameters).fit(pairs)
    return t, np.array([r["x"] for r in t.transform(pairs.withColumnRenamed("target", "x"), "x", AXIS, "field").orderBy(F.regexp_replace("id", "s", "").cast("int")).collect()])


@pytest.mark.parametrize("scale", [True, False])
def test_piecewise_equals_local_regressions(pairs, scale):
    _, got = fitted(pairs, "piecewise", half_window=3, components=2, scale=scale)
    want = np.zeros_like(SOURCE)
    for i in range(20):
        w = slice(max(0, i - 3), i + 4)
        x, y = TARGET[:, w], SOURCE[:, i]
        sx, sy = (x.std(0, ddof=1), y.std(ddof=1)) if scale else (np.ones(x.shape[1]), 1.0)
        b = nipals(x / sx, y / sy, 2) * sy / sx
        want[:, i] = y.mean() + (x - x.mean(0)) @ b
    assert np.allclose(got, want, atol=1e-6)


@pytest.mark.parametrize("with_mean,with_std", [(True, False), (True, True), (False, False)])
def test_joint_space_equals_singular_vectors(pairs, with_mean, with_std):
    _, got = fitted(pairs, "joint_space", components=3, with_mean=with_mean, with_std=with_std)
    mt, ms = (TARGET.mean(0), SOURCE.mean(0)) if with_mean else (np.zeros(20), np.zeros(20))
    st, ss = (TARGET.std(0, ddof=1), SOURCE.std(0, ddof=1)) if with_std else (np.ones(20), np.ones(20))
    z = (TARGET - mt) / st
    _, _, v = np.linalg.svd(np.hstack([z, (SOURCE - ms) / ss]), full_matrices=False)
    own, other = v[:3, :20], v[:3, 20:]
    assert np.allclose(got, (z + z @ np.linalg.pinv(own) @ (other - own)) * ss + ms, atol=1e-6)


def test_transfers_bring_spectra_together(spark, pairs):
    for method, parameters in (("global", {"ridge_share": 1e-6}), ("piecewise", {"half_window": 2}), ("joint_space", {"components": 5})):
        _, got = fitted(pairs, method, **parameters)
        assert np.abs(got - SOURCE).mean() < 0.2 * np.abs(TARGET - SOURCE).mean()


def test_state_is_kept_and_bound(spark, pairs, tmp_path):
    t, got = fitted(pairs, "piecewise")
    t.save(spark, f"{tmp_path}/t")
    again = transfer.Transfer.load(spark, f"{tmp_path}/t")
    assert again.manifest() == t.manifest() and t.manifest()["direction"] == "field_to_lab" and t.manifest()["n_pairs"] == 60
    assert t.pairs_digest == transfer.Transfer("global", "a", "b", AXIS, AXIS).fit(pairs.repartition(5)).pairs_digest
    assert t.pairs_digest != transfer.Transfer("global", "a", "b", AXIS, AXIS).fit(pairs.limit(50)).pairs_digest
    rows = again.transform(pairs, "target", AXIS, out="mapped").collect()
    assert all(np.allclose(r["mapped"], got[int(r["id"][1:])]) for r in rows)
    for axis, instrument in ((AXIS[:-1], "field"), (AXIS, "lab")):
        with pytest.raises(ValueError):
            again.transform(pairs, "target", axis, instrument)
    for wrong in ({"components": 0}, {"components": True}, {"storage": "band"}):
        with pytest.raises(ValueError):
            transfer.Transfer("piecewise", "a", "b", AXIS, AXIS, wrong).fit(pairs)
    with pytest.raises(ValueError):
        transfer.Transfer("global", "a", "a", AXIS, AXIS)
    with pytest.raises(ValueError):
        transfer.Transfer("other", "a", "b", AXIS, AXIS).fit(pairs)


def test_axes_are_aligned_first(spark):
    inner = [1005.0 + 10 * k for k in range(19)]
    t = transfer.Transfer("global", "lab", "field", inner, AXIS, {"ridge_share": 1e-9})
    at = TARGET @ matrices.linear_resample(np.array(AXIS), np.array(inner)).T
    pairs = spark.createDataFrame([(f"s{i}", s.tolist(), x.tolist()) for i, (s, x) in enumerate(zip(at * 2 + 1, TARGET, strict=True))], "id string, source array<double>, target array<double>")
    got = np.array([r["target"] for r in t.fit(pairs).transform(pairs, "target", AXIS).collect()])
    assert np.allclose(got, at * 2 + 1, atol=1e-3) and t.manifest()["aligned"]
    with pytest.raises(ValueError, match="beyond"):
        transfer.Transfer("global", "lab", "field", AXIS, inner).fit(pairs)


def test_agreement(spark, pairs):
    _, got = fitted(pairs, "piecewise")
    df = spark.createDataFrame([(SOURCE[i].tolist(), TARGET[i].tolist(), got[i].tolist()) for i in range(60)], "t array<double>, b array<double>, a array<double>")
    rows = {r["stage"]: r for r in transfer.agreement(df, "t", "b", "a").collect()}
    for stage, p in (("before", TARGET), ("after", got)):
        r, t = rows[stage], SOURCE.ravel()
        e = p.ravel() - t
        assert np.allclose([r["n"], r["rmse"], r["bias"], r["r2"]], [1200, np.sqrt((e**2).mean()), e.mean(), 1 - (e @ e) / ((t - t.mean()) ** 2).sum()])
        assert np.isclose(r["slope"], np.polyfit(t, p.ravel(), 1)[0])
    assert np.isclose(rows["after"]["improvement_percent"], 100 * (1 - rows["after"]["rmse"] / rows["before"]["rmse"])) and rows["before"]["improvement_percent"] == 0
    flat = {r["stage"]: r for r in transfer.agreement(spark.createDataFrame([(1.0, 2.0, 1.0)] * 3 + [(None, 1.0, 1.0)], "t double, b double, a double"), "t", "b", "a").collect()}
    assert flat["before"]["n"] == 3 and flat["before"]["slope"] == flat["before"]["r2"] == 0 and flat["after"]["improvement_percent"] == 100


def brute_order(x, y):
    z = (x - x.mean(0)) / np.where(x.std(0) < 1e-12, 1, x.std(0))
    a = np.array([[np.linalg.norm(p - q) for q in z] for p in z])
    b = np.abs(y[:, None] - y)
    d = (a / a.max() if a.max() else a) + (b / b.max() if b.max() else b)
    best = max(((d[i, j], -i, -j) for i in range(len(y)) for j in range(len(y)) if i != j))
    order = [-best[1], -best[2]]
    while len(order) < len(y):
        order.append(max((min(d[i, j] for j in order), -i) for i in range(len(y)) if i not in order)[1] * -1)
    return order


def test_spxy(spark):
    rows, sizes = [], {"a": 6, "b": 33, "c": 500, None: 12}
    for g, n in sizes.items():
        for i in range(n):
            x = R.normal(size=3)
            rows.append((g, i, x.tolist(), float(x[0] > 0) if g == "b" else float(x.sum())))
    df = spark.createDataFrame(rows, "g string, id long, x array<double>, y double").repartition(5)
    got = splits.spxy(df, "g", "id", "x", "y").collect()
    assert len(got) == len(rows)
    for g, n in sizes.items():
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["id"])
        counts = splits.three_counts(n, 0.2, 0.2)
        assert [sum(r["role"] == k for r in mine) for k in splits.ROLES] == list(counts)
        if n <= 40:
            part = dict(zip(brute_order(np.array([r["x"] for r in mine]), np.array([r["y"] for r in mine])), splits.dealt(counts).tolist(), strict=True))
            assert [r["role"] for r in mine] == [splits.ROLES[part[i]] for i in range(n)]
    with pytest.raises(ValueError, match="500 rows"):
        splits.spxy(df, "g", "id", "x", "y", most=499)
    mixed = splits.spxy(df, "g", "id", "x", "y", most=100, beyond="target_stratified").collect()
    assert sorted((r["g"] or "", r["id"]) for r in mixed) == sorted((g or "", i) for g, i, *_ in rows)
    assert {r["role"]: 0 for r in mixed if r["g"] == "c"}.keys() == set(splits.ROLES)
    assert [r["role"] for r in sorted(mixed, key=lambda r: r["id"]) if r["g"] == "b"] == [r["role"] for r in sorted(got, key=lambda r: r["id"]) if r["g"] == "b"]
    with pytest.raises(ValueError, match="a group has 6 rows"):
        splits.spxy(df, "g", "id", "x", "y", tuning=0.4, test=0.4)


def test_parts_fill_evenly():
    assert splits.dealt((6, 2, 2)).tolist()[:5].count(0) == 3
    for counts in ((3, 1, 2), (60, 20, 20), (5, 5, 1)):
        out = splits.dealt(counts)
        assert np.bincount(out, minlength=3).tolist() == list(counts)
        assert all(abs((out[:k] == c).sum() - k * counts[c] / sum(counts)) < 1.5 for k in range(len(out)) for c in range(3))
    for wrong in ((5, 0.2, 0.2), (10, 0.5, 0.5), (10, 0, 0.2), (6, 0.4, 0.4)):
        with pytest.raises(ValueError):
            splits.three_counts(*wrong)
