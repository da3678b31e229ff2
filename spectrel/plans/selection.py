"""Queries over `embeddings` as spectra: choice of positions and penalties, calibration transfer, splits by distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrel.functions import kernels
from spectrel.operators import classes, gram, search, selection, splits, transfer, trees
from spectrel.plans.registry import query, table
from spectrel.plans.spectral import P, POINTS, spectra


def with_blocks(spark, sf_dir):
    """Spectra in ten blocks, with a target that a few positions and the label make."""
    x = spectra(spark, sf_dir)
    return splits.folds(x.withColumn("y", F.col("x")[3] * 2 - F.col("x")[10] + 0.5 * F.col("x")[40] + 0.1 * F.col("label")), "vec_id", 10).withColumnRenamed("fold", "block")


@query("cars_selection")
def cars_selection(spark, sf_dir):
    """Per position: its weight, whether it stays, and the errors with all and with the chosen positions. One pass over the rows."""
    found = selection.cars(gram.grams(with_blocks(spark, sf_dir), "x", ["y"], "block"))
    rows = [(k, float(w), k in found["selected"], found["error"], found["full_error"]) for k, w in enumerate(found["weights"])]
    return spark.createDataFrame(rows, "pos int, weight double, selected boolean, error double, full_error double").select("pos", F.round("weight", 6).alias("weight"), "selected", F.round("error", 8).alias("error"), F.round("full_error", 8).alias("full_error"))


@query("projection_selection")
def projection_selection(spark, sf_dir):
    """The positions that successive projections choose, of starts everywhere. Two passes over the rows."""
    rows = with_blocks(spark, sf_dir)
    found = selection.successive_projections(rows, "x", "y", gram.grams(rows, "x", ["y"])[0])
    return spark.createDataFrame([(k, found["candidates"], found["error"]) for k in found["selected"]], "pos int, candidates int, error double").withColumn("error", F.round("error", 8))


@query("penalised_grid")
def penalised_grid(spark, sf_dir):
    """The cross-validated error of each penalty of ridge, lasso and elastic net, and which is chosen, from the Grams of ten folds."""
    by_fold = gram.grams(with_blocks(spark, sf_dir), "x", ["y"], "block")
    rows = []
    for kind in ("ridge", "lasso", "elastic_net"):
        found = selection.penalised(by_fold, kind)
        rows += [(kind, alpha, ratio, error, (alpha, ratio) == (found["alpha"], found["l1_ratio"])) for alpha, ratio, error in found["grid"]]
    return spark.createDataFrame(rows, "kind string, alpha double, l1_ratio double, error double, chosen boolean").withColumn("error", F.round("error", 8))


def instruments(spark, sf_dir):
    """The same samples on two instruments: the second blurs, stretches and tilts."""
    x = spectra(spark, sf_dir)
    blurred = F.transform("x", lambda v, i: 1.1 * v + 0.2 * F.get(F.col("x"), i - 1) + 0.01 * i)
    target = x.select("vec_id", F.transform(blurred, lambda v: F.coalesce(v, F.lit(0.0))).alias("x"))
    return transfer.paired(x.select("vec_id", "x"), target, "vec_id", "x")


AXIS = [1000.0 + 10 * k for k in range(P)]


def _residuals(spark, sf_dir, method, **parameters):
    pairs = instruments(spark, sf_dir)
    roles = transfer.pair_roles(pairs)
    fitted = transfer.Transfer(method, "first", "second", AXIS, AXIS, parameters).fit(roles.where("role = 'train'"))
    mapped = fitted.transform(roles, "target", AXIS, "second", "mapped")
    residual = F.sqrt(kernels.norm(F.zip_with("source", "mapped", lambda a, b: a - b), "l2"))
    return mapped.select(F.col("id").cast("long").alias("vec_id"), "role", F.round(residual, 4).alias("residual"))


@query("transfer_piecewise")
def transfer_piecewise(spark, sf_dir):
    """Fitted on three quarters of the pairs; the residual of every row."""
    return _residuals(spark, sf_dir, "piecewise", half_window=5, components=3)


@query("transfer_joint_space")
def transfer_joint_space(spark, sf_dir):
    return _residuals(spark, sf_dir, "joint_space", components=10)


@query(
    "transfer_agreement",
    f"WITH {POINTS}, q AS (SELECT v AS t, 1.1 * v + 0.01 * pos AS b, 1.01 * v + 0.002 AS a FROM p), s AS (SELECT 'before' AS stage, t, b AS v FROM q UNION ALL SELECT 'after', t, a FROM q), f AS (SELECT stage, count(*) AS n, sqrt(avg((v - t) * (v - t))) AS rmse, avg(v - t) AS bias, regr_slope(v, t) AS slope, 1 - sum((v - t) * (v - t)) / (var_pop(t) * count(*)) AS r2 FROM s GROUP BY stage) SELECT stage, n, round(rmse, 6) AS rmse, round(bias, 6) AS bias, round(slope, 6) AS slope, round(r2, 6) AS r2, round(CASE WHEN stage = 'before' THEN 0 ELSE 100 * (1 - rmse / (SELECT rmse FROM f WHERE stage = 'before')) END, 4) AS improvement_percent FROM f",
)
def transfer_agreement(spark, sf_dir):
    rows = spectra(spark, sf_dir).select("x", F.transform("x", lambda v, i: 1.1 * v + 0.01 * i).alias("before"), F.transform("x", lambda v: 1.01 * v + 0.002).alias("after"))
    found = transfer.agreement(rows, "x", "before", "after")
    return found.select("stage", "n", *(F.round(c, 6).alias(c) for c in ("rmse", "bias", "slope", "r2")), F.round("improvement_percent", 4).alias("improvement_percent"))


@query(
    "prediction_agreement",
    "WITH q AS (SELECT l_extendedprice AS t, l_extendedprice * 1.05 + l_quantity AS b, l_extendedprice * 0.99 AS a FROM lineitem), s AS (SELECT 'before' AS stage, t, b AS v FROM q UNION ALL SELECT 'after', t, a FROM q), f AS (SELECT stage, count(*) AS n, sqrt(avg((v - t) * (v - t))) AS rmse, avg(v - t) AS bias, regr_slope(v, t) AS slope, 1 - sum((v - t) * (v - t)) / (var_pop(t) * count(*)) AS r2 FROM s GROUP BY stage) SELECT stage, n, round(rmse, 4) AS rmse, round(bias, 4) AS bias, round(slope, 6) AS slope, round(r2, 6) AS r2, round(CASE WHEN stage = 'before' THEN 0 ELSE 100 * (1 - rmse / (SELECT rmse FROM f WHERE stage = 'before')) END, 4) AS improvement_percent FROM f",
)
def prediction_agreement(spark, sf_dir):
    price = F.col("l_extendedprice").cast("double")
    rows = table(spark, sf_dir, "lineitem").select(price.alias("t"), (price * 1.05 + F.col("l_quantity").cast("double")).alias("b"), (price * 0.99).alias("a"))
    found = transfer.agreement(rows, "t", "b", "a")
    return found.select("stage", "n", F.round("rmse", 4).alias("rmse"), F.round("bias", 4).alias("bias"), F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), F.round("improvement_percent", 4).alias("improvement_percent"))


@query("spxy_split")
def spxy_split(spark, sf_dir):
    """Every 400 spectra are a dataset of their own; a last one that is too small for three parts goes with the one before."""
    x = spectra(spark, sf_dir)
    last = (x.count() + 399) // 400 - 1
    small = x.where(F.floor(F.col("vec_id") / 400) == last).count() < 6
    dataset = F.floor(F.col("vec_id") / 400)
    rows = x.select("vec_id", "x", (F.col("x")[3] * 2 - F.col("label")).alias("y"), (F.least(dataset, F.lit(max(0, last - small))) if small else dataset).cast("long").alias("dataset"))
    return splits.spxy(rows, "dataset", "vec_id", "x", "y").select("dataset", "vec_id", "role")


@query("nested_search")
def nested_search(spark, sf_dir):
    """Candidate pipelines with three families: every fifth spectrum is for validation, the others in five folds; which candidate wins."""
    x = splits.folds(with_blocks(spark, sf_dir).drop("block"), "vec_id", 6).withColumn("fold", F.col("fold") - 1)
    candidates = [(("snv", {}),), (("msc", {}), ("autoscale", {})), (("sg_smooth", {}), ("snv", {}), ("mean_center", {})), (("derivative1", {}), ("msc", {}))]
    found = search.nested(x, "x", "y", candidates, families=("pls", "ridge", "lasso"), most=10)
    rows = [(e["pipeline_id"], e["family"], str(e["parameters"]), e["cv_rmse"], e["cv_r2"], e["val_rmse"], e["val_r2"], i == found["winner"]) for i, e in enumerate(found["evaluations"])]
    out = spark.createDataFrame(rows, "pipeline_id string, family string, parameters string, cv_rmse double, cv_r2 double, val_rmse double, val_r2 double, winner boolean")
    return out.select("pipeline_id", "family", "parameters", *(F.round(c, 6).alias(c) for c in ("cv_rmse", "cv_r2", "val_rmse", "val_r2")), "winner")


@query("class_components")
def class_components(spark, sf_dir):
    """Balanced accuracy of least squares on class indicators, by number of components, over stratified folds."""
    x = classes.stratified_folds(spectra(spark, sf_dir), "vec_id", "label")
    best, means = classes.choose_components(x, "x", "label", classes.class_names(x, "label"), 12)
    return spark.createDataFrame([(k, m, k == best) for k, m in means], "components int, balanced_accuracy double, chosen boolean").withColumn("balanced_accuracy", F.round("balanced_accuracy", 8))


@query("class_families")
def class_families(spark, sf_dir):
    """Three families of class models, fitted on four fifths of the spectra and compared on the others."""
    x = splits.folds(spectra(spark, sf_dir).withColumn("kind", F.col("label") % 3), "vec_id", 5)
    found = classes.choose_family(x.where("fold > 0"), x.where("fold = 0"), "x", "kind", "vec_id", steps=25)
    rows = [(c["family"], c["components"], c["balanced_accuracy"], c["macro_f1"], c["mcc"], c["family"] == found["family"]) for c in found["candidates"]]
    out = spark.createDataFrame(rows, "family string, components int, balanced_accuracy double, macro_f1 double, mcc double, chosen boolean")
    return out.select("family", "components", *(F.round(c, 6).alias(c) for c in ("balanced_accuracy", "macro_f1", "mcc")), "chosen")


@query("tree_ensembles")
def tree_ensembles(spark, sf_dir):
    """Forests and boosted trees of two sizes each, by their errors over folds."""
    rows = splits.folds(with_blocks(spark, sf_dir).drop("block"), "vec_id", 3)
    out = []
    for family, grid in (("forest", [{"trees": 10, "depth": d} for d in (4, 8)]), ("boosted", [{"trees": n, "rate": 0.1, "depth": 3} for n in (3, 6)])):
        found = trees.chosen(rows, "x", "y", family, grid=grid)
        out += [(family, str(p), e**0.5, p == found["parameters"]) for p, e in found["grid"]]
    return spark.createDataFrame(out, "family string, parameters string, rmse double, chosen boolean").withColumn("rmse", F.round("rmse", 6))
