"""Queries over `embeddings` as spectra: row kernels, fitted statistics, calibration, splits, monitoring, metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spectrel.functions import kernels, matrices
from spectrel.operators import gram, metrics, spectral, splits
from spectrel.plans.registry import query, table

P = 64
POINTS = "p AS (SELECT vec_id, unnest(range(0, 64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def spectra(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("x"))


def points(df, column="x"):
    return df.select("vec_id", F.posexplode(column).alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round("v", 6) + 0.0).alias("v"))


@query("kernel_robust_snv", f"WITH {POINTS}, m AS (SELECT vec_id, pos, v, median(v) OVER (PARTITION BY vec_id) AS med, stddev_pop(v) OVER (PARTITION BY vec_id) AS sd FROM p), d AS (SELECT *, 1.4826 * median(abs(v - med)) OVER (PARTITION BY vec_id) AS mad FROM m) SELECT vec_id, pos, round(CASE WHEN mad > 0 THEN (v - med) / mad WHEN sd > 0 THEN (v - med) / sd ELSE 0 END, 6) AS v FROM d")
def kernel_robust_snv(spark, sf_dir):
    return points(spectra(spark, sf_dir).withColumn("x", kernels.robust_snv(F.col("x"))))


@query("kernel_normalize", f"WITH {POINTS}, n AS (SELECT vec_id, sqrt(sum(v * v)) AS l2, sum(abs(v)) AS l1, max(abs(v)) AS m FROM p GROUP BY vec_id) SELECT p.vec_id, pos, round(v / l2, 6) AS l2, round(v / l1, 6) AS l1, round(v / m, 6) AS largest FROM p JOIN n ON p.vec_id = n.vec_id")
def kernel_normalize(spark, sf_dir):
    x = spectra(spark, sf_dir).select("vec_id", F.arrays_zip(*(kernels.normalize(F.col("x"), k).alias(n) for k, n in (("l2", "l2"), ("l1", "l1"), ("max", "largest")))).alias("z"))
    return x.select("vec_id", F.posexplode("z").alias("pos", "z")).select("vec_id", F.col("pos").cast("long").alias("pos"), *(F.round(f"z.{n}", 6).alias(n) for n in ("l2", "l1", "largest")))


@query("kernel_msc", f"WITH {POINTS}, r AS (SELECT pos, avg(v) AS ref FROM p GROUP BY pos), f AS (SELECT vec_id, regr_slope(v, ref) AS b, regr_intercept(v, ref) AS a FROM p JOIN r ON p.pos = r.pos GROUP BY vec_id) SELECT p.vec_id, pos, round((v - a) / b, 5) + 0.0 AS v FROM p JOIN f ON p.vec_id = f.vec_id")
def kernel_msc(spark, sf_dir):
    x = spectra(spark, sf_dir)
    mean, _ = spectral.state(x, "x")
    out = x.withColumn("x", kernels.msc(F.col("x"), F.lit(mean)))
    return out.select("vec_id", F.posexplode("x").alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round("v", 5) + 0.0).alias("v"))


@query("kernel_autoscale", f"WITH {POINTS}, s AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS d FROM p JOIN embeddings e ON p.vec_id = e.vec_id WHERE label < 8 GROUP BY pos) SELECT vec_id, p.pos, round(CASE WHEN d = 0 THEN 0 ELSE (v - m) / d END, 6) AS v FROM p JOIN s ON p.pos = s.pos")
def kernel_autoscale(spark, sf_dir):
    """Fitted on the training rows alone (labels below 8), applied to all."""
    x = spectra(spark, sf_dir)
    mean, std = spectral.state(x.where("label < 8"), "x")
    return points(x.withColumn("x", kernels.autoscale(F.col("x"), F.lit(mean), F.lit(std))))


@query("kernel_median_filter", f"WITH {POINTS}, e AS (SELECT vec_id, pos, v, coalesce(lag(v) OVER w, v) AS a, coalesce(lead(v) OVER w, v) AS b FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY pos)) SELECT vec_id, pos, round(a + b + v - greatest(a, b, v) - least(a, b, v), 6) AS v FROM e")
def kernel_median_filter(spark, sf_dir):
    return points(spectra(spark, sf_dir).withColumn("x", kernels.moving_median(F.col("x"), 3)))


@query("kernel_band", f"WITH {POINTS} SELECT vec_id, pos - 10 AS pos, round(v, 6) AS v FROM p WHERE 1000 + 10 * pos BETWEEN 1100 AND 1250")
def kernel_band(spark, sf_dir):
    axis = F.lit([1000.0 + 10 * k for k in range(P)])
    return points(spectra(spark, sf_dir).withColumn("x", kernels.band(F.col("x"), axis, 1100, 1250)))


@query("kernel_first_difference", f"WITH {POINTS} SELECT vec_id, pos - 1 AS pos, round(v - lv, 6) AS v FROM (SELECT vec_id, pos, v, lag(v) OVER (PARTITION BY vec_id ORDER BY pos) AS lv FROM p) WHERE pos > 0")
def kernel_first_difference(spark, sf_dir):
    return points(spectra(spark, sf_dir).withColumn("x", kernels.differences(F.col("x"))))


@query("kernel_despike")
def kernel_despike(spark, sf_dir):
    return points(spectra(spark, sf_dir).withColumn("x", kernels.despike(F.col("x"))))


@query("kernel_gap_derivative", f"WITH {POINTS}, s AS (SELECT vec_id, pos, avg(v) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM p) SELECT p.vec_id, p.pos, round((a.s - b.s) / 6, 6) + 0.0 AS v FROM p JOIN s a ON p.vec_id = a.vec_id AND a.pos = least(greatest(p.pos, 3), 60) + 3 JOIN s b ON p.vec_id = b.vec_id AND b.pos = least(greatest(p.pos, 3), 60) - 3")
def kernel_gap_derivative(spark, sf_dir):
    return points(spectra(spark, sf_dir).withColumn("x", kernels.gap_derivative(F.col("x"))))


@query("kernel_fused_smooth_detrend")
def kernel_fused_smooth_detrend(spark, sf_dir):
    """Savitzky-Golay, its derivative's axis detrended and smoothed once more: three steps, one matrix."""
    steps = [matrices.savitzky_golay(P, 11, 2), matrices.detrend(np.arange(P, dtype=float)), matrices.whittaker(P, 10.0)]
    return points(spectral.linear(spectra(spark, sf_dir), "x", steps))


@query("kernel_derivative", f"WITH {POINTS}, c AS (SELECT vec_id, pos, least(greatest(pos, 5), 58) AS c FROM p) SELECT c.vec_id, c.pos, round(sum((q.pos - c) * q.v) / 110 + 2 * (c.pos - c) * (11 * sum((q.pos - c) * (q.pos - c) * q.v) - 110 * sum(q.v)) / 9438, 6) + 0.0 AS v FROM c JOIN p q ON c.vec_id = q.vec_id AND q.pos BETWEEN c - 5 AND c + 5 GROUP BY c.vec_id, c.pos, c.c")
def kernel_derivative(spark, sf_dir):
    return points(spectral.linear(spectra(spark, sf_dir), "x", [matrices.savitzky_golay(P, 11, 2, 1)]))


@query("kernel_resample", f"WITH {POINTS} SELECT a.vec_id, a.pos, round((a.v + b.v) / 2, 6) + 0.0 AS v FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.pos = a.pos + 1")
def kernel_resample(spark, sf_dir):
    """Linear interpolation half way between neighbouring points."""
    source = np.arange(P, dtype=float)
    return points(spectral.linear(spectra(spark, sf_dir), "x", [matrices.linear_resample(source, source[:-1] + 0.5)]))


for _name, _f in (("asls", spectral.asls), ("airpls", spectral.airpls), ("arpls", spectral.arpls), ("rubberband", spectral.rubberband)):
    query(f"baseline_{_name}")(lambda spark, sf_dir, f=_f: points(spectral.map_rows(spectra(spark, sf_dir), "x", f)))


@query("kernel_emsc")
def kernel_emsc(spark, sf_dir):
    x = spectra(spark, sf_dir)
    mean, _ = spectral.state(x, "x")
    return points(spectral.emsc(x, "x", np.array(mean) + 1.0 + 0.01 * np.arange(P) ** 1.5, np.arange(P, dtype=float)))


@query("column_state", f"WITH {POINTS} SELECT pos, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM p GROUP BY pos")
def column_state(spark, sf_dir):
    s = spectral.column_statistics(spectra(spark, sf_dir), "x")
    return s.select(F.col("pos").cast("long").alias("pos"), "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")))


@query("samples_in_columns", f"WITH {POINTS} SELECT p.pos, count(*) AS n, round(sum(v * k), 4) AS weighted FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY vec_id) AS k FROM p) p GROUP BY pos")
def samples_in_columns(spark, sf_dir):
    block = 4096
    t = spectral.transposed(spectra(spark, sf_dir), "vec_id", "x", block)
    first = (F.col("block") * block).cast("double")
    part = F.aggregate(F.transform("x", lambda v, i: v * (first + i + 1)), F.lit(0.0), lambda a, v: a + v)
    return t.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.sum(F.size("x").cast("long")).alias("n"), F.round(F.sum(part), 4).alias("weighted"))


def with_target(spark, sf_dir):
    x = spectra(spark, sf_dir)
    return splits.folds(x.withColumn("y", F.col("x")[3] * 2 - F.col("x")[10] + 0.1 * F.col("label")), "vec_id", 5)


@query("pls_cross_validation")
def pls_cross_validation(spark, sf_dir):
    """RMSECV of 1 to 8 components, all folds from one pass."""
    curve = gram.cross_validated(gram.grams(with_target(spark, sf_dir), "x", ["y"], "fold"), 8)
    return spark.createDataFrame([(c["components"], round(c["rmsecv"], 8)) for c in curve], "components int, rmsecv double")


@query("pls_prediction")
def pls_prediction(spark, sf_dir):
    rows = with_target(spark, sf_dir)
    by_fold = gram.grams(rows.where("fold <> 0"), "x", ["y"], "fold")
    total = None
    for g in by_fold.values():
        total = g if total is None else total + g
    model = gram.pls(total, 6)
    return gram.predicted(rows, "x", model["coefficients"][-1], model["intercepts"][-1]).select("vec_id", "fold", F.round("y", 6).alias("y"), F.round("prediction", 6).alias("prediction"))


@query("pls_importance")
def pls_importance(spark, sf_dir):
    v = gram.vip(gram.pls(gram.grams(with_target(spark, sf_dir), "x", ["y"])[0], 6))
    return spark.createDataFrame([(k, round(float(a), 8)) for k, a in enumerate(v)], "pos int, vip double")


@query("drift_scores")
def drift_scores(spark, sf_dir):
    """Rows of all labels against a reference fitted on labels below 8."""
    x = spectra(spark, sf_dir)
    return gram.drift(x, "x", gram.monitoring_reference(x.where("label < 8"), "x")).select("vec_id", F.round("t2", 6).alias("t2"), F.round("q", 6).alias("q"), "flagged")


@query("mahalanobis_outliers")
def mahalanobis_outliers(spark, sf_dir):
    x = spectra(spark, sf_dir)
    return gram.mahalanobis(x, "x", gram.grams(x, "x")[0]).select("vec_id", F.round("distance", 6).alias("distance"), (F.col("distance") > 3).alias("flagged"))


@query("instrument_transfer")
def instrument_transfer(spark, sf_dir):
    """A second instrument's spectra mapped back to the first's: the residual of each row."""
    x = spectra(spark, sf_dir).withColumn("target", F.transform("x", lambda v, i: 1.1 * v + 0.01 * i))
    m, offset = gram.transfer_map(x, "x", "target")
    return spectral.map_rows(x, "target", lambda t: t @ m + offset, "mapped").select("vec_id", F.round(F.sqrt(kernels.norm(F.zip_with("x", "mapped", lambda a, b: a - b), "l2")), 4).alias("residual"))


_Y = "y AS (SELECT l.doc_id, CAST(l.quality AS DOUBLE) AS y, CASE WHEN d.n_chars > 400 THEN 1.0 ELSE 0.25 END AS p, l.toxic AS g FROM (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY doc_id) l JOIN documents d ON l.doc_id = d.doc_id)"


def judged(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    return labels.join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").cast("double").alias("y"), F.when(F.col("n_chars") > 400, 1.0).otherwise(0.25).alias("p"), F.col("toxic").alias("g"))


@query("regression_metrics", f"WITH {_Y} SELECT g, count(*) AS n, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(CASE WHEN var_pop(y) = 0 THEN 0 ELSE 1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)) END, 6) AS r2, round(stddev_samp(y) / sqrt(avg((p - y) * (p - y))), 6) AS rpd, round(avg(p - y), 6) AS bias, round(regr_slope(p, y), 6) AS slope, round(avg(abs(p - y)), 6) AS mae FROM y GROUP BY g")
def regression_metrics(spark, sf_dir):
    return metrics.regression(judged(spark, sf_dir), "y", "p", "g").select("g", "n", *(F.round(c, 6).alias(c) for c in ("rmse", "r2", "rpd", "bias", "slope", "mae")))


@query("residual_diagnostics", f"WITH {_Y}, a AS (SELECT corr(p - y, y) AS trend, var_pop(p - y) / var_pop(y) AS r, avg(p - y) AS m, stddev_pop(p - y) AS s FROM y) SELECT round(trend, 6) AS trend, round(r, 6) AS variance_ratio, round(avg(CASE WHEN abs(p - y - m) > 2 * s THEN 1.0 ELSE 0.0 END), 6) AS outlier_ratio, abs(trend) > 0.3 AS has_trend, r > 0.25 AS high_variance FROM y, a GROUP BY trend, r")
def residual_diagnostics(spark, sf_dir):
    d = metrics.residual_diagnostics(judged(spark, sf_dir), "y", "p")
    return d.select(*(F.round(c, 6).alias(c) for c in ("trend", "variance_ratio", "outlier_ratio")), "has_trend", "high_variance")


_C = f"{_Y}, c AS (SELECT CAST(CAST(y AS INTEGER) AS VARCHAR) AS t, CASE WHEN p > 0.5 THEN '1' ELSE '0' END AS q FROM y)"
_PER = """k AS (SELECT DISTINCT t AS label FROM c), s AS (SELECT label, count(*) FILTER (WHERE t = label) AS support, count(*) FILTER (WHERE q = label) AS called, count(*) FILTER (WHERE t = label AND q = label) AS tp, count(*) AS n FROM k, c GROUP BY label)"""


def classes(spark, sf_dir):
    return judged(spark, sf_dir).select("doc_id", F.col("y").cast("int").cast("string").alias("t"), F.when(F.col("p") > 0.5, "1").otherwise("0").alias("q"), "y", "p")


@query("class_metrics", f"WITH {_C}, {_PER} SELECT label, support, round(tp / called, 6) AS precision, round(tp / support, 6) AS recall, round((n - support - called + tp) / (n - support), 6) AS specificity, round(2 * tp / (called + support), 6) AS f1 FROM s")
def class_metrics(spark, sf_dir):
    return metrics.per_class(classes(spark, sf_dir), "t", "q").select("label", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "specificity", "f1")))


@query("classification_metrics", f"WITH {_C}, {_PER}, o AS (SELECT count(*) AS n, avg(CASE WHEN t = q THEN 1.0 ELSE 0.0 END) AS accuracy, corr(CASE WHEN t = '1' THEN 1.0 ELSE 0.0 END, CASE WHEN q = '1' THEN 1.0 ELSE 0.0 END) AS mcc FROM c) SELECT o.n, round(o.accuracy, 6) AS accuracy, round(avg(tp / support), 6) AS balanced_accuracy, round(avg(2 * tp / (called + support)), 6) AS macro_f1, round(o.mcc, 6) AS mcc, round(min(tp / support), 6) AS least_recall FROM s, o GROUP BY o.n, o.accuracy, o.mcc")
def classification_metrics(spark, sf_dir):
    return metrics.classification(classes(spark, sf_dir), "t", "q").select("n", *(F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "mcc", "least_recall")))


@query("roc_auc", f"WITH {_Y}, r AS (SELECT y, avg(k) OVER (PARTITION BY p) AS k FROM (SELECT y, p, row_number() OVER (ORDER BY p, doc_id) AS k FROM y)) SELECT round((sum(CASE WHEN y = 1 THEN k ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc FROM r")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(judged(spark, sf_dir), "y", "p").select(F.round("roc_auc", 6).alias("roc_auc"))


_KEY = "md5('42|' || CAST({} AS VARCHAR))"


@query("split_three_way", f"WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY {_KEY.format('doc_id')}, doc_id) - 1 AS place, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN place < floor(n * 0.2) THEN 'test' WHEN place < floor(n * 0.2) + floor((n - floor(n * 0.2)) * 0.2) THEN 'validation' ELSE 'train' END AS role FROM k")
def split_three_way(spark, sf_dir):
    return splits.three_way(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("split_stratified", f"WITH k AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_KEY.format('vec_id')}, vec_id) - 1 AS place, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT vec_id, CAST(label AS INTEGER) AS label, CASE WHEN place < floor(n * 0.2) THEN 'test' WHEN place < floor(n * 0.2) + floor((n - floor(n * 0.2)) * 0.2) THEN 'validation' ELSE 'train' END AS role FROM k")
def split_stratified(spark, sf_dir):
    return splits.stratified(spectra(spark, sf_dir).select("vec_id", "label"), "vec_id", "label")


@query("split_by_group", f"WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT source, n, sum(n) OVER (ORDER BY {_KEY.format('source')}, source) AS run, sum(n) OVER () AS total FROM s) SELECT source, count(*) AS n, CASE WHEN run - r.n / 2 <= 0.2 * total THEN 'test' ELSE 'train' END AS role FROM documents JOIN r USING (source) GROUP BY source, run, r.n, total")
def split_by_group(spark, sf_dir):
    return splits.by_group(table(spark, sf_dir, "documents").select("source"), "source").groupBy("source", "role").agg(F.count(F.lit(1)).alias("n"))


@query("split_target_stratified", f"WITH k AS (SELECT event_id, (row_number() OVER (ORDER BY value, event_id) - 1) // 20 AS b FROM events), w AS (SELECT event_id, (row_number() OVER (PARTITION BY b ORDER BY {_KEY.format('event_id')}, event_id) - 1) % 5 AS k FROM k) SELECT event_id, CASE k WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS role FROM w")
def split_target_stratified(spark, sf_dir):
    return splits.target_stratified(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", "value", ["test", "validation", "train", "train", "train"]).select("event_id", "role")


@query("split_leaks", "WITH s AS (SELECT DISTINCT text, CASE WHEN doc_id % 5 = 0 THEN 'test' WHEN doc_id % 5 = 1 THEN 'validation' ELSE 'train' END AS r FROM documents) SELECT a.r AS role_a, b.r AS role_b, count(*) AS n FROM s a JOIN s b ON a.text = b.text AND a.r < b.r GROUP BY 1, 2")
def split_leaks(spark, sf_dir):
    role = F.when(F.col("doc_id") % 5 == 0, "test").when(F.col("doc_id") % 5 == 1, "validation").otherwise("train")
    return splits.leaks(table(spark, sf_dir, "documents").select("text", role.alias("r")), "r", ["text"])


@query("duplicate_groups", "SELECT count(*) AS n, max(n_chars + doc_id % 3) - min(n_chars + doc_id % 3) > 1e-9 AS conflicting FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("t", F.col("n_chars") + F.col("doc_id") % 3)
    return splits.duplicate_groups(d, ["text"], "t").select("n", "conflicting")


@query("components_choice", "WITH c AS (SELECT user_id AS k, event_id AS a, value AS e, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) AS nx, min(value) OVER (PARTITION BY user_id) AS lo FROM events WHERE value IS NOT NULL) SELECT k, arg_min(a, (e, a)) AS minimum, min(CASE WHEN nx IS NULL OR nx >= e THEN a END) AS first_minimum, min(CASE WHEN e <= 1.05 * lo THEN a END) AS within_5_percent FROM c GROUP BY k")
def components_choice(spark, sf_dir):
    curve = table(spark, sf_dir, "events").where("value IS NOT NULL").select(F.col("user_id").alias("k"), F.col("event_id").alias("components"), F.col("value").alias("rmsecv"))
    return metrics.components_choice(curve, "k")


@query("ensemble_prediction", "SELECT user_id, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(sum(value * (event_id % 3 + 1)) / sum(event_id % 3 + 1), 6) AS weighted FROM events GROUP BY user_id")
def ensemble_prediction(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("w", F.col("event_id") % 3 + 1)
    parts = [metrics.ensemble(e, "user_id", "value", how, "w").select("user_id", F.round("value", 6).alias(how)) for how in ("mean", "median", "weighted")]
    return parts[0].join(parts[1], "user_id").join(parts[2], "user_id")


@query("preprocessing_pipeline")
def preprocessing_pipeline(spark, sf_dir):
    """A default pipeline, fitted on labels below 8 and applied to all rows."""
    from spectrel.operators import pipeline

    x = spectra(spark, sf_dir)
    return points(pipeline.fit(x.where("label < 8"), pipeline.DEFAULTS[1]).transform(x))
