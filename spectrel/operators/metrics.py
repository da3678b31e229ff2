"""Regression and classification metrics, diagnostics and gates as one-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrel.operators.tabular import running

#: Minimum R2 and RPD by domain.
DOMAINS = {
    "food_protein": (0.85, 3.5),
    "food_moisture": (0.90, 4.0),
    "soil": (0.70, 2.0),
    "feed": (0.75, 2.5),
    "pharma": (0.85, 3.0),
    "default": (0.80, 3.0),
}


def regression(df: DataFrame, truth: str, predicted: str, *groups: str) -> DataFrame:
    """n, rmse, r2, rpd, bias, slope, mae of each group. Constant truth: r2, rpd and slope are 0; a perfect fit has rpd infinity."""
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    e = p - y
    sums = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("ss"), F.var_pop(y).alias("v"), F.stddev_samp(y).alias("s"), F.avg(e).alias("bias"), F.regr_slope(p, y).alias("b"), F.avg(F.abs(e)).alias("mae")
    )
    total = F.col("v") * F.col("n")
    s = F.coalesce("s", F.lit(0.0))
    return sums.select(
        *groups, "n", "rmse", F.when(total == 0, 0.0).otherwise(1 - F.col("ss") / total).alias("r2"),
        F.when((F.col("rmse") == 0) & (s > 0), float("inf")).when(s == 0, 0.0).otherwise(F.try_divide(s, F.col("rmse"))).alias("rpd"), "bias", F.when(total == 0, 0.0).otherwise(F.coalesce("b", F.lit(0.0))).alias("slope"), "mae",
    )


def residual_diagnostics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """trend (correlation of residual and truth beyond 0.3), variance (of residual over truth's beyond 0.25), outliers (share beyond two standard deviations)."""
    both = df.select(F.col(truth).cast("double").alias("y"), (F.col(predicted).cast("double") - F.col(truth)).alias("e"))
    first = both.agg(F.corr("e", "y").alias("trend"), F.try_divide(F.var_pop("e"), F.var_pop("y")).alias("variance_ratio"), F.avg("e").alias("m"), F.stddev_pop("e").alias("s"))
    return both.join(F.broadcast(first)).groupBy("trend", "variance_ratio").agg(F.avg((F.abs(F.col("e") - F.col("m")) > 2 * F.col("s")).cast("double")).alias("outlier_ratio")).select(
        "trend", "variance_ratio", "outlier_ratio", F.coalesce(F.abs("trend") > 0.3, F.lit(False)).alias("has_trend"), F.coalesce(F.col("variance_ratio") > 0.25, F.lit(False)).alias("high_variance")
    )


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).cast("string").alias("truth"), F.col(predicted).cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label, support, precision, recall, specificity, f1 of each true class."""
    c = confusion(df, truth, predicted)
    sides = c.select("n", F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("is_true"), F.lit(0).alias("is_predicted")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("is_true"), F.lit(1).alias("is_predicted")))).alias("s"), (F.col("truth") == F.col("predicted")).alias("hit"))
    by = sides.groupBy("s.label").agg(F.sum(F.col("n") * F.col("s.is_true")).alias("support"), F.sum(F.col("n") * F.col("s.is_predicted")).alias("called"), (F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)) / 2).alias("tp"))
    total = F.sum("support").over(Window.partitionBy())
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = by.withColumn("total", total).where("support > 0")
    false_positive = F.col("called") - F.col("tp")
    return out.select(
        "label", "support", share(F.col("tp"), F.col("called")).alias("precision"), share(F.col("tp"), F.col("support")).alias("recall"),
        share(F.col("total") - F.col("support") - false_positive, F.col("total") - F.col("support")).alias("specificity"), share(2 * F.col("tp"), F.col("called") + F.col("support")).alias("f1"),
    )


def classification(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """n, accuracy, balanced_accuracy, macro_f1, mcc, least_recall."""
    c = confusion(df, truth, predicted)
    by = per_class(df, truth, predicted).agg(F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), F.min("recall").alias("least_recall"))
    hits = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    t, p = c.groupBy(F.col("truth").alias("k")).agg(F.sum("n").alias("t")), c.groupBy(F.col("predicted").alias("k")).agg(F.sum("n").alias("p"))
    products = t.join(p, "k", "full_outer").na.fill(0).agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    all_ = hits.join(F.broadcast(products)).join(F.broadcast(by))
    n2 = F.col("n") * F.col("n")
    mcc = F.when((n2 == F.col("tt")) | (n2 == F.col("pp")), 0.0).otherwise((F.col("hit") * F.col("n") - F.col("tp")) / (F.sqrt(n2 - F.col("tt")) * F.sqrt(n2 - F.col("pp"))))
    return all_.select("n", (F.col("hit") / F.col("n")).alias("accuracy"), "balanced_accuracy", "macro_f1", mcc.alias("mcc"), "least_recall")


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the curve of a 0/1 truth, from rank sums; equal scores share their mean rank. Scores are counted first, so that the
    ordered pass is over distinct values."""
    counts = df.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(truth).cast("long")).alias("pos"))
    placed = running(counts, ["s"], F.col("n"), "before")
    sums = placed.select("n", "pos", (F.col("before") + (F.col("n") + 1) / 2).alias("rank")).agg(F.sum(F.col("rank") * F.col("pos")).alias("ranks"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return sums.select(F.try_divide(F.col("ranks") - p * (p + 1) / 2, p * q).alias("roc_auc"))


def gate(metrics: DataFrame, domain: str = "default", r2: str = "r2", rpd: str = "rpd") -> DataFrame:
    """Adds passed, against the domain's thresholds."""
    least_r2, least_rpd = DOMAINS.get(domain, DOMAINS["default"])
    return metrics.withColumn("passed", (F.col(r2) >= least_r2) & (F.col(rpd) >= least_rpd))


def ensemble(predictions: DataFrame, sample: str, value: str, how: str = "mean", weight: str | None = None) -> DataFrame:
    """One prediction for each sample from several models'."""
    if how == "weighted":
        agg: Column = F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))
    else:
        agg = {"mean": F.avg, "median": F.median}[how](value)
    return predictions.groupBy(sample).agg(agg.alias(value))


def components_choice(curve: DataFrame, key: str, components: str = "components", error: str = "rmsecv") -> DataFrame:
    """For each key: minimum, first_minimum (the first that the next doesn't better), within_5_percent (the fewest with an error of at most 1.05 times the minimum)."""
    w = Window.partitionBy(key)
    seen = curve.withColumns({"next": F.lead(error).over(w.orderBy(components)), "least": F.min(error).over(w)})
    return seen.groupBy(key).agg(
        F.min_by(components, F.struct(error, components)).alias("minimum"),
        F.min(F.when(F.col("next").isNull() | (F.col("next") >= F.col(error)), F.col(components))).alias("first_minimum"),
        F.min(F.when(F.col(error) <= 1.05 * F.col("least"), F.col(components))).alias("within_5_percent"),
    )
