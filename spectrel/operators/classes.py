"""Class models over spectra: partial least squares on class indicators, multinomial logistic regression, linear margins.

Classes are told by their labels as text, in order; at most `MOST_CLASSES`. Least squares on indicators comes from the cross-products
of [x, indicators] by fold, so that only the choice of components reads rows again, once for all folds and numbers of components. The
other families are Spark's own, with every class weighing as much as any other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrel.operators import metrics
from spectrel.operators.gram import Gram, grams
from spectrel.operators.selection import summed
from spectrel.operators.spectral import map_rows
from spectrel.operators.splits import shuffle_key
from spectrel.operators.tabular import ranked

MOST_CLASSES = 200
FAMILIES = ("pls_da", "logistic", "linear_svm")


def class_names(df: DataFrame, label: str) -> list[str]:
    """The labels in order; null is none. Fewer than two, or more than MOST_CLASSES, raise ValueError."""
    found = [r[0] for r in df.select(F.col(label).cast("string")).where(F.col(label).isNotNull()).distinct().limit(MOST_CLASSES + 1).collect()]
    if not 2 <= len(found) <= MOST_CLASSES:
        raise ValueError(f"between 2 and {MOST_CLASSES} classes are needed")
    return sorted(found)


def stratified_folds(df: DataFrame, id_: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold, 0 to k - 1: rows in order of class, shuffled within it, are dealt in turn, so a class differs by one row between folds."""
    placed = ranked(df.withColumn("__key", shuffle_key(id_, seed)), [label, "__key", id_], "__place")
    return placed.withColumn("fold", (F.col("__place") % k).cast("int")).drop("__key", "__place")


def indicated(df: DataFrame, label: str, names: list[str]) -> tuple[DataFrame, list[str]]:
    """df with a column of 0 and 1 for each class, and their names."""
    columns = [f"__class{k}" for k in range(len(names))]
    return df.withColumns({c: (F.col(label).cast("string") == n).cast("double") for c, n in zip(columns, names, strict=True)}), columns


def pls_targets(gram: Gram, components: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Partial least squares on all targets at once: (coefficients, intercepts) of 1 to `components`. Each component's weights are the
    leading singular vector of what the targets still have in common with the positions."""
    xx, xy = gram.centred()
    left, p, r, q, out = xy.copy(), [], [], [], []
    for _ in range(components):
        u, s, _ = np.linalg.svd(left, full_matrices=False)
        if s[0] < 1e-12:
            break
        ra = u[:, 0].copy()
        for pj, rj in zip(p, r, strict=True):
            ra -= (pj @ u[:, 0]) * rj
        t = float(ra @ xx @ ra)
        if t < 1e-12:
            break
        pa_, qa = xx @ ra / t, xy.T @ ra / t
        left = left - t * np.outer(pa_, qa)
        p.append(pa_), r.append(ra), q.append(qa)
        b = np.array(r).T @ np.array(q)
        out.append((b, gram.mean[len(xx) :] - gram.mean[: len(xx)] @ b))
    return out


@dataclass
class Discriminant:
    """The class of the largest of linear scores."""

    names: list[str]
    coefficients: np.ndarray
    intercepts: np.ndarray
    components: int

    def predict(self, df: DataFrame, x: str) -> DataFrame:
        """Adds predicted (the first of the classes with the largest score) and probabilities (softmax of the scores)."""
        b, a = self.coefficients, self.intercepts
        scored = map_rows(df, x, lambda rows: rows @ b + a, "__scores")
        top = F.array_max("__scores")
        parts = F.transform("__scores", lambda s: F.exp(F.greatest(s - top, F.lit(-50.0))))
        names = F.lit(self.names)
        share = lambda parts: F.transform(parts, lambda e: e / F.aggregate(parts, F.lit(0.0), lambda u, v: u + v))
        return scored.withColumns({"predicted": F.element_at(names, F.array_position("__scores", top).cast("int")), "probabilities": share(parts)}).drop("__scores")


def _balanced(table: dict[tuple[str, str], int]) -> float:
    """Mean over the true classes of the share found."""
    size: dict[int, int] = {}
    for (t, _), n in table.items():
        size[t] = size.get(t, 0) + n
    return float(np.mean([table.get((t, t), 0) / n for t, n in size.items()]))


def choose_components(df: DataFrame, x: str, label: str, names: list[str], most: int = 10, fold: str = "fold") -> tuple[int, list[tuple[int, float]]]:
    """The number of components with the greatest mean balanced accuracy over the folds (ties: fewer), and all means.

    One pass gives the products by fold, another judges each row by the models of all sizes that its own fold had no part in."""
    rows, columns = indicated(df, label, names)
    by_fold = grams(rows, x, columns, fold)
    upper = max(1, min(most, len(next(iter(by_fold.values())).shift) - len(names), min(sum(g.n for f, g in by_fold.items() if f != k) for k in by_fold) - 1))
    models = {f: pls_targets(summed(g for k, g in by_fold.items() if k != f), upper) for f in by_fold}

    def judge(batches):
        counts: dict[tuple[int, int, int, int], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            data = np.asarray(pc.list_flatten(batch.column(0))).reshape(batch.num_rows, -1)
            folds, truth = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for f in np.unique(folds).tolist():
                own = folds == f
                for k, (b, a) in enumerate(models[f], start=1):
                    called = (data[own] @ b + a).argmax(axis=1)
                    found, n = np.unique(np.stack([truth[own], called]), axis=1, return_counts=True)
                    for (t, c), m in zip(found.T.tolist(), n.tolist(), strict=True):
                        counts[f, k, t, c] = counts.get((f, k, t, c), 0) + m
        keys = list(zip(*counts, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in keys), pa.array(counts.values(), pa.int64())], names=["fold", "k", "truth", "called", "n"])

    code = (F.array_position(F.lit(names), F.col(label).cast("string")) - 1).cast("int")
    judged = df.where(F.col(label).isNotNull()).select(F.col(x).cast("array<double>").alias("x"), F.col(fold).cast("int").alias("fold"), code.alias("truth")).mapInArrow(judge, "fold int, k int, truth int, called int, n long")
    tables: dict[tuple[int, int], dict] = {}
    for r in judged.groupBy("fold", "k", "truth", "called").agg(F.sum("n").alias("n")).collect():  # folds * components * classes^2 rows at most
        tables.setdefault((r["k"], r["fold"]), {})[r["truth"], r["called"]] = r["n"]
    means = [(k, float(np.mean([_balanced(t) for (j, _), t in tables.items() if j == k]))) for k in sorted({k for k, _ in tables})]
    return max(means, key=lambda m: (m[1], -m[0]))[0], means


def pls_da(df: DataFrame, x: str, label: str, components: int, names: list[str] | None = None) -> Discriminant:
    names = names or class_names(df, label)
    rows, columns = indicated(df.where(F.col(label).isNotNull()), label, names)
    found = pls_targets(grams(rows, x, columns)[0], components)
    return Discriminant(names, *found[-1], len(found))


@dataclass
class Native:
    """A model of Spark's own classes over label codes."""

    names: list[str]
    model: object

    def predict(self, df: DataFrame, x: str) -> DataFrame:
        """Adds predicted."""
        out = self.model.transform(df.withColumn("__x", array_to_vector(F.col(x).cast("array<double>"))))
        return out.withColumn("predicted", F.element_at(F.lit(self.names), (F.col("__called") + 1).cast("int"))).select(*df.columns, "predicted")


def _weighted(df: DataFrame, x: str, label: str, names: list[str]) -> tuple[DataFrame, int]:
    """Rows with label codes, and weights that give every class the same sum; all weights sum to the number of rows."""
    code = F.array_position(F.lit(names), F.col(label).cast("string")) - 1
    rows = df.where(F.col(label).isNotNull()).select(array_to_vector(F.col(x).cast("array<double>")).alias("__x"), code.cast("double").alias("__y"))
    sizes = {r["__y"]: r["n"] for r in rows.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each class
    total = sum(sizes.values())
    weight = F.element_at(F.create_map(*(F.lit(v) for k, n in sizes.items() for v in (k, total / (len(sizes) * n)))), F.col("__y"))
    return rows.withColumn("__weight", weight), total


def logistic(df: DataFrame, x: str, label: str, names: list[str] | None = None, c: float = 1.0, tolerance: float = 1e-8, steps: int = 500) -> Native:
    """Multinomial logistic regression with the penalty |w|^2 / 2c beside the weighted sum of the rows' losses."""
    names = names or class_names(df, label)
    rows, n = _weighted(df, x, label, names)
    learn = LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__weight", predictionCol="__called", rawPredictionCol="__raw", probabilityCol="__probability", family="multinomial", regParam=1 / (c * n), standardization=False, tol=tolerance, maxIter=steps)
    return Native(names, learn.fit(rows))


def linear_margin(df: DataFrame, x: str, label: str, names: list[str] | None = None, c: float = 1.0, steps: int = 100) -> Native:
    """A linear hinge-loss margin for each class against the rest."""
    names = names or class_names(df, label)
    rows, n = _weighted(df, x, label, names)
    one = LinearSVC(regParam=1 / (c * n), standardization=False, maxIter=steps)
    learn = OneVsRest(classifier=one, featuresCol="__x", labelCol="__y", weightCol="__weight", predictionCol="__called")
    return Native(names, learn.fit(rows))


def choose_family(calibration: DataFrame, tuning: DataFrame, x: str, label: str, id_: str, families: tuple[str, ...] = FAMILIES, most: int = 10, seed: int = 42, steps: int = 100) -> dict:
    """The family with the best balanced accuracy on the tuning rows (ties: macro F1, then mcc, then the first named). Tuning rows choose
    nothing but the family; steps: the most that an iterative family takes. Returns family, model and candidates: family, balanced_accuracy, macro_f1, mcc, components."""
    if not families or set(families) - set(FAMILIES):
        raise ValueError(f"families are of {FAMILIES}")
    names = class_names(calibration, label)
    candidates, models = [], {}
    for family in dict.fromkeys(families):
        components = None
        if family == "pls_da":
            fewest = calibration.where(F.col(label).isNotNull()).groupBy(label).count().agg(F.min("count")).first()[0]
            dealt = stratified_folds(calibration.where(F.col(label).isNotNull()), id_, label, max(2, min(5, fewest)), seed)
            components, _ = choose_components(dealt, x, label, names, most)
            model = pls_da(calibration, x, label, components, names)
        else:
            model = (logistic if family == "logistic" else linear_margin)(calibration, x, label, names, steps=steps)
        called = model.predict(tuning.where(F.col(label).isNotNull()), x).select(F.col(label).cast("string").alias("t"), F.col("predicted").alias("p"))
        m = metrics.classification(called, "t", "p").first()
        candidates.append({"family": family, "balanced_accuracy": m["balanced_accuracy"], "macro_f1": m["macro_f1"], "mcc": m["mcc"], "components": components})
        models[family] = model
    best = max(candidates, key=lambda c: (c["balanced_accuracy"], c["macro_f1"], c["mcc"], -candidates.index(c)))
    return {"family": best["family"], "model": models[best["family"]], "candidates": candidates}
