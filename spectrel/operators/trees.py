"""Tree ensembles over spectra: Spark's forests and boosted trees, which bin positions once and grow all nodes of a level from one
aggregation, with their sizes chosen over folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Family: grid of parameters that is searched unless another is given. Depth 0 stands for as deep as Spark grows trees (30).
GRIDS = {
    "forest": [{"trees": n, "depth": d} for n in (100, 200) for d in (0, 10)],
    "boosted": [{"trees": n, "rate": r, "depth": d} for n in (100, 200) for r in (0.05, 0.1) for d in (2, 3)],
}
DEEPEST = 30


@dataclass
class Trees:
    model: object
    parameters: dict

    def predict(self, df: DataFrame, x: str, out: str = "prediction") -> DataFrame:
        found = self.model.transform(df.withColumn("__x", array_to_vector(F.col(x).cast("array<double>"))))
        return found.withColumn(out, F.col("__called")).select(*[c for c in df.columns if c != out], out)

    def importance(self) -> list[float]:
        """Of each position: its share of the reduction of variance over all trees."""
        return [float(v) for v in self.model.featureImportances.toArray()]


def grown(df: DataFrame, x: str, y: str, family: str, parameters: dict, seed: int = 42) -> Trees:
    """A forest (each split looks at a third of the positions) or boosted trees on squared errors."""
    depth = parameters.get("depth", 0) or DEEPEST
    shared = {"featuresCol": "__x", "labelCol": "__y", "predictionCol": "__called", "maxDepth": depth, "seed": seed}
    if family == "forest":
        learn = RandomForestRegressor(numTrees=parameters["trees"], featureSubsetStrategy="onethird", **shared)
    elif family == "boosted":
        learn = GBTRegressor(maxIter=parameters["trees"], stepSize=parameters["rate"], **shared)
    else:
        raise ValueError(f"family is one of {sorted(GRIDS)}, not {family!r}")
    rows = df.select(array_to_vector(F.col(x).cast("array<double>")).alias("__x"), F.col(y).cast("double").alias("__y")).where("__y IS NOT NULL")
    return Trees(learn.fit(rows), parameters)


def chosen(df: DataFrame, x: str, y: str, family: str, fold: str = "fold", grid: list[dict] | None = None, seed: int = 42) -> dict:
    """The parameters with the least mean squared error over the folds (ties: the first of the grid), fitted on all rows.

    Returns trees, parameters, rmse (root of the mean over folds) and grid: (parameters, mean squared error)."""
    if family not in GRIDS:
        raise ValueError(f"family is one of {sorted(GRIDS)}, not {family!r}")
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    if len(folds) < 2:
        raise ValueError("at least two folds are needed")
    tried = []
    for parameters in grid or GRIDS[family]:
        errors = []
        for f in folds:
            trees = grown(df.where(F.col(fold) != f), x, y, family, parameters, seed)
            judged = trees.predict(df.where((F.col(fold) == f) & F.col(y).isNotNull()), x, "__p")
            errors.append(judged.agg(F.avg((F.col("__p") - F.col(y)) ** 2)).first()[0])
        tried.append((parameters, sum(errors) / len(errors)))
    best, error = min(tried, key=lambda t: t[1])
    return {"trees": grown(df, x, y, family, best, seed), "parameters": best, "rmse": error**0.5, "grid": tried}
