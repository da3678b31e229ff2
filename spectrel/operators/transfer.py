"""Calibration transfer between two instruments: spectra of a target instrument turned into those of the source instrument.

The same samples measured on both give pairs. One pass over the pairs gives the cross-products of both spectra together, and every
method is solved from those: one global map, a local partial least squares for each position, or the alignment of a few joint
components. What is fitted is one matrix and an offset, so a transfer applies in one Arrow pass and is kept as one JSON row.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrel.functions import matrices
from spectrel.operators.gram import Gram, grams, pls
from spectrel.operators.spectral import map_rows
from spectrel.operators.splits import shuffle_key
from spectrel.operators.tabular import ranked

#: Method: (what it does, its parameters and their defaults).
METHODS = {
    "global": ("one linear map of all positions", {"ridge_share": 1e-10}),
    "piecewise": ("a local partial least squares for each position, over a window around it", {"half_window": 25, "components": 2, "scale": True}),
    "joint_space": ("alignment of the leading components of both spectra side by side", {"components": 2, "with_mean": True, "with_std": False}),
}


def paired(source: DataFrame, target: DataFrame, id_: str, x: str) -> DataFrame:
    """id, source, target of samples measured on both instruments. Ids are compared without blanks around them. Raises ValueError
    where an id is null or empty, stands twice on one instrument, or is missing on the other; nothing is dropped silently."""
    sides = [df.select(F.trim(F.coalesce(F.col(id_).cast("string"), F.lit(""))).alias("id"), F.col(x).alias("x"), F.lit(side).alias("side")) for side, df in enumerate((source, target))]
    both = sides[0].unionByName(sides[1]).groupBy("id").agg(*(F.sum((F.col("side") == k).cast("long")).alias(f"n{k}") for k in (0, 1)))
    sums = both.agg(*(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in {
        "without an id": F.col("id") == "", "twice on one instrument": (F.col("n0") > 1) | (F.col("n1") > 1), "missing on the target": F.col("n1") == 0, "missing on the source": F.col("n0") == 0,
    }.items())).first().asDict()
    if wrong := {k: v for k, v in sums.items() if v}:
        raise ValueError("samples cannot be paired: " + ", ".join(f"{v} ids {k}" for k, v in wrong.items()))
    return sides[0].select("id", F.col("x").alias("source")).join(sides[1].select("id", F.col("x").alias("target")), "id")


def pair_roles(pairs: DataFrame, id_: str = "id", validation: float = 0.25, seed: int = 42) -> DataFrame:
    """Adds role, train or validation: one exact split that keeps pairs together. At least 8 pairs, 4 of them for training."""
    n = pairs.count()
    if n < 8 or not 0.1 <= validation <= 0.5:
        raise ValueError(f"a transfer needs at least 8 pairs and a validation share from 0.1 to 0.5, not {n} and {validation}")
    held = max(2, round(n * validation))
    placed = ranked(pairs.withColumn("__key", shuffle_key(id_, seed)), ["__key", id_], "__place")
    return placed.withColumn("role", F.when(F.col("__place") < held, "validation").otherwise("train")).drop("__key", "__place")


def _blocks(joint: Gram) -> tuple:
    """Cross-products about the means of target and source, and both means."""
    c, _ = joint.centred()
    p = len(c) // 2
    return c, p, joint.mean[:p], joint.mean[p:]


def solved(joint: Gram, method: str, **given) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, offset) of a method from the cross-products of [target, source]: source is about target @ matrix + offset."""
    if method not in METHODS:
        raise ValueError(f"method is one of {sorted(METHODS)}, not {method!r}")
    options = METHODS[method][1]
    if unknown := sorted(set(given) - set(options)):
        raise ValueError(f"{method} has no parameters {unknown}")
    options = options | given
    for name in ("half_window", "components"):
        if name in options and (isinstance(options[name], bool) or not isinstance(options[name], int) or options[name] < 1):
            raise ValueError(f"{name} is a whole number, 1 or more")
    c, p, target, source = _blocks(joint)
    if method == "global":
        a = c[:p, :p]
        m = np.linalg.solve(a + options["ridge_share"] * max(np.trace(a), 1e-300) / p * np.eye(p), c[:p, p:])
        return m, source - target @ m
    if method == "piecewise":
        m = np.zeros((p, p))
        for i in range(p):
            window = np.arange(max(0, i - options["half_window"]), min(p, i + options["half_window"] + 1))
            at = np.append(window, p + i)
            local = c[np.ix_(at, at)]
            size = np.sqrt(np.maximum(np.diag(local) / (joint.n - 1), 0)) if options["scale"] else np.ones(len(at))
            size = np.where(size > 1e-12, size, 1.0)
            product = np.zeros((len(at) + 1, len(at) + 1))
            product[0, 0], product[1:, 1:] = joint.n, local / np.outer(size, size)
            found = pls(Gram(product, np.zeros(len(at)), 1), min(options["components"], len(window), joint.n - 1))["coefficients"]
            if found:
                m[window, i] = found[-1] * size[-1] / size[:-1]
        return m, source - target @ m
    size = np.sqrt(np.maximum(np.diag(c) / (joint.n - 1), 0)) if options["with_std"] else np.ones(2 * p)
    size = np.where(size > 1e-12, size, 1.0)
    if not options["with_mean"]:
        both = np.concatenate([target, source])
        c = c + joint.n * np.outer(both, both)
        target, source = np.zeros(p), np.zeros(p)
    _, vectors = np.linalg.eigh(c / np.outer(size, size))
    loadings = vectors[:, ::-1][:, : min(options["components"], 2 * p, joint.n)].T
    own, other = loadings[:, :p], loadings[:, p:]
    m = (np.eye(p) + np.linalg.pinv(own) @ (other - own)) * size[p:] / size[:p, None]
    return m, source - target @ m


@dataclass
class Transfer:
    """A fitted transfer, with what it was fitted on."""

    method: str
    source_instrument: str
    target_instrument: str
    source_axis: list[float]
    target_axis: list[float]
    parameters: dict = field(default_factory=dict)
    n_pairs: int = 0
    pairs_digest: str = ""
    matrix: np.ndarray | None = None
    offset: np.ndarray | None = None

    def __post_init__(self):
        if not self.source_instrument.strip() or not self.target_instrument.strip() or self.source_instrument == self.target_instrument:
            raise ValueError("two different instruments are needed")

    def _aligned(self) -> np.ndarray | None:
        """The matrix that reads target spectra at the source's positions, None where both have the same."""
        if self.source_axis == self.target_axis:
            return None
        return matrices.linear_resample(np.array(self.target_axis), np.array(self.source_axis))

    def fit(self, pairs: DataFrame, source: str = "source", target: str = "target", id_: str = "id") -> Transfer:
        """From pairs of spectra; where the axes differ, target spectra are first read at the source's positions (never beyond theirs)."""
        align = self._aligned()
        rows = pairs if align is None else map_rows(pairs, target, lambda t: t @ align.T)
        found = grams(rows.select(F.concat(F.col(target).cast("array<double>"), F.col(source).cast("array<double>")).alias("both")), "both")
        if not found or found[0].n < 2 or len(found[0].shift) != 2 * len(self.source_axis):
            raise ValueError("at least two pairs of spectra are needed, each as long as its axis")
        self.matrix, self.offset = solved(found[0], self.method, **self.parameters)
        self.n_pairs = found[0].n
        row = F.xxhash64(F.col(id_).cast("string"), F.col(source).cast("array<double>"), F.col(target).cast("array<double>"))
        sums = pairs.agg(F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x")).first()
        self.pairs_digest = hashlib.sha256(f"{self.n_pairs}|{sums['s']}|{sums['x']}".encode()).hexdigest()
        return self

    def transform(self, df: DataFrame, x: str, axis: list[float], instrument: str | None = None, out: str | None = None) -> DataFrame:
        if self.matrix is None:
            raise ValueError("the transfer is not fitted")
        if list(axis) != list(self.target_axis) or (instrument is not None and instrument.strip() != self.target_instrument):
            raise ValueError("the transfer was fitted for another instrument or other positions")
        align = self._aligned()
        m = self.matrix if align is None else align.T @ self.matrix
        offset = self.offset
        return map_rows(df, x, lambda rows: rows @ m + offset, out or x)

    def manifest(self) -> dict:
        digest = lambda axis: hashlib.sha256(np.asarray(axis, dtype="<f8").tobytes()).hexdigest()
        return {
            "method": self.method, "direction": f"{self.target_instrument}_to_{self.source_instrument}", "source_instrument": self.source_instrument, "target_instrument": self.target_instrument,
            "parameters": METHODS[self.method][1] | self.parameters, "n_pairs": self.n_pairs, "pairs_digest": self.pairs_digest, "source_axis_digest": digest(self.source_axis),
            "target_axis_digest": digest(self.target_axis), "aligned": self.source_axis != self.target_axis,
        }

    def save(self, spark: SparkSession, folder: str) -> None:
        kept = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()}
        spark.createDataFrame([(json.dumps(kept),)], "transfer string").write.parquet(folder)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Transfer:
        kept = json.loads(spark.read.parquet(folder).first()["transfer"])
        return Transfer(**kept | {k: None if kept[k] is None else np.array(kept[k]) for k in ("matrix", "offset")})


def agreement(df: DataFrame, truth: str, before: str, after: str) -> DataFrame:
    """How far `before` and `after` agree with `truth`, numbers or arrays of them: stage (before, after), n, rmse, bias, slope, r2,
    improvement_percent (of the rmse; 0 before). Where the truth does not vary, slope and r2 are 0."""
    names = (truth, before, after)
    if dict(df.dtypes)[truth].startswith("array"):
        rows = df.select(F.explode(F.arrays_zip(*(F.col(c).alias(c) for c in names))).alias("v")).select(*(F.col(f"v.{c}").cast("double").alias(k) for c, k in zip(names, "tba", strict=True)))
    else:
        rows = df.select(*(F.col(c).cast("double").alias(k) for c, k in zip(names, "tba", strict=True)))
    rows = rows.where("t IS NOT NULL AND b IS NOT NULL AND a IS NOT NULL")
    figures = [F.count(F.lit(1)).alias("n"), F.var_pop("t").alias("spread")]
    for k in "ba":
        figures += [F.sqrt(F.avg((F.col(k) - F.col("t")) ** 2)).alias(f"rmse_{k}"), F.avg(F.col(k) - F.col("t")).alias(f"bias_{k}"), F.covar_pop("t", k).alias(f"with_{k}")]
    one = rows.agg(*figures)

    def stage(name, k):
        r2 = 1 - F.col(f"rmse_{k}") ** 2 / F.col("spread")
        better = F.lit(0.0) if k == "b" else F.when(F.col("rmse_b") > 0, 100 * (F.col("rmse_b") - F.col("rmse_a")) / F.col("rmse_b")).otherwise(0.0)
        varies = F.col("spread") > 0
        return F.struct(F.lit(name).alias("stage"), F.col("n"), F.col(f"rmse_{k}").alias("rmse"), F.col(f"bias_{k}").alias("bias"), F.when(varies, F.col(f"with_{k}") / F.col("spread")).otherwise(0.0).alias("slope"), F.when(varies, r2).otherwise(0.0).alias("r2"), better.alias("improvement_percent"))

    return one.select(F.explode(F.array(stage("before", "b"), stage("after", "a"))).alias("s")).select("s.*")
