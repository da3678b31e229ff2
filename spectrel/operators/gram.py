"""One distributed cross-product per group, and what is solved from it: regression, principal components, distances.

The rows' augmented products [1, x, y]' [1, x, y] are added up within each task, in numpy, and once more by group and block of
rows; only p-sized matrices reach the driver. A fold's training matrix is the sum of the other folds'.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrel.operators.tabular import quantiles

#: Rows of the product that one (group, block) holds.
BLOCK_ROWS = 64


@dataclass
class Gram:
    """Sums of products of [1, x - shift, y - shift]."""

    product: np.ndarray
    shift: np.ndarray
    targets: int

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.product + other.product, self.shift, self.targets)

    @property
    def n(self) -> int:
        return round(self.product[0, 0])

    @property
    def mean(self) -> np.ndarray:
        return self.product[0, 1:] / self.n + self.shift

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        """X'X and X'Y about the means."""
        s = self.product[0, 1:]
        c = self.product[1:, 1:] - np.outer(s, s) / self.n
        p = len(s) - self.targets
        return c[:p, :p], c[:p, p:]


def grams(df: DataFrame, x: str, y: list[str] = (), fold: str | None = None, variants: dict | None = None) -> dict:
    """A Gram for each value of fold (None: one, under the key 0). x: an array column of fixed width.

    variants: {v: function of a batch of x as rows of an array, of the same width}; then the keys are (v, fold), v below 2^15 and fold
    from -2^15 to 2^15 - 1, all from the same pass."""
    rows = df.select((F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"), F.concat(F.col(x).cast("array<double>"), F.array(*(F.col(c).cast("double") for c in y)) if y else F.array().cast("array<double>")).alias("row"))
    first = rows.select("row").first()
    if first is None:
        return {}
    shift = np.array(first["row"])  # any row serves to keep the sums near zero
    width = len(shift) + 1
    p = width - 1 - len(y)
    schema = pa.schema([("fold", pa.int32()), ("block", pa.int32()), ("part", pa.binary())])

    def products(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.asarray(pc.list_flatten(batch.column(1))).reshape(batch.num_rows, width - 1)
            folds = batch.column(0).to_numpy()
            for v, change in (variants or {0: None}).items():
                data = raw if change is None else np.hstack([change(raw[:, :p]), raw[:, p:]])
                data = np.hstack([np.ones((len(data), 1)), data - shift])
                for f in np.unique(folds):
                    part, key = data[folds == f], int(f) if variants is None else (v << 16) + int(f) + (1 << 15)
                    sums[key] = sums.get(key, 0) + part.T @ part
        rows_ = [(f, b, m[b * BLOCK_ROWS : (b + 1) * BLOCK_ROWS].tobytes()) for f, m in sums.items() for b in range(-(-width // BLOCK_ROWS))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows_, strict=True) if rows_ else ((),) * 3, schema, strict=True)], schema=schema)

    def added(table):
        total = sum(np.frombuffer(p.as_py(), dtype=np.float64) for p in table["part"])
        return pa.table({"fold": table["fold"][:1], "block": table["block"][:1], "part": pa.array([total.tobytes()], pa.binary())}, schema=schema)

    parts = rows.mapInArrow(products, "fold int, block int, part binary").groupBy("fold", "block").applyInArrow(added, "fold int, block int, part binary").collect()
    out = {}
    for f in sorted({r["fold"] for r in parts}):
        blocks = sorted((r["block"], bytes(r["part"])) for r in parts if r["fold"] == f)
        key = f if variants is None else (f >> 16, (f & 0xFFFF) - (1 << 15))
        out[key] = Gram(np.concatenate([np.frombuffer(b, dtype=np.float64) for _, b in blocks]).reshape(width, width), shift, len(y))
    return out


def pls(gram: Gram, components: int) -> dict:
    """PLS1 from cross-products: coefficients for 1 to `components`, weights, loadings, rotations, and the scores' sums of squares."""
    xx, xy = gram.centred()
    s = xy[:, 0].copy()
    w, p, r, q, tt = [], [], [], [], []
    for _ in range(components):
        size = np.linalg.norm(s)
        if size < 1e-12:
            break
        wa = s / size
        ra = wa.copy()
        for pj, rj in zip(p, r, strict=True):
            ra -= (pj @ wa) * rj
        t = float(ra @ xx @ ra)
        if t < 1e-12:
            break
        pa_ = xx @ ra / t
        qa = float(ra @ xy[:, 0]) / t
        s = s - t * qa * pa_
        for k, v in zip((w, p, r, q, tt), (wa, pa_, ra, qa, t), strict=True):
            k.append(v)
    coefficients = [np.sum([qa * ra for qa, ra in zip(q[: k + 1], r[: k + 1], strict=True)], axis=0) for k in range(len(q))]
    means = gram.mean
    x_mean, y_mean = means[: len(s)], means[len(s)]
    return {"coefficients": coefficients, "intercepts": [float(y_mean - x_mean @ b) for b in coefficients], "weights": np.array(w), "loadings": np.array(p), "rotations": np.array(r), "y_loadings": np.array(q), "tt": np.array(tt)}


def vip(model: dict) -> np.ndarray:
    """Variable importance: sqrt(p * sum(ssy * w^2) / sum(ssy))."""
    ssy = model["y_loadings"] ** 2 * model["tt"]
    w = model["weights"]
    return np.sqrt(w.shape[1] * (ssy @ (w**2 / (w**2).sum(axis=1, keepdims=True))) / ssy.sum())


def pcr(gram: Gram, components: int) -> tuple[np.ndarray, float]:
    xx, xy = gram.centred()
    values, vectors = np.linalg.eigh(xx)
    top = np.argsort(values)[::-1][:components]
    b = vectors[:, top] @ ((vectors[:, top].T @ xy[:, 0]) / values[top])
    return b, float(gram.mean[len(b)] - gram.mean[: len(b)] @ b)


def ridge(gram: Gram, alpha: float) -> tuple[np.ndarray, float]:
    """On standardised columns."""
    xx, xy = gram.centred()
    s = np.sqrt(np.maximum(np.diag(xx) / gram.n, 1e-300))
    b = np.linalg.solve(xx / np.outer(s, s) + alpha * np.eye(len(s)), xy[:, 0] / s) / s
    return b, float(gram.mean[len(b)] - gram.mean[: len(b)] @ b)


def fold_error(gram: Gram, b: np.ndarray, intercept: float) -> float:
    """Sum of squared errors of a fold's rows, from its products alone."""
    v = np.concatenate([[intercept + gram.shift[: len(b)] @ b - gram.shift[len(b)]], b, [-1.0]])
    return float(v @ gram.product @ v)


def cross_validated(by_fold: dict, components: int) -> list[dict]:
    """RMSECV of 1 to `components`, each fold predicted from the sum of the others; folds that are too small are left out."""
    errors: dict[int, list[tuple[float, int]]] = {}
    for f, held in by_fold.items():
        rest = [g for k, g in by_fold.items() if k != f]
        if not rest:
            continue
        train = rest[0]
        for g in rest[1:]:
            train = train + g
        model = pls(train, min(components, train.n - 1))
        for k, (b, a) in enumerate(zip(model["coefficients"], model["intercepts"], strict=True), start=1):
            errors.setdefault(k, []).append((fold_error(held, b, a), held.n))
    return [{"components": k, "rmsecv": float(np.mean([np.sqrt(max(e, 0) / n) for e, n in v]))} for k, v in sorted(errors.items()) if len(v) == len(by_fold)]


def predicted(df: DataFrame, x: str, coefficients: np.ndarray, intercept: float, out: str = "prediction") -> DataFrame:
    from spectrel.functions import kernels

    return df.withColumn(out, kernels.dot(F.col(x).cast("array<double>"), F.lit([float(b) for b in coefficients])) + float(intercept))


def monitoring_reference(df: DataFrame, x: str, explained: float = 0.99, most: int = 20, quantile: float = 0.99) -> dict:
    """Principal components to the explained share, and the quantiles of the training rows' T2 and residual Q."""
    g = grams(df, x)[0]
    xx, _ = g.centred()
    values, vectors = np.linalg.eigh(xx)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    total = values.sum()
    k = int(np.searchsorted(np.cumsum(values) / total, explained) + 1) if total > 1e-15 else 1
    k = max(1, min(k, most, g.n - 1, len(values)))
    reference = {"mean": g.mean, "components": vectors[:, :k].T, "inverse": np.diag([1 / v if v > 1e-15 * total else 0.0 for v in values[:k] / (g.n - 1)])}
    both = F.array(F.struct(F.lit("q").alias("k"), F.col("q").alias("v")), F.struct(F.lit("t2").alias("k"), F.col("t2").alias("v")))
    found = quantiles(scored(df, x, reference).select(F.explode(both).alias("s")).select("s.*"), "k", "v", [quantile], hold=True)
    limits = {k: v[0] for k, v in found.items()}
    eps = float(np.finfo(float).eps)
    return reference | {"t2_limit": max(limits["t2"], eps), "q_limit": max(limits["q"], eps)}


def scored(df: DataFrame, x: str, reference: dict) -> DataFrame:
    """Adds t2 and q."""
    from spectrel.operators.spectral import map_rows

    mean, components, inverse = reference["mean"], reference["components"], reference["inverse"]

    def both(rows: np.ndarray) -> np.ndarray:
        c = rows - mean
        t = c @ components.T
        return np.column_stack([np.maximum(np.einsum("ij,jk,ik->i", t, inverse, t), 0), ((c - t @ components) ** 2).sum(axis=1)])

    return map_rows(df, x, both, "__t2q").withColumns({"t2": F.col("__t2q")[0], "q": F.col("__t2q")[1]}).drop("__t2q")


def drift(df: DataFrame, x: str, reference: dict) -> DataFrame:
    """Adds t2, q and flagged (either over its limit)."""
    return scored(df, x, reference).withColumn("flagged", (F.col("t2") > float(reference["t2_limit"])) | (F.col("q") > float(reference["q_limit"])))


def mahalanobis(df: DataFrame, x: str, fitted: Gram, out: str = "distance") -> DataFrame:
    """Distance from the fitted mean by the pseudo-inverse covariance."""
    from spectrel.operators.spectral import map_rows

    xx, _ = fitted.centred()
    inverse, mean = np.linalg.pinv(xx / max(1, fitted.n - 1)), fitted.mean[: len(xx)]
    return map_rows(df, x, lambda rows: np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", rows - mean, inverse, rows - mean), 0))[:, None], "__d").withColumn(out, F.col("__d")[0]).drop("__d")


def transfer_map(paired: DataFrame, source: str, target: str, ridge_share: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Direct standardisation: (matrix, offset) that turn target rows into source rows, by least squares over pairs."""
    both = paired.select(F.concat(F.col(target).cast("array<double>"), F.col(source).cast("array<double>")).alias("__both"))
    g = grams(both, "__both")[0]
    c, _ = g.centred()
    p = len(c) // 2
    a = c[:p, :p]
    m = np.linalg.solve(a + ridge_share * np.trace(a) / p * np.eye(p), c[:p, p:])
    return m, g.mean[p:] - g.mean[:p] @ m
