"""Array kernels over rows of spectra that need matrices or iterations: Arrow batches in, Arrow batches out, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrel.functions import matrices


def map_rows(df: DataFrame, column: str, f: Callable[[np.ndarray], np.ndarray], out: str | None = None) -> DataFrame:
    """Applies f to the (rows, p) matrix of each Arrow batch of an ARRAY<DOUBLE> column; null rows stay null."""
    out = out or column
    columns = [c for c in df.columns if c != out]
    source = df.select(*columns, F.col(column).cast("array<double>").alias("__x"))

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            known = [k for k in range(batch.num_rows) if lists[k].is_valid]
            result: list = [None] * batch.num_rows
            by_length: dict[int, list[int]] = {}
            for k in known:
                by_length.setdefault(len(lists[k]), []).append(k)
            for rows in by_length.values():
                y = f(np.array([lists[k].as_py() for k in rows], dtype=np.float64))
                for k, row in zip(rows, y, strict=True):
                    result[k] = row
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(result, pa.list_(pa.float64()))], names=[*columns, out])

    kinds = ", ".join(f"`{f_.name}` {f_.dataType.simpleString()}" for f_ in source.schema.fields[:-1])
    return source.mapInArrow(run, (kinds + ", " if kinds else "") + f"`{out}` array<double>")


def linear(df: DataFrame, column: str, steps: list[np.ndarray], out: str | None = None) -> DataFrame:
    """Consecutive fixed matrices as one product."""
    m = matrices.fused(steps).T
    return map_rows(df, column, lambda x: x @ m, out)


def emsc(df: DataFrame, column: str, reference: np.ndarray, axis: np.ndarray, degree: int = 2, least: float = 1e-12) -> DataFrame:
    inverse, design = matrices.emsc_parts(reference, axis, degree)

    def corrected(x: np.ndarray) -> np.ndarray:
        c = x @ inverse.T
        if (np.abs(c[:, 1]) < least).any():
            raise ValueError("a row has no part of the reference")
        c1 = c[:, 1:2].copy()
        c[:, 1] = 0
        return (x - c @ design.T) / c1

    return map_rows(df, column, corrected)


#: Entries of the matrices that a task solves at once (8 MB).
MATRIX_ENTRIES = 1 << 20


def _baselines(x: np.ndarray, weights: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Each row has a matrix of its own; as many are built at once as MATRIX_ENTRIES hold."""
    size = max(1, MATRIX_ENTRIES // max(1, x.shape[1]) ** 2)
    out, at = np.empty_like(x), np.arange(x.shape[1])
    for a in range(0, len(x), size):
        w = weights[a : a + size]
        systems = np.repeat(penalty[None], len(w), axis=0)
        systems[:, at, at] += w
        out[a : a + size] = np.linalg.solve(systems, (w * x[a : a + size])[:, :, None])[:, :, 0]
    return out


def _penalty(p: int, smoothing: float, order: int) -> np.ndarray:
    d = np.diff(np.eye(p), order, axis=0)
    return smoothing * d.T @ d


def asls(x: np.ndarray, smoothing: float = 1e5, p: float = 0.001, rounds: int = 10) -> np.ndarray:
    """Asymmetric least squares: rows without their baseline."""
    w, d = np.ones_like(x), _penalty(x.shape[1], smoothing, 2)
    for _ in range(rounds):
        z = _baselines(x, w, d)
        w = np.where(x > z, p, 1 - p)
    return x - z


def airpls(x: np.ndarray, smoothing: float = 1e7, order: int = 1, rounds: int = 100) -> np.ndarray:
    """Adaptive iteratively reweighted penalised least squares; a row stops when its negative residuals are small."""
    w, d, z = np.ones_like(x), _penalty(x.shape[1], smoothing, order), np.zeros_like(x)
    live = np.arange(len(x))
    for k in range(1, rounds + 1):
        z[live] = _baselines(x[live], w[live], d)
        r = x[live] - z[live]
        negative = np.abs(np.where(r < 0, r, 0).sum(axis=1))
        live, r, negative = (a[negative >= 1e-3 * np.abs(x[live]).sum(axis=1)] for a in (live, r, negative))
        if not len(live):
            break
        w[live] = np.where(r >= 0, 0, np.exp(np.minimum(k * np.abs(r) / np.maximum(negative, 1e-300)[:, None], 50)))
        edge = np.exp(np.minimum(k * np.where(r < 0, np.abs(r), 0).max(axis=1) / np.maximum(negative, 1e-300), 50))
        w[live, 0] = w[live, -1] = edge
    return x - z


def arpls(x: np.ndarray, smoothing: float = 1e4, ratio: float = 0.01, rounds: int = 100) -> np.ndarray:
    """Asymmetrically reweighted penalised least squares."""
    w, d, z = np.ones_like(x), _penalty(x.shape[1], smoothing, 2), np.zeros_like(x)
    live = np.arange(len(x))
    for _ in range(rounds):
        z[live] = _baselines(x[live], w[live], d)
        r = x[live] - z[live]
        low = np.where(r < 0, r, np.nan)
        with np.errstate(all="ignore"):
            m, s = np.nan_to_num(np.nanmean(low, axis=1)), np.maximum(np.nan_to_num(np.nanstd(low, axis=1)), 1e-12)
        new = 1 / (1 + np.exp(np.clip(2 * (r - (2 * s - m)[:, None]) / s[:, None], -50, 50)))
        going = np.linalg.norm(w[live] - new, axis=1) / np.linalg.norm(w[live], axis=1) >= ratio
        w[live] = new
        live = live[going]
        if not len(live):
            break
    return x - z


def rubberband(x: np.ndarray) -> np.ndarray:
    """Rows above their lower convex hull."""
    out = np.empty_like(x)
    at = np.arange(x.shape[1])
    for k, row in enumerate(x):
        hull: list[int] = []
        for i in at:
            while len(hull) > 1 and (row[hull[-1]] - row[hull[-2]]) * (i - hull[-2]) >= (row[i] - row[hull[-2]]) * (hull[-1] - hull[-2]):
                hull.pop()
            hull.append(int(i))
        out[k] = row - np.interp(at, hull, row[hull])
    return out


def column_statistics(df: DataFrame, column: str) -> DataFrame:
    """pos, n, mean, std (ddof 0), min, max of each position."""
    each = df.select(F.posexplode(F.col(column).cast("array<double>")).alias("pos", "v"))
    return each.groupBy("pos").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def state(df: DataFrame, column: str) -> tuple[list[float], list[float]]:
    """Mean and standard deviation of each position; the row's width bounds what reaches the driver."""
    rows = column_statistics(df, column).select("pos", "mean", "std").orderBy("pos").collect()
    return [r["mean"] for r in rows], [r["std"] for r in rows]


def transposed(df: DataFrame, sample: str, column: str, block: int = 4096) -> DataFrame:
    """Samples in columns: the rows of position i hold it for every sample, in order of the sample's name, in blocks of at most `block` samples
    (pos, block from 0, values), so that no row grows with the number of samples."""
    from spectrel.operators.tabular import ranked

    placed = ranked(df.select(F.col(sample).alias("s"), F.col(column)), ["s"], "__rank")
    cells = placed.select(F.col("__rank").alias("k"), F.expr(f"__rank div {block}").alias("block"), F.posexplode(column).alias("pos", "v"))
    return cells.groupBy("pos", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda c: c["v"]).alias(column))
