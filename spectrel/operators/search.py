"""Searches over preprocessing pipelines and model families without leakage, from cross-products of folds.

Rows carry a fold: 0 and up for calibration, VALIDATION for rows that no search sees. A pipeline's steps up to its first fitted one
are the same for every fold, so their products by fold come from one pass, and what a fold trains on is a sum. Of the fitted steps,
centring changes nothing in a model that centres; scaling is read off the training product itself; scatter correction needs the mean
of the training rows, so a second pass corrects each row once for every training set and adds up products by (training set, fold).
No row, step or model of a fold is ever fitted on the rows that it is judged by.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrel.operators import pipeline, splits
from spectrel.operators.gram import Gram, fold_error, grams, pcr, pls, ridge
from spectrel.operators.selection import ALPHAS, L1_RATIOS, _in_units, elastic_net, summed

VALIDATION = -1
#: How far a candidate may be above the least error and still win by being simpler.
MATERIAL = 1.01


def cv_folds(df: DataFrame, id_: str, k: int = 5, group: str | None = None, seed: int = 42) -> DataFrame:
    """Adds fold, 0 to k - 1, by a digest of the id, or of the group, which then stays whole; a null group is one of its own id."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    key = F.col(id_).cast("string") if group is None else F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.concat(F.lit("i"), F.col(id_).cast("string")))
    return splits.folds(df.withColumn("__key", key), "__key", k, seed).drop("__key")


def fold_manifest(df: DataFrame, id_: str, fold: str = "fold") -> dict:
    """What the folds are: rows and a digest of each, whatever the rows' order, and an id of the whole."""
    parts = splits_digest(df, id_, fold).collect()  # a row for each fold
    body = {"scope": "calibration_cv", "folds": [{"fold": r["fold"], "n": r["n"], "digest": r["digest"]} for r in sorted(parts, key=lambda r: r["fold"])]}
    return body | {"manifest_id": "cv_" + hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}


def splits_digest(df: DataFrame, id_: str, fold: str) -> DataFrame:
    from spectrel.operators.records import partition_manifest

    return partition_manifest(df.select(F.col(id_).alias("id"), F.col(fold).alias("fold")), "id", "fold", 1).select("fold", "n", "digest")


def refuse_leaks(df: DataFrame, x: str, fold: str = "fold") -> None:
    """Raises ValueError where equal spectra stand in two folds."""
    if leaks := splits.leaks(df.select(F.col(fold).cast("string").alias("role"), x), "role", [x]).agg(F.sum("n")).first()[0]:
        raise ValueError(f"{leaks} spectra stand in more than one fold; give groups that hold equal spectra together")


def _parts(steps) -> tuple[list, list[str]]:
    """The steps that are the same for every fold, and the names of the fitted ones behind them."""
    todo = pipeline.checked(steps)
    at = next((i for i, (name, _) in enumerate(todo) if pipeline.METHODS[name].kind == "fitted"), len(todo))
    if any(pipeline.METHODS[name].kind != "fitted" for name, _ in todo[at:]):
        raise ValueError("steps behind a fitted step must be fitted ones")
    return todo[:at], [name for name, _ in todo[at:]]


def _corrected(reference: np.ndarray):
    """Scatter correction of rows by a reference, as kernels.msc."""
    centred = reference - reference.mean()

    def correct(rows: np.ndarray) -> np.ndarray:
        slope = rows @ centred / (centred @ centred)
        flat = slope == 0
        out = (rows - (rows.mean(axis=1) - slope * reference.mean())[:, None]) / np.where(flat, 1.0, slope)[:, None]
        return np.where(flat[:, None], reference, out)

    return correct


def _scaled(train: Gram, held: Gram) -> tuple[Gram, Gram]:
    """Both with every position in units of its spread over the training rows; constant positions become 0."""
    p = len(train.shift) - train.targets
    spread = np.sqrt(np.maximum(np.diag(train.centred()[0]) / train.n, 0))
    factor = np.where(spread > 1e-12, 1 / np.where(spread > 1e-12, spread, 1.0), 0.0)
    size = np.concatenate([[1.0], factor, np.ones(train.targets)])
    return tuple(Gram(g.product * np.outer(size, size), g.shift * np.concatenate([factor, np.ones(train.targets)]), g.targets) for g in (train, held)) if p else (train, held)


def cross_products(df: DataFrame, x: str, y: str, candidates: list, fold: str = "fold") -> list[dict]:
    """For each candidate pipeline {fold: (training Gram, held-out Gram)}; under VALIDATION all calibration rows and the validation rows.
    Candidates that begin with the same steps share their passes."""
    first = df.select(F.size(x).alias("p")).where("p > 0").first()
    if first is None:
        raise ValueError("no rows")
    passes: dict[str, tuple] = {}
    out = []
    for steps in candidates:
        prefix, fitted = _parts(steps)
        key = json.dumps(prefix, sort_keys=True)
        if key not in passes:
            rows = pipeline.Fitted(prefix, [None] * len(prefix), first["p"]).transform(df, x).select(fold, x, y)
            passes[key] = rows, grams(rows, x, [y], fold), {}
        rows, plain, corrected = passes[key]
        inner = sorted(f for f in plain if f != VALIDATION)
        if len(inner) < 2:
            raise ValueError("at least two calibration folds are needed")
        sets = {f: [g for g in inner if g != f] for f in inner} | {VALIDATION: inner}
        if "msc" in fitted and not corrected:
            means = {f: summed(plain[g] for g in train).mean[: first["p"]] for f, train in sets.items()}
            corrected |= grams(rows, x, [y], fold, {f + 1: _corrected(m) for f, m in means.items()})
        pairs = {}
        for f, train in sets.items():
            of = (lambda g, f=f: corrected[f + 1, g]) if "msc" in fitted else plain.__getitem__
            held = of(f) if f in plain else Gram(np.zeros_like(plain[inner[0]].product), plain[inner[0]].shift, 1)
            pair = summed(of(g) for g in train), held
            pairs[f] = _scaled(*pair) if "autoscale" in fitted else pair
        out.append(pairs)
    return out


def _models(train: Gram, family: str, grid) -> dict:
    """{parameters: (coefficients, intercept)} of a family over its grid."""
    if family == "pls":
        found = pls(train, max(grid))
        return {k: (b, a) for k, (b, a) in enumerate(zip(found["coefficients"], found["intercepts"], strict=True), start=1) if k in grid}
    if family == "pcr":
        return {k: pcr(train, k) for k in grid}
    if family == "ridge":
        return {alpha: ridge(train, alpha) for alpha in grid}
    out = {}
    for ratio in sorted({r for _, r in grid}):
        w = None
        for alpha in sorted({a for a, r in grid if r == ratio}, reverse=True):
            w = elastic_net(train, alpha, ratio, w)
            out[alpha, ratio] = _in_units(train, w)
    return out


def _grid(family: str, upper: int) -> list:
    if family in ("pls", "pcr"):
        return list(range(1, upper + 1))
    if family == "ridge":
        return list(ALPHAS)
    if family in ("lasso", "elastic_net"):
        return [(a, r) for a in ALPHAS for r in ((1.0,) if family == "lasso" else L1_RATIOS)]
    raise ValueError(f"no family {family!r}")


def _scores(held: Gram, b: np.ndarray, a: float) -> tuple[float, float]:
    """Root mean squared error and R2 of held-out rows."""
    if not held.n:
        return float("nan"), float("nan")
    error, y = max(0.0, fold_error(held, b, a)), held.product[-1, -1] - held.product[0, -1] ** 2 / held.n
    return float(np.sqrt(error / held.n)), float(1 - error / y) if y > 0 else 0.0


def evaluated(pairs: dict, family: str = "pls", most: int = 20, by: str = "rmse", grid: list | None = None) -> dict:
    """Chooses a family's parameters by the mean over the calibration folds (by: least rmse or greatest r2; ties: the first of the grid),
    fits them on all calibration rows and looks once at the validation rows.

    Returns parameters, cv_rmse, cv_r2, val_rmse, val_r2, coefficients, intercept and trials: (parameters, cv_rmse, cv_r2)."""
    if by not in ("rmse", "r2"):
        raise ValueError("by is rmse or r2")
    inner = [f for f in pairs if f != VALIDATION]
    p = len(pairs[inner[0]][0].shift) - 1
    upper = max(1, min(most, p, min(pairs[f][0].n for f in inner) - 1))
    grid = [g for g in (grid or _grid(family, upper)) if family not in ("pls", "pcr") or g <= upper]
    found: dict = {}
    for f in inner:
        if not pairs[f][1].n:
            continue
        for parameters, model in _models(pairs[f][0], family, grid).items():
            found.setdefault(parameters, []).append(_scores(pairs[f][1], *model))
    trials = [(g, float(np.mean([r for r, _ in found[g]])), float(np.mean([q for _, q in found[g]]))) for g in grid if g in found]
    if not trials:
        raise ValueError("no parameters could be fitted")
    best = min(trials, key=lambda t: t[1]) if by == "rmse" else max(trials, key=lambda t: t[2])
    train, held = pairs[VALIDATION]
    models = _models(train, family, [best[0]] if family in ("pcr", "ridge") else grid)
    b, a = models[best[0]]
    rmse, r2 = _scores(held, b, a)
    return {"parameters": best[0], "cv_rmse": best[1], "cv_r2": best[2], "val_rmse": rmse, "val_r2": r2, "coefficients": b, "intercept": a, "trials": trials}


def simplicity(steps) -> tuple[int, int, int, str]:
    """Fewer steps, then fewer parameters given, then fewer fitted steps, then the id: the order among candidates that are as good."""
    return len(steps), sum(len(given) for _, given in steps), sum(pipeline.METHODS[name].kind == "fitted" for name, _ in steps), pipeline.pipeline_id(steps)


def nested(df: DataFrame, x: str, y: str, candidates: list, fold: str = "fold", families: tuple[str, ...] = ("pls",), most: int = 20, rule: str = "one_percent") -> dict:
    """Every candidate pipeline with every family, and the winner.

    rule: one_percent takes the simplest candidate within one percent of the least cross-validated error (then the family that is named
    first); combined takes the greatest 0.7 cv_r2 + 0.3 val_r2, parameters being chosen by r2. Returns winner (index of evaluations),
    eligible (ids) and evaluations: pipeline_id, steps, family and what evaluated() gives, with score."""
    if rule not in ("one_percent", "combined"):
        raise ValueError("rule is one_percent or combined")
    evaluations = []
    for steps, pairs in zip(candidates, cross_products(df, x, y, candidates, fold), strict=True):
        for family in families:
            found = evaluated(pairs, family, most, "rmse" if rule == "one_percent" else "r2")
            score = 0.7 * found["cv_r2"] + 0.3 * (found["val_r2"] if found["val_r2"] == found["val_r2"] else 0.0)
            evaluations.append({"pipeline_id": pipeline.pipeline_id(steps), "steps": steps, "family": family, "score": score} | found)
    order = range(len(evaluations))
    if rule == "combined":
        winner = max(order, key=lambda i: evaluations[i]["score"])
        eligible = [winner]
    else:
        least = min(e["cv_rmse"] for e in evaluations)
        eligible = [i for i in order if evaluations[i]["cv_rmse"] <= MATERIAL * least]
        winner = min(eligible, key=lambda i: (simplicity(evaluations[i]["steps"]), families.index(evaluations[i]["family"])))
    return {"winner": winner, "eligible": [evaluations[i]["pipeline_id"] for i in eligible], "evaluations": evaluations}
