"""Choice of positions (wavelengths) and of penalties, from the cross-products of a few blocks of rows.

The rows are dealt into blocks by a digest of their id, and one pass gives a Gram for each block (`gram.grams`). A resample is a set
of blocks, so its Gram is a sum; a fold is one too; a choice of positions is a part of a Gram. So searches over hundreds of
candidates read the rows once. The driver holds one Gram for each block: blocks * p * p numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrel.operators.gram import Gram, fold_error, pls, ridge

#: The grids that are searched unless others are given.
ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
L1_RATIOS = (0.1, 0.3, 0.5, 0.7, 0.9)


def summed(parts) -> Gram:
    parts = list(parts)
    return Gram(sum(g.product for g in parts), parts[0].shift, parts[0].targets)


def part_of(gram: Gram, positions) -> Gram:
    """The Gram of some positions and all targets."""
    p = len(gram.shift) - gram.targets
    at = np.concatenate([np.asarray(positions, dtype=int), np.arange(p, p + gram.targets)])
    rows = np.concatenate([[0], at + 1])
    return Gram(gram.product[np.ix_(rows, rows)], gram.shift[at], gram.targets)


def _folded(by_block: dict, folds: int) -> list[tuple[Gram, Gram]]:
    """(training, held out) of each fold; a fold is every `folds`-th block."""
    blocks = [by_block[b] for b in sorted(by_block)]
    folds = max(2, min(folds, len(blocks)))
    total, out = summed(blocks), []
    for f in range(folds):
        held = summed(blocks[f::folds])
        out.append((Gram(total.product - held.product, total.shift, total.targets), held))
    return out


def _components(positions: int, n: int, most: int) -> int:
    return max(1, min(most, n - 1, positions))


def pls_error(folded: list[tuple[Gram, Gram]], positions, most: int = 10) -> float:
    """Mean over the folds of the root mean squared error of a PLS on some positions; infinite where no fold can be fitted."""
    n = folded[0][0].n + folded[0][1].n
    k, errors = _components(len(positions), n, most), []
    for train, held in folded:
        if train.n <= k or not held.n:
            continue
        model = pls(part_of(train, positions), k)
        if model["coefficients"]:
            errors.append(np.sqrt(max(0.0, fold_error(part_of(held, positions), model["coefficients"][-1], model["intercepts"][-1])) / held.n))
    return float(np.mean(errors)) if errors else float("inf")


def cars(by_block: dict, samples: int = 50, folds: int = 5, seed: int = 42, most: int = 10) -> dict:
    """Competitive adaptive reweighted sampling of positions.

    Weights are the sizes of the PLS coefficients over all rows and over `samples` resamples of 80 % of the blocks. The number kept falls
    exponentially from all positions to two; each time that many are drawn with probability by squared weight, and the draw with
    the least cross-validated error wins. All positions are kept unless a draw is better. Returns selected, error, full_error, weights.
    """
    if samples < 2 or len(by_block) < 3:
        raise ValueError("cars needs at least 2 samples and 3 blocks")
    blocks, random = [by_block[b] for b in sorted(by_block)], np.random.default_rng(seed)
    total = summed(blocks)
    p = len(total.shift) - total.targets
    k = _components(p, total.n, most)

    def sizes(gram):
        found = pls(gram, min(k, max(1, gram.n - 1)))["coefficients"]
        return np.abs(found[-1]) if found else np.zeros(p)

    weights = sizes(total)
    drawn = max(2, round(0.8 * len(blocks)))
    for _ in range(samples):
        weights = weights + sizes(summed(blocks[b] for b in random.choice(len(blocks), drawn, replace=False)))
    everything = list(range(p))
    folded = _folded(by_block, folds)
    full = pls_error(folded, everything, most)
    best, error, seen = everything, full, {tuple(everything)}
    squares = weights**2
    if squares.any():
        squares = squares + np.finfo(float).eps * max(squares.max(), 1.0)
        last = 2 / p
        for i in range(samples):
            share = min(1.0, max(last, float(np.exp(np.log(last) * i / (samples - 1)))))
            kept = min(p, max(1, int(np.ceil(share * p))))
            draw = tuple(sorted(random.choice(p, kept, replace=False, p=squares / squares.sum()).tolist()))
            if draw in seen:
                continue
            seen.add(draw)
            if (e := pls_error(folded, draw, most)) < error:
                best, error = list(draw), e
    return {"selected": best, "error": error, "full_error": full, "weights": weights}


def projections(gram: Gram, most: int) -> np.ndarray:
    """For each position as the start, the order in which successive projections take `most` positions: the next is the one of which most
    is left when what is taken is projected out. A Cholesky factorisation with pivots of the products of unit columns, all starts at once."""
    p = len(gram.shift) - gram.targets
    x, s, sums = gram.product[1 : p + 1, 1 : p + 1], gram.shift[:p], gram.product[0, 1 : p + 1]
    raw = x + np.outer(s, sums) + np.outer(sums, s) + gram.product[0, 0] * np.outer(s, s)
    size = np.sqrt(np.maximum(np.diag(raw), 0))
    unit = raw / np.outer(np.where(size > 0, size, 1), np.where(size > 0, size, 1))
    orders = np.zeros((p, most), dtype=int)
    for begin in range(0, p, 256):
        starts = np.arange(begin, min(p, begin + 256))
        left = np.tile(np.diag(unit), (len(starts), 1))
        factors = np.zeros((len(starts), most, p))
        taken = np.zeros((len(starts), p), dtype=bool)
        row, pick = np.arange(len(starts)), starts
        for k in range(most):
            if k:
                pick = np.where(taken, -np.inf, left).argmax(axis=1)
            orders[starts, k] = pick
            taken[row, pick] = True
            rest = unit[pick] - np.einsum("sk,skp->sp", factors[row, :k, pick], factors[:, :k])
            scale = np.sqrt(np.maximum(left[row, pick], 0))
            factors[:, k] = np.where(scale[:, None] > 1e-9, rest / np.maximum(scale, 1e-9)[:, None], 0)
            left = np.maximum(left - factors[:, k] ** 2, 0)
    return orders


def press(df: DataFrame, x: str, y: str, gram: Gram, candidates: list) -> np.ndarray:
    """The sum of squared leave-one-out errors of a least-squares fit on each candidate's positions, by the leverages, in one pass."""
    shift, p = gram.shift, len(gram.shift) - gram.targets
    models = []
    for positions in candidates:
        part = part_of(gram, positions)
        m = len(positions) + 1
        values, vectors = np.linalg.eigh(part.product[:m, :m])
        good = values > values.max() * 1e-13
        root = vectors[:, good] / np.sqrt(values[good])
        models.append((np.asarray(positions, dtype=int), root, root @ (root.T @ part.product[:m, m])))

    def errors(batches):
        total = np.zeros(len(models))
        for batch in batches:
            if not batch.num_rows:
                continue
            data = np.asarray(pc.list_flatten(batch.column(0))).reshape(batch.num_rows, p) - shift[:p]
            target = batch.column(1).to_numpy() - shift[p]
            for i, (positions, root, b) in enumerate(models):
                rows = np.hstack([np.ones((len(data), 1)), data[:, positions]])
                rest = 1 - ((rows @ root) ** 2).sum(axis=1)
                total[i] += (((target - rows @ b) / np.where(np.abs(rest) < 1e-10, 1e-10, rest)) ** 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(models)), pa.int32()), pa.array(total)], names=["candidate", "press"])

    rows = df.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"))
    found = rows.mapInArrow(errors, "candidate int, press double").groupBy("candidate").agg(F.sum("press").alias("press")).collect()  # a row for each candidate
    out = np.zeros(len(candidates))
    for r in found:
        out[r["candidate"]] = r["press"]
    return out


def successive_projections(df: DataFrame, x: str, y: str, gram: Gram, least: int = 1, most: int | None = None) -> dict:
    """Positions by successive projections: of all starts and sizes, the choice with the least leave-one-out error. gram: of the same rows.

    Returns selected (sorted), error, candidates (how many were compared). Constant positions start no choice; if all are, all stay."""
    p = len(gram.shift) - gram.targets
    if not 1 <= least <= p or gram.n < 2:
        raise ValueError(f"successive projections need two rows and between 1 and {p} positions")
    most = min(p, max(least, most if most is not None else min(10, max(3, p // 3))))
    spread = np.diag(gram.centred()[0])
    starts = np.flatnonzero(spread > 1e-12 * max(float(spread.max()), 1e-300))
    if not len(starts):
        return {"selected": list(range(p)), "error": float("inf"), "candidates": 0}
    orders = projections(gram, most)
    sets = list(dict.fromkeys(tuple(sorted(orders[s, :k].tolist())) for s in starts for k in range(least, most + 1)))
    errors = np.sqrt(press(df, x, y, gram, sets) / gram.n)
    best = int(np.argmin(errors))
    return {"selected": list(sets[best]), "error": float(errors[best]), "candidates": len(sets)}


def elastic_net(gram: Gram, alpha: float, l1_ratio: float, start: np.ndarray | None = None, tolerance: float = 1e-9, sweeps: int = 5000) -> np.ndarray:
    """The minimiser w, on standardised columns z, of |y - z w|^2 / 2n + alpha (l1_ratio |w|_1 + (1 - l1_ratio) |w|^2 / 2), by coordinate
    descent on the cross-products with soft thresholds. After each sweep the positions in use are solved for at once, and w goes
    there, or as far as no sign changes; so collinear positions take few sweeps. It ends when the conditions of optimality hold.
    start: where to begin, such as the solution of a larger alpha."""
    xx, xy = gram.centred()
    n, s = gram.n, _scales(gram)
    a, b = xx / n / np.outer(s, s), xy[:, 0] / n / s
    w = np.zeros(len(b)) if start is None else start.copy()
    diagonal, bound, over = np.diag(a), alpha * l1_ratio, alpha * (1 - l1_ratio)
    limit = tolerance * max(1e-300, float(np.abs(b).max()))
    usable = np.flatnonzero(diagonal > 1e-14)
    slope = b - a @ w
    for _ in range(sweeps):
        for j in usable:
            c = slope[j] + diagonal[j] * w[j]
            new = np.sign(c) * max(abs(c) - bound, 0.0) / (diagonal[j] + over)
            if step := new - w[j]:
                slope -= step * a[j]
                w[j] = new
        used = np.flatnonzero(w)
        if len(used):
            sign = np.sign(w[used])
            goal = np.linalg.lstsq(a[np.ix_(used, used)] + over * np.eye(len(used)), b[used] - bound * sign, rcond=1e-12)[0]
            turns = goal * sign < 0
            part = min(1.0, float((w[used] / np.where(turns, w[used] - goal, 1.0))[turns].min())) if turns.any() else 1.0
            moved = w[used] + part * (goal - w[used])
            w[used] = np.where(moved * sign > 0, moved, 0.0)
        slope = b - a @ w
        rest = np.where(w != 0, np.abs(slope - over * w - bound * np.sign(w)), np.maximum(np.abs(slope) - bound, 0))
        if rest[usable].max(initial=0.0) <= limit:
            break
    return w


def _scales(gram: Gram) -> np.ndarray:
    s = np.sqrt(np.maximum(np.diag(gram.centred()[0]) / gram.n, 0))
    return np.where(s > 1e-12, s, 1.0)


def _in_units(gram: Gram, w: np.ndarray) -> tuple[np.ndarray, float]:
    b = w / _scales(gram)
    return b, float(gram.mean[len(b)] - gram.mean[: len(b)] @ b)


def penalised(by_fold: dict, kind: str = "elastic_net", alphas=ALPHAS, l1_ratios=L1_RATIOS) -> dict:
    """A penalised regression whose penalties have the least mean squared error over the folds (ties: the first of the grid).

    kind: ridge, lasso or elastic_net. Each fold goes down the path of penalties from its own Gram, each solution starting at the
    last. Returns alpha, l1_ratio (None for ridge), coefficients, intercept (over all rows) and grid: (alpha, l1_ratio, error)."""
    if kind not in ("ridge", "lasso", "elastic_net"):
        raise ValueError(f"kind is ridge, lasso or elastic_net, not {kind!r}")
    if len(by_fold) < 2:
        raise ValueError("at least two folds are needed")
    ratios = {"ridge": (None,), "lasso": (1.0,), "elastic_net": tuple(l1_ratios)}[kind]
    total = summed(by_fold.values())

    def path(gram, l1_ratio):
        w, out = None, {}
        for alpha in sorted(alphas, reverse=True):
            if l1_ratio is None:
                out[alpha] = ridge(gram, alpha)
            else:
                w = elastic_net(gram, alpha, l1_ratio, w)
                out[alpha] = _in_units(gram, w)
        return out

    errors: dict[tuple, list[float]] = {}
    for held in by_fold.values():
        train = Gram(total.product - held.product, total.shift, total.targets)
        for ratio in ratios:
            for alpha, (b, a) in path(train, ratio).items():
                errors.setdefault((alpha, ratio), []).append(max(0.0, fold_error(held, b, a)) / held.n)
    grid = [(alpha, ratio, float(np.mean(errors[alpha, ratio]))) for alpha in alphas for ratio in ratios]
    alpha, ratio, _ = min(grid, key=lambda g: g[2])
    coefficients, intercept = path(total, ratio)[alpha]
    return {"alpha": alpha, "l1_ratio": ratio, "coefficients": coefficients, "intercept": intercept, "grid": grid}
