"""Kernels that are a fixed matrix: y = M x for every row. Matrices of consecutive steps multiply into one before any row is read."""

from __future__ import annotations

from functools import reduce

import numpy as np


def savitzky_golay(p: int, window: int = 11, order: int = 2, derivative: int = 0, delta: float = 1.0) -> np.ndarray:
    """Local polynomials over `window` points; the ends are read from the first and the last window's polynomial."""
    if window % 2 == 0 or window > p or order >= window:
        raise ValueError("the window must be odd, no longer than the row, and longer than the order")
    half, out = window // 2, np.zeros((p, p))
    basis = np.vander(np.arange(window) - half, order + 1, increasing=True)
    fit = np.linalg.pinv(basis)
    for i in range(p):
        start = min(max(i - half, 0), p - window)
        at = i - start - half
        powers = np.array([0.0 if k < derivative else float(np.prod(np.arange(k - derivative + 1, k + 1))) * float(at) ** (k - derivative) for k in range(order + 1)])
        out[i, start : start + window] = powers @ fit / delta**derivative
    return out


def whittaker(p: int, smoothing: float = 1e4) -> np.ndarray:
    d = np.diff(np.eye(p), 2, axis=0)
    return np.linalg.inv(np.eye(p) + smoothing * d.T @ d)


def detrend(axis: np.ndarray, degree: int = 2) -> np.ndarray:
    """What is left of a polynomial fit on the standardised axis."""
    t = (axis - axis.mean()) / (axis.std() or 1.0)
    a = np.vander(t, degree + 1, increasing=True)
    return np.eye(len(axis)) - a @ np.linalg.pinv(a)


def linear_resample(source: np.ndarray, target: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """Linear interpolation of a row on `source` at `target`; descending axes are turned, targets beyond the source are an error."""
    order = np.argsort(source)
    s = source[order]
    if target.min() < s[0] - tolerance or target.max() > s[-1] + tolerance:
        raise ValueError("the target axis reaches beyond the source axis")
    right = np.clip(np.searchsorted(s, target), 1, len(s) - 1)
    share = np.clip((target - s[right - 1]) / (s[right] - s[right - 1]), 0, 1)
    out = np.zeros((len(target), len(source)))
    rows = np.arange(len(target))
    out[rows, order[right - 1]] += 1 - share
    out[rows, order[right]] += share
    return out


def emsc_parts(reference: np.ndarray, axis: np.ndarray, degree: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(pseudo-inverse, design) of [1, reference, t, t^2, ...] for extended scatter correction."""
    t = 2 * (axis - axis.min()) / ((axis.max() - axis.min()) or 1.0) - 1
    design = np.column_stack([np.ones_like(t), reference, *(t**k for k in range(1, degree + 1))])
    return np.linalg.pinv(design), design


def fused(steps: list[np.ndarray]) -> np.ndarray:
    """One matrix for steps applied first to last."""
    return reduce(lambda done, m: m @ done, steps)
