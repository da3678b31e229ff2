"""Preprocessing as a checked list of steps: fitted on training rows alone, applied to all; runs of fixed matrices become one."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrel.functions import kernels, matrices
from spectrel.operators import spectral


@dataclass(frozen=True)
class Parameter:
    default: object
    least: float | None = None
    most: float | None = None
    choices: tuple = ()
    odd: bool = False

    def check(self, name: str, value: object) -> None:
        if self.choices and value not in self.choices:
            raise ValueError(f"{name}: {value!r} is none of {self.choices}")
        if isinstance(self.default, (int, float)) and not isinstance(self.default, bool):
            if not isinstance(value, (int, float)) or isinstance(value, bool) or (isinstance(self.default, int) and value != int(value)):
                raise ValueError(f"{name}: {value!r} is no {type(self.default).__name__}")
            if (self.least is not None and value < self.least) or (self.most is not None and value > self.most) or (self.odd and value % 2 == 0):
                raise ValueError(f"{name}: {value!r} is out of range")


@dataclass(frozen=True)
class Method:
    """stage: -1 repair, 0 baseline and smoothing, 1 scatter, 2 centring and scaling. Of a group at most one step may stand in a pipeline."""

    stage: int
    kind: str  # matrix, rows, native, fitted
    make: Callable
    group: str = ""
    parameters: dict[str, Parameter] = field(default_factory=dict)


_WINDOW = {"window": Parameter(11, 3, 501, odd=True), "order": Parameter(2, 0, 8)}
METHODS = {
    "despike": Method(-1, "native", lambda x, window, z: kernels.despike(x, window, z), "", {"window": Parameter(5, 3, 101, odd=True), "z": Parameter(6.0, 1, 100)}),
    "median_filter": Method(-1, "native", lambda x, window: kernels.moving_median(x, window), "", {"window": Parameter(3, 3, 101, odd=True)}),
    "sg_smooth": Method(0, "matrix", lambda p, window, order: matrices.savitzky_golay(p, window, order), "smoothing", _WINDOW),
    "whittaker_smooth": Method(0, "matrix", lambda p, smoothing: matrices.whittaker(p, smoothing), "smoothing", {"smoothing": Parameter(1e4, 0)}),
    "derivative1": Method(0, "matrix", lambda p, window, order, delta: matrices.savitzky_golay(p, window, order, 1, delta), "derivative", _WINDOW | {"delta": Parameter(1.0, 1e-12)}),
    "derivative2": Method(0, "matrix", lambda p, window, order, delta: matrices.savitzky_golay(p, window, order, 2, delta), "derivative", _WINDOW | {"delta": Parameter(1.0, 1e-12)}),
    "gap_derivative": Method(0, "native", lambda x, gap, segment: kernels.gap_derivative(x, gap, segment), "derivative", {"gap": Parameter(3, 1, 101), "segment": Parameter(5, 1, 101, odd=True)}),
    "detrend": Method(0, "matrix", lambda p, degree: matrices.detrend(np.arange(p, dtype=float), degree), "baseline", {"degree": Parameter(2, 0, 6)}),
    "asls": Method(0, "rows", lambda x, smoothing, p: spectral.asls(x, smoothing, p), "baseline", {"smoothing": Parameter(1e5, 0), "p": Parameter(0.001, 0, 1)}),
    "airpls": Method(0, "rows", lambda x, smoothing, order: spectral.airpls(x, smoothing, order), "baseline", {"smoothing": Parameter(1e7, 0), "order": Parameter(1, 1, 3)}),
    "arpls": Method(0, "rows", lambda x, smoothing, ratio: spectral.arpls(x, smoothing, ratio), "baseline", {"smoothing": Parameter(1e4, 0), "ratio": Parameter(0.01, 0, 1)}),
    "rubberband": Method(0, "rows", lambda x: spectral.rubberband(x), "baseline"),
    "snv": Method(1, "native", lambda x: kernels.snv(x), "scatter"),
    "robust_snv": Method(1, "native", lambda x, consistency: kernels.robust_snv(x, consistency), "scatter", {"consistency": Parameter(1.4826, 0)}),
    "normalize": Method(1, "native", lambda x, norm: kernels.normalize(x, norm), "scatter", {"norm": Parameter("l2", choices=("l1", "l2", "max"))}),
    "msc": Method(1, "fitted", lambda x, mean, std: kernels.msc(x, F.lit(mean)), "scatter"),
    "mean_center": Method(2, "fitted", lambda x, mean, std: kernels.center(x, F.lit(mean)), "scale"),
    "autoscale": Method(2, "fitted", lambda x, mean, std: kernels.autoscale(x, F.lit(mean), F.lit(std)), "scale"),
}

Step = tuple[str, dict]
#: Three pipelines to begin with.
DEFAULTS: tuple[tuple[Step, ...], ...] = (
    (("sg_smooth", {}), ("snv", {}), ("mean_center", {})),
    (("derivative1", {}), ("msc", {}), ("autoscale", {})),
    (("airpls", {"smoothing": 1e5}), ("snv", {}), ("mean_center", {})),
)


def catalog(spark: SparkSession) -> DataFrame:
    """A row for each parameter of each method (one row for a method without any)."""
    rows = [(name, m.stage, m.kind, m.group, p, None if v is None else str(v.default)) for name, m in sorted(METHODS.items()) for p, v in (sorted(m.parameters.items()) or [(None, None)])]
    return spark.createDataFrame(rows, "method string, stage int, kind string, exclusive string, parameter string, default_value string")


def catalog_hash() -> str:
    rows = [(name, m.stage, m.kind, m.group, sorted((k, repr(v)) for k, v in m.parameters.items())) for name, m in sorted(METHODS.items())]
    return hashlib.sha256(json.dumps(rows).encode()).hexdigest()


def checked(steps: tuple[Step, ...]) -> list[tuple[str, dict]]:
    """The steps with all parameters; unknown names, values out of range, steps out of order and clashing steps are errors."""
    out, stage, groups = [], -1, set()
    for name, given in steps:
        if name not in METHODS:
            raise ValueError(f"no method {name!r}")
        m = METHODS[name]
        if m.stage < stage:
            raise ValueError(f"{name} comes too late")
        if m.group and m.group in groups:
            raise ValueError(f"{name}: another {m.group} step stands before it")
        if unknown := given.keys() - m.parameters.keys():
            raise ValueError(f"{name} has no {sorted(unknown)}")
        values = {k: given.get(k, p.default) for k, p in m.parameters.items()}
        for k, v in values.items():
            m.parameters[k].check(f"{name}.{k}", v)
        groups.add(m.group)
        stage = m.stage
        out.append((name, values))
    return out


def pipeline_id(steps: tuple[Step, ...]) -> str:
    return hashlib.sha256(json.dumps(checked(steps), sort_keys=True).encode()).hexdigest()[:16]


@dataclass
class Fitted:
    """What fit() learned; transform() applies it to any rows."""

    steps: list[tuple[str, dict]]
    states: list[tuple[list[float], list[float]] | None]
    width: int

    def transform(self, df: DataFrame, column: str = "x", on_step: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
        """on_step sees the rows after each step; without it, neighbouring matrices are multiplied into one."""
        pending: list[np.ndarray] = []
        for (name, values), state in zip(self.steps, self.states, strict=True):
            if METHODS[name].kind == "matrix":
                pending.append(METHODS[name].make(self.width, **values))
                if on_step:
                    df, pending = spectral.linear(df, column, pending), []
            else:
                if pending:
                    df, pending = spectral.linear(df, column, pending), []
                df = _applied(df, column, name, values, state)
            if on_step:
                on_step(name, df)
        return spectral.linear(df, column, pending) if pending else df


def _applied(df: DataFrame, column: str, name: str, values: dict, state) -> DataFrame:
    m = METHODS[name]
    if m.kind == "rows":
        return spectral.map_rows(df, column, lambda x: m.make(x, **values))
    x: Column = F.col(column).cast("array<double>")
    return df.withColumn(column, m.make(x, *state) if m.kind == "fitted" else m.make(x, **values))


def fit(train: DataFrame, steps: tuple[Step, ...], column: str = "x") -> Fitted:
    """Learns each fitted step's state from the training rows as the steps before it leave them."""
    todo = checked(steps)
    first = train.select(F.size(column).alias("p")).where("p > 0").first()
    if first is None:
        raise ValueError("no training rows")
    fitted = Fitted([], [], first["p"])
    for name, values in todo:
        state = spectral.state(fitted.transform(train, column), column) if METHODS[name].kind == "fitted" else None
        fitted.steps.append((name, values))
        fitted.states.append(state)
    return fitted
