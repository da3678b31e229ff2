"""Row kernels over ARRAY<DOUBLE> columns as built-in expressions: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def std(x: Column) -> Column:
    """Population standard deviation of an array."""
    return F.transform(F.array(mean(x)), lambda m: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.size(x)))[0]


def with_value(value: Column, use) -> Column:
    """Bind value once as a lambda variable, so that it isn't computed again for each element."""
    return F.transform(F.array(value), use)[0]


def snv(x: Column) -> Column:
    """Standard normal variate: (x - mean) / std with ddof 0; a constant row gives zeros."""
    return with_value(F.struct(mean(x).alias("m"), std(x).alias("s")), lambda p: F.transform(x, lambda v: F.when(p["s"] == 0, F.lit(0.0)).otherwise((v - p["m"]) / p["s"])))


def median(x: Column) -> Column:
    """Middle of the sorted values, or the mean of the middle two."""
    return with_value(F.array_sort(x), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)


def robust_snv(x: Column, consistency: float = 1.4826) -> Column:
    """(x - median) / (consistency * MAD); the standard deviation where the MAD is 0, zeros where both are."""
    mad = lambda m: median(F.transform(x, lambda v: F.abs(v - m)))
    scale = lambda m: F.when(mad(m) * consistency > 0, mad(m) * consistency).otherwise(std(x))
    parts = with_value(median(x), lambda m: F.struct(m.alias("m"), scale(m).alias("s")))
    return with_value(parts, lambda p: F.transform(x, lambda v: F.when(p["s"] == 0, F.lit(0.0)).otherwise((v - p["m"]) / p["s"])))


def rnv(x: Column, percentile: float = 25.0, epsilon: float = 1e-10) -> Column:
    """Robust normal variate: less the percentile (linear between neighbours), over the deviation of the values up to it."""

    def scaled(ordered: Column) -> Column:
        place = (F.size(ordered) - 1) * (percentile / 100)
        low, high = F.get(ordered, F.floor(place).cast("int")), F.get(ordered, F.ceil(place).cast("int"))
        return with_value(low + (high - low) * (place - F.floor(place)), lambda p: with_value(std(F.filter(x, lambda v: v <= p)) + epsilon, lambda d: F.transform(x, lambda v: (v - p) / d)))

    return with_value(F.array_sort(x), scaled)


def norm(x: Column, kind: str = "l2") -> Column:
    if kind == "l1":
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + F.abs(v))
    if kind == "l2":
        return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    if kind == "max":
        return F.array_max(F.transform(x, F.abs))
    raise ValueError(f"l1, l2 or max, not {kind}")


def normalize(x: Column, kind: str = "l2") -> Column:
    """x over its norm; a zero norm gives zeros."""
    return with_value(norm(x, kind), lambda n: F.transform(x, lambda v: F.when(n == 0, F.lit(0.0)).otherwise(v / n)))


def moving_median(x: Column, window: int = 3) -> Column:
    """Median over `window` neighbours; the ends are repeated outwards."""
    half = window // 2
    padded = F.concat(F.array_repeat(x[0], half), x, F.array_repeat(F.element_at(x, -1), half))
    return with_value(padded, lambda p: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: median(F.slice(p, i, F.lit(window)))))


def despike(x: Column, window: int = 5, z: float = 6.0) -> Column:
    """Values whose residual from the local median stands out from the others' are replaced by that median."""

    def repaired(local: Column) -> Column:
        residual = F.zip_with(x, local, lambda v, m: v - m)

        def with_residual(r: Column) -> Column:
            centre = median(r)
            mad = with_value(centre, lambda c: median(F.transform(r, lambda v: F.abs(v - c))))
            limit = z * F.greatest(1.4826 * mad, 0.1 * std(r), 1e-3 * (F.array_max(x) - F.array_min(x)))
            p = F.struct(centre.alias("c"), limit.alias("l"))
            return with_value(p, lambda q: F.zip_with(F.arrays_zip(x.alias("v"), local.alias("m")), r, lambda both, d: F.when(F.abs(d - q["c"]) > q["l"], both["m"]).otherwise(both["v"])))

        return with_value(residual, with_residual)

    return with_value(moving_median(x, window), repaired)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def center(x: Column, mu: Column) -> Column:
    return F.zip_with(x, mu, lambda v, m: v - m)


def autoscale(x: Column, mu: Column, sigma: Column) -> Column:
    """(x - mu) / sigma; positions with sigma 0 give 0."""
    return F.zip_with(center(x, mu), sigma, lambda v, s: F.when(s == 0, F.lit(0.0)).otherwise(v / s))


def msc(x: Column, reference: Column) -> Column:
    """Multiplicative scatter correction: least squares x = a + b * reference, then (x - a) / b; the reference where b is 0."""
    centred = F.transform(reference, lambda r: r - mean(reference))
    slope = with_value(centred, lambda c: dot(x, c) / dot(c, c))
    return with_value(F.struct(slope.alias("b"), mean(x).alias("mx"), mean(reference).alias("mr")), lambda p: F.when(p["b"] == 0, reference).otherwise(F.transform(x, lambda v: (v - (p["mx"] - p["b"] * p["mr"])) / p["b"])))


def band(x: Column, axis: Column, low: float, high: float) -> Column:
    """The values whose axis coordinate lies in [low, high]."""
    return F.transform(F.filter(F.arrays_zip(x.alias("v"), axis.alias("w")), lambda p: (p["w"] >= low) & (p["w"] <= high)), lambda p: p["v"])


def pick(x: Column, indices: list[int]) -> Column:
    return F.transform(F.lit(indices), lambda i: F.get(x, i))


def differences(x: Column) -> Column:
    return F.zip_with(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), lambda b, a: b - a)


def axis_direction(axis: Column) -> Column:
    """missing, invalid, single_point, ascending, descending, duplicate_values or non_monotonic."""
    bad = F.exists(axis, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        F.when(axis.isNull() | (F.size(axis) == 0), "missing").when(bad, "invalid").when(F.size(axis) == 1, "single_point")
        .when(F.forall(differences(axis), lambda d: d > 0), "ascending").when(F.forall(differences(axis), lambda d: d < 0), "descending")
        .when(F.exists(differences(axis), lambda d: d == 0), "duplicate_values").otherwise("non_monotonic")
    )


def gap_derivative(x: Column, gap: int = 3, segment: int = 5, delta: float = 1.0) -> Column:
    """First gap-segment derivative: moving mean over `segment`, then differences over 2 * gap; ends take their neighbours' value."""
    half = segment // 2
    smooth = F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: mean(F.slice(x, F.greatest(i - half + 1, F.lit(1)), F.least(i + half, F.size(x) - 1) - F.greatest(i - half, F.lit(0)) + 1)))
    return with_value(smooth, lambda s: F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: with_value(F.least(F.greatest(i, F.lit(gap)), F.size(x) - 1 - gap), lambda k: (F.get(s, (k + gap).cast("int")) - F.get(s, (k - gap).cast("int"))) / (2 * gap * delta))))
