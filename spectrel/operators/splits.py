"""Exact, reproducible splits. Order comes from md5(seed | id), which any engine can repeat."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrel.operators.tabular import ranked, running


def shuffle_key(id_: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_).cast("string")))


def three_way(df: DataFrame, id_: str, test: float = 0.2, validation: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds role: exact counts, floor(test * n) test rows, then floor(validation * rest) validation rows."""
    n = df.count()
    n_test = int(n * test)
    n_validation = int((n - n_test) * validation)
    placed = ranked(df.withColumn("__key", shuffle_key(id_, seed)), ["__key", id_], "__place")
    role = F.when(F.col("__place") < n_test, "test").when(F.col("__place") < n_test + n_validation, "validation").otherwise("train")
    return placed.withColumn("role", role).drop("__key", "__place")


def stratified(df: DataFrame, id_: str, label: str, test: float = 0.2, validation: float = 0.2, seed: int = 42) -> DataFrame:
    """The same within each class."""
    w = Window.partitionBy(label)
    placed = df.withColumns({"__n": F.count(F.lit(1)).over(w), "__place": F.row_number().over(w.orderBy(shuffle_key(id_, seed), id_)) - 1})
    n_test = F.floor(F.col("__n") * test)
    n_validation = F.floor((F.col("__n") - n_test) * validation)
    role = F.when(F.col("__place") < n_test, "test").when(F.col("__place") < n_test + n_validation, "validation").otherwise("train")
    return placed.withColumn("role", role).drop("__n", "__place")


def target_stratified(df: DataFrame, id_: str, target: str, pattern: list[str], block: int = 20, seed: int = 42) -> DataFrame:
    """Rows in order of the target, in blocks; within each block roles follow the pattern in shuffled order."""
    placed = ranked(df, [target, id_], "__place").withColumn("__block", F.floor(F.col("__place") / block))
    within = F.row_number().over(Window.partitionBy("__block").orderBy(shuffle_key(id_, seed), id_)) - 1
    return placed.withColumn("role", F.get(F.lit(pattern), (within % len(pattern)).cast("int"))).drop("__place", "__block")


def by_group(df: DataFrame, group: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Whole groups: in shuffled order, groups go to test while that brings its size no further from the target than before."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).withColumn("__key", F.md5(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string"))))
    total = df.count()
    placed = running(sizes, ["__key", group], F.col("__n"), "__before")
    chosen = placed.select(group, F.when(F.col("__before") + F.col("__n") / 2 <= test * total, "test").otherwise("train").alias("role"))
    return df.join(chosen, group)


def folds(df: DataFrame, id_: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold, 0 to k - 1, by the shuffle key alone."""
    return df.withColumn("fold", F.pmod(F.conv(F.substring(shuffle_key(id_, seed), 1, 15), 16, 10).cast("long"), F.lit(k)).cast("int"))


def straddling_groups(df: DataFrame, group: str, role: str) -> DataFrame:
    """Groups that stand in more than one role."""
    return df.groupBy(group).agg(F.count_distinct(role).alias("n_roles")).where("n_roles > 1")


def row_digest(columns: list[str]) -> Column:
    """A 256-bit digest of a row's values."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def leaks(df: DataFrame, role: str, columns: list[str]) -> DataFrame:
    """Pairs of roles that share equal rows, and how many distinct rows they share."""
    seen = df.select(role, row_digest(columns).alias("digest")).distinct()
    a, b = seen.select(F.col(role).alias("role_a"), "digest"), seen.select(F.col(role).alias("role_b"), "digest")
    return a.join(b, "digest").where("role_a < role_b").groupBy("role_a", "role_b").agg(F.count(F.lit(1)).alias("n"))


def duplicate_groups(df: DataFrame, columns: list[str], target: str, tolerance: float = 1e-9) -> DataFrame:
    """Groups of equal rows: digest, n, conflicting (their targets differ)."""
    return df.groupBy(row_digest(columns).alias("digest")).agg(F.count(F.lit(1)).alias("n"), (F.max(target) - F.min(target) > tolerance).alias("conflicting")).where("n > 1")


def three_counts(n: int, tuning: float, test: float) -> tuple[int, int, int]:
    """Exact counts of calibration, tuning and test rows; at least 6 rows, 3 of them for calibration."""
    if not (0 < tuning < 1 and 0 < test < 1 and tuning + test < 1):
        raise ValueError("tuning and test are shares, together below 1")
    wanted = max(1, round(n * tuning)), max(1, round(n * test))
    if n < 6 or n - sum(wanted) < 3:
        raise ValueError(f"{n} rows are too few for these shares")
    return n - sum(wanted), *wanted


def dealt(counts: tuple[int, ...]) -> np.ndarray:
    """Which part each place of an order goes to, so that the parts fill evenly: the part that is furthest behind its share is next."""
    total, given = sum(counts), np.zeros(len(counts), dtype=int)
    sizes, out = np.array(counts), np.zeros(total, dtype=int)
    for place in range(total):
        behind = np.where(given < sizes, sizes * ((place + 1) / total) - given, -np.inf)
        out[place] = int(behind.argmax())
        given[out[place]] += 1
    return out


ROLES = ("calibration", "tuning", "test")


def joint_maximin_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """An order that spreads over spectra and target: the farthest two rows first, then always the row farthest from those taken.

    Distance: the spectra's (each position in units of its spread) plus the target's, each as a share of its largest. Ties: the
    first row. Distances come by blocks of rows, so that memory stays at a few rows' worth beside the square of them."""
    n = len(y)
    spread = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(spread < 1e-12, 1.0, spread)
    apart = np.empty((n, n))
    for a in range(0, n, 64):
        apart[a : a + 64] = np.sqrt(((z[a : a + 64, None] - z[None]) ** 2).sum(axis=2))
    target = np.abs(y[:, None] - y[None])
    joint = apart / (apart.max() or 1.0) + target / (target.max() or 1.0)
    np.fill_diagonal(joint, -np.inf)
    first, second = divmod(int(joint.argmax()), n) if n > 1 else (0, 0)
    order, nearest = [first, second][: min(n, 2)], np.minimum(joint[first], joint[second])
    while len(order) < n:
        nearest[order] = -np.inf
        order.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, joint[order[-1]])
    return np.array(order[:n])


def spxy(df: DataFrame, group: str, id_: str, x: str, y: str, tuning: float = 0.2, test: float = 0.2, most: int = 500, beyond: str = "refuse", seed: int = 42) -> DataFrame:
    """Adds role (calibration, tuning, test) by the joint maximin order within each group, rows in order of id.

    Distances grow with the square of a group, so groups of more than `most` rows are refused (ValueError), or with
    beyond="target_stratified" dealt, all together, along their sorted target in shuffled blocks of 20, without distances. Groups of
    too few rows for three parts are refused as well. Groups are counted before any row is shuffled.
    """
    if beyond not in ("refuse", "target_stratified"):
        raise ValueError("beyond is refuse or target_stratified")
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    least = next(n for n in range(6, 1_000_000) if _fits(n, tuning, test))
    few, many = sizes.agg(F.min("__n"), F.max("__n")).first()
    if few is not None and few < least:
        raise ValueError(f"a group has {few} rows, at least {least} are needed")
    if many is not None and many > most and beyond == "refuse":
        raise ValueError(f"a group has {many} rows; more than {most} are not split by distances")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, role string"

    def split(rows):
        rows = rows.sort_values(id_, kind="stable")
        order = joint_maximin_order(np.stack(rows[x].to_numpy()).astype(float), rows[y].to_numpy(dtype=float))
        part = np.empty(len(rows), dtype=int)
        part[order] = dealt(three_counts(len(rows), tuning, test))
        return rows.assign(role=np.array(ROLES)[part])

    if many is None or many <= most:
        return df.groupBy(group).applyInPandas(split, schema)
    counted = df.join(sizes, [group]) if not df.schema[group].nullable else df.join(sizes.withColumnRenamed(group, "__group"), F.col(group).eqNullSafe(F.col("__group"))).drop("__group")
    small = counted.where(F.col("__n") <= most).drop("__n").select(*df.columns).groupBy(group).applyInPandas(split, schema)
    block = [*np.array(ROLES)[dealt(three_counts(20, tuning, test))]]
    large = target_stratified(counted.where(F.col("__n") > most).drop("__n").select(*df.columns), id_, y, block, 20, seed)
    return small.unionByName(large)


def _fits(n: int, tuning: float, test: float) -> bool:
    try:
        return bool(three_counts(n, tuning, test))
    except ValueError as e:
        if "shares, together" in str(e):
            raise
        return False
