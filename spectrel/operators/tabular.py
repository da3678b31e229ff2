"""Profiles, summaries, paging, ranking and upserts over any table."""

from __future__ import annotations

import re
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, NUMERIC)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def inspect(df: DataFrame) -> DataFrame:
    """A row for each column: name, type, rows, non_null; one pass over the table."""
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(df[f.name]).alias(f"c{k}") for k, f in enumerate(df.schema)))
    cells = F.array(*(F.struct(F.lit(k).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"c{k}").alias("non_null")) for k, f in enumerate(df.schema)))
    return counted.select("rows", F.explode(cells).alias("c")).select("c.*", "rows")


def numeric_summary(df: DataFrame) -> DataFrame:
    """A row for each numeric column: count, mean, sample standard deviation, minimum, quartiles, maximum, nulls."""
    names = [f.name for f in df.schema if is_numeric(f)]
    stack = F.explode(F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(n).cast("double").alias("v")) for n in names))).alias("s")
    cells = df.select(stack).select("s.*")
    found = quantiles(cells, "column_name", "v", [0.25, 0.5, 0.75])
    at = F.create_map(*(x for n in names for x in (F.lit(n), F.array(*(F.lit(v).cast("double") for v in found.get(n, [None] * 3))))))
    out = cells.groupBy("column_name").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), (F.count(F.lit(1)) - F.count("v")).alias("nulls"),
    )
    quarter = lambda k: F.element_at(at, F.col("column_name"))[k]
    return out.withColumns({"q25": quarter(0), "median": quarter(1), "q75": quarter(2)})


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """column_name, value, n of each value of text columns, nulls too."""
    stack = F.explode(F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(n).cast("string").alias("value")) for n in columns))).alias("s")
    return df.select(stack).select("s.*").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def categorical_summary(df: DataFrame, *columns: str) -> DataFrame:
    """A row for each column: count, distinct values, mode (ties: the first by order), nulls."""
    counts = value_counts(df, *columns)
    known = F.col("value").isNotNull()
    return counts.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("count"), F.count("value").alias("distinct_values"),
        F.min_by("value", F.when(known, F.struct(-F.col("n"), F.col("value")))).alias("mode"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nulls"),
    )


def most_frequent(counts: DataFrame, key: str, k: int) -> DataFrame:
    """Of counts (key, value, n), the k largest n of each key, by value where they tie, with rank: first of each of 64 parts of a key's
    values, then of these."""
    order = [F.desc("n"), "value"]
    parts = Window.partitionBy(key, F.pmod(F.xxhash64("value"), F.lit(64))).orderBy(*order)
    some = counts.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def top_values(df: DataFrame, *columns: str, k: int = 5) -> DataFrame:
    """The k most frequent values of each column with their share in percent."""
    counts = value_counts(df, *columns).where("value IS NOT NULL")
    total = counts.groupBy("column_name").agg(F.sum("n").alias("total"))  # a row for each column
    return most_frequent(counts, "column_name", k).join(F.broadcast(total), "column_name").withColumn("percent", 100.0 * F.col("n") / F.col("total")).drop("total")


def folded_counts(df: DataFrame, column: str, keep: int = 12, other: str = "other") -> DataFrame:
    """Class bars: the `keep` most frequent values, all others as one."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.lit(1))
    kept = F.broadcast(most_frequent(counts, "key", keep).select(F.col("value").alias("kept"), F.lit(True).alias("is_kept")))  # keep rows
    named = counts.join(kept, counts["value"].eqNullSafe(kept["kept"]), "left")
    return named.select(F.when(F.col("is_kept"), F.col("value")).otherwise(other).alias("value"), "n").groupBy("value").agg(F.sum("n").alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin, low, high, n of equal-width bins between minimum and maximum; the last holds its upper edge."""
    limits = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) / width)))
    found = df.where(F.col(column).isNotNull()).join(F.broadcast(limits)).groupBy(at.cast("int").alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return found.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def page_after(df: DataFrame, seq: str, after: int, limit: int) -> DataFrame:
    """The next `limit` rows in order, behind a cursor."""
    return df.where(F.col(seq) > after).orderBy(seq).limit(limit)


def page_before(df: DataFrame, seq: str, before: int, limit: int) -> DataFrame:
    """The last `limit` rows before a cursor, in ascending order."""
    return df.where(F.col(seq) < before).orderBy(F.desc(seq)).limit(limit).orderBy(seq)


def has_more(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first `limit` rows, each with whether more rows follow them."""
    page = df.orderBy(*order).limit(limit + 1)
    position, total = F.row_number().over(Window.orderBy(*order)), F.count(F.lit(1)).over(Window.partitionBy())
    return page.withColumns({"position": position, "has_more": total > limit}).where(F.col("position") <= limit)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder (spark.checkpoint.dir) and read from there: computed once, and kept if executors are lost. Where no
    folder is set, a single machine gets one of its own."""
    context = df.sparkSession.sparkContext
    if not (context.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None)):
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spectrel-"))
    return df.checkpoint()


#: Rows of a range, about, and the fewest for which another range is opened while there are few.
RANGE_ROWS, LEAST_RANGE_ROWS, FEW_RANGES = 1_000_000, 20_000, 32


def in_ranges(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Adds __range, the number of the range of the whole order that a row is in, and __tie, the order among rows that tie in all columns.

    Rows that tie are dealt over ranges too, so that a frequent value is not one range. The ranges are written once, so whatever reads
    them meets the same. parts: as many ranges, else by the number of rows."""
    if parts is None:
        n = df.count()
        parts = max(1, min(FEW_RANGES, -(-n // LEAST_RANGE_ROWS)), -(-n // RANGE_ROWS))
    dealt = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "__tie")
    return cut(dealt.withColumn("__range", F.spark_partition_id()))


def running(df: DataFrame, order: list[str], value, name: str, parts: int | None = None) -> DataFrame:
    """Adds the sum of `value` over all earlier rows in the whole order, without one task for all: ranges are summed apart and joined to
    their offsets, one row for each range. Rows that tie in all order columns stand in any order among themselves."""
    dealt = in_ranges(df, order, parts).withColumn("__range_value", value)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("__range").agg(F.sum("__range_value").alias("__range_n"))
    offsets = offsets.select("__range", F.coalesce(F.sum("__range_n").over(before(Window.orderBy("__range"))), F.lit(0)).alias("__range_before"))
    within = F.coalesce(F.sum("__range_value").over(before(Window.partitionBy("__range").orderBy(*order, "__tie"))), F.lit(0))
    placed = dealt.withColumn("__range_within", within).join(F.broadcast(offsets), "__range")
    return placed.withColumn(name, F.col("__range_before") + F.col("__range_within")).drop("__range", "__tie", "__range_value", "__range_within", "__range_before")


def ranked(df: DataFrame, order: list[str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """Adds each row's place from 0 in the whole order. Rows that tie in all order columns stand in any order among themselves."""
    return running(df, order, F.lit(1).cast("long"), name, parts)


#: Bins of each span of values in which a quantile is looked for, and how many different values are fetched at last.
BINS, FETCHED = 512, 100_000


def quantiles(df: DataFrame, key: str, value: str, shares: list[float], hold: bool = False) -> dict:
    """{key: [quantile of each share]}, exact, linear between neighbours, for few keys (columns). NaN counts as the largest value.

    Nothing is sorted or shuffled but counts: the span that holds a wanted place is cut into bins, the bin that holds it is the next
    span, until the spans hold few values, which are fetched with their counts. Equal values are one count however many they are.
    hold: keep the values between the passes, where they are dear to compute."""
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    rows = rows.persist() if hold else rows
    v, inf = F.col("v"), float("inf")
    finite = ~F.isnan("v") & (F.abs("v") < inf)
    counted = rows.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v == -inf).alias("low"), F.count_if(v == inf).alias("high"), F.count_if(finite).alias("finite"), F.min(F.when(finite, v)).alias("a"), F.max(F.when(finite, v)).alias("b"),
    ).collect()  # a row for each key
    wanted, found, spans = {}, {}, {}
    for r in counted:
        wanted[r["k"]] = [(int(share * (r["n"] - 1)), min(r["n"] - 1, int(share * (r["n"] - 1)) + 1), share * (r["n"] - 1) % 1) for share in shares]
        for place in {p for low, high, _ in wanted[r["k"]] for p in (low, high)}:
            inside = place - r["low"]
            if 0 <= inside < r["finite"]:
                spans.setdefault((r["k"], r["a"], r["b"], r["finite"]), []).append((place, inside))
            else:
                found[r["k"], place] = -inf if inside < 0 else inf if inside < r["finite"] + r["high"] else float("nan")
    rows, kind = rows.where(finite), rows.schema["k"].dataType.simpleString()
    while True:
        for k, a, b, n in [s for s in spans if s[1] == s[2]]:
            found |= {(k, place): a for place, _ in spans.pop((k, a, b, n))}
        if not spans:
            break
        numbered = list(spans)
        few = sum(n for *_, n in numbered) <= FETCHED
        # halves where the width of a span is beyond the largest number
        table = [(i, k, a, b, 1.0 if b - a < inf else 0.5) for i, (k, a, b, _) in enumerate(numbered)]
        table = df.sparkSession.createDataFrame(table, f"i int, sk {kind}, a double, b double, s double")
        met = rows.join(F.broadcast(table), (F.col("k") == F.col("sk")) & F.col("v").between(F.col("a"), F.col("b")))  # a row for each span
        bin_ = v if few else F.least(F.floor((v * F.col("s") - F.col("a") * F.col("s")) / (F.col("b") * F.col("s") - F.col("a") * F.col("s")) * BINS), F.lit(BINS - 1))
        bins = met.groupBy("i", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()  # BINS rows for each span, or FETCHED
        before, narrower = dict.fromkeys(range(len(numbered)), 0), {}
        for r in sorted(bins, key=lambda r: (r["i"], r["bin"])):
            k = numbered[r["i"]][0]
            for place, inside in spans[numbered[r["i"]]]:
                if 0 <= inside - before[r["i"]] < r["n"]:
                    narrower.setdefault((k, r["a"], r["b"], r["n"]), []).append((place, inside - before[r["i"]]))
            before[r["i"]] += r["n"]
        spans = narrower
    if hold:
        rows.unpersist()
    between = lambda low, high, part: low + (high - low) * part if part and low != high else low
    return {k: [between(found[k, low], found[k, high], part) for low, high, part in ps] for k, ps in wanted.items()}


def evenly_spaced(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """At most k rows at evenly spaced places of the order, first and last among them."""
    n = df.count()
    places = sorted({round(i * (n - 1) / (k - 1)) for i in range(k)}) if n > k > 1 else list(range(min(n, max(k, 1))))
    return ranked(df, order, "place").where(F.col("place").isin(places))


def envelope(points: DataFrame, key: str, x: str, y: str, most: int = 700) -> DataFrame:
    """Decimates each key's curve to at most `most` points: of each bucket of places those of smallest and largest y stay."""
    w = Window.partitionBy(key)
    placed = points.withColumns({"place": F.row_number().over(w.orderBy(x)) - 1, "n": F.count(F.lit(1)).over(w)})
    bucket = F.when(F.col("n") <= most, F.col("place")).otherwise(F.floor(F.col("place") * (most // 2) / F.col("n")))
    ends = placed.groupBy(key, bucket.alias("bucket")).agg(F.min_by(F.struct(x, y), F.struct(y, x)).alias("low"), F.max_by(F.struct(x, y), F.struct(F.col(y), -F.col(x))).alias("high"))
    return ends.select(key, F.explode(F.array_distinct(F.array("low", "high"))).alias("p")).select(key, f"p.{x}", f"p.{y}")


def islands(df: DataFrame, key: str, position: str) -> DataFrame:
    """Runs of consecutive positions of each key: first, last, n."""
    w = Window.partitionBy(key).orderBy(position)
    return df.select(key, position).distinct().withColumn("island", F.col(position) - F.row_number().over(w)).groupBy(key, "island").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("n")).drop("island")


def within_budget(df: DataFrame, key: str, order: list, cost: str, budget: int) -> DataFrame:
    """Each key's longest prefix in order whose costs add up to no more than the budget."""
    running = F.sum(cost).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("used", running).where(F.col("used") <= budget)


def top_per_group(df: DataFrame, group: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Upsert: of the rows of a key the first in order stays."""
    return top_per_group(df, keys, order, 1, "__rank").drop("__rank")


def merge(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of changes in place of rows of equal keys, and its new rows."""
    return base.join(changes, keys, "left_anti").unionByName(changes)


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Which keys are on one side alone: key, state (left_only, right_only, both)."""
    a, b = left.select(F.col(key).alias("a")).distinct(), right.select(F.col(key).alias("b")).distinct()
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias(key), F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").otherwise("both").alias("state"))


def typed_match(json: Column, key: str, value) -> Column:
    """Whether a JSON object's key holds just this value: true, 1, 1.0, "1", null and a missing key all differ."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", key):
        raise ValueError(f"not a key: {key!r}")
    if isinstance(value, int) and not isinstance(value, bool) and not -(1 << 63) <= value < 1 << 63:
        raise ValueError("beyond 64 bits")
    path = f"$['{key}']"
    found = F.try_variant_get(F.try_parse_json(json), path, "variant")
    kind = F.schema_of_variant(found)
    if value is None:
        return F.coalesce(kind == "VOID", F.lit(False))
    if isinstance(value, bool):
        return F.coalesce((kind == "BOOLEAN") & (F.try_variant_get(found, "$", "boolean") == value), F.lit(False))
    if isinstance(value, int):
        return F.coalesce((kind == "BIGINT") & (F.try_variant_get(found, "$", "bigint") == value), F.lit(False))
    if isinstance(value, float):
        return F.coalesce((kind.startswith("DECIMAL") | (kind == "DOUBLE")) & (F.try_variant_get(found, "$", "double") == value), F.lit(False))
    return F.coalesce((kind == "STRING") & (F.try_variant_get(found, "$", "string") == value), F.lit(False))


def rewrite_names(sql: str, names: dict[str, str]) -> str:
    """Table names as the user wrote them, the longest first and as whole words, to quoted view names."""
    for original in sorted(names, key=len, reverse=True):
        sql = re.sub(rf"(?<![\w`]){re.escape(original)}(?![\w`])", f"`{names[original]}`", sql)
    return sql
