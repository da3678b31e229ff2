"""Incremental jobs on Structured Streaming. Late rows: dropped beyond the watermark given; state is keyed, never global."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed values of the alert policy.
ALERT, ALERT_BATCHES, RECOVER, RECOVER_BATCHES = 0.50, 3, 0.10, 2
ALERT_SCHEMA = "model string, seq long, score double, drifting long, clean long, active boolean, transition string, severity string"


def alert_step(state: tuple[int, int, bool], score: float) -> tuple[tuple[int, int, bool], str | None]:
    """(drifting batches, clean batches, active) after one more score, and the transition it makes."""
    drifting, clean, active = state
    drifting, clean = (drifting + 1, 0) if score >= ALERT else (0, clean + 1) if score <= RECOVER else (0, 0)
    if not active and drifting >= ALERT_BATCHES:
        return (drifting, clean, True), "alert_started"
    if active and clean >= RECOVER_BATCHES:
        return (drifting, 0, False), "alert_recovered"
    return (drifting, clean, active), None


def _severity(transition: str | None, score: float) -> str | None:
    return None if not transition else "info" if transition == "alert_recovered" else "critical" if score >= 0.75 else "high"


def _alerts(model: str, pdf: pd.DataFrame, state: tuple[int, int, bool]) -> tuple[pd.DataFrame, tuple[int, int, bool]]:
    rows = []
    for seq, score in pdf.sort_values("seq")[["seq", "score"]].itertuples(index=False):
        state, transition = alert_step(state, score)
        rows.append((model, seq, score, *state, transition, _severity(transition, score)))
    return pd.DataFrame(rows, columns=["model", "seq", "score", "drifting", "clean", "active", "transition", "severity"]), state


#: Rows of a model that are read in order at once at most; rows of all longer models in one range of seq, about.
RANGE_ROWS = 100_000
#: States that stand for all: counters beyond what makes a transition act alike, and one of the two is 0.
STARTS = [(d, c, active) for d, c in ((0, 0), (1, 0), (2, 0), (3, 0), (0, 1), (0, 2)) for active in (False, True)]


def _sorted_ranges(rows: DataFrame) -> DataFrame:
    return rows.repartition("model", "range").sortWithinPartitions("model", "range", F.asc_nulls_last("seq"))


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per model and range: its rows, whether all drift or all are clean, and the state after it from each of STARTS."""
    key, ends, n, high, low, out = None, [], 0, True, True, []

    def done():
        if key is not None:
            out.append((*key, n, high, low, [e[0] for e in ends], [e[1] for e in ends], [e[2] for e in ends]))

    names = ["model", "range", "n", "high", "low", "drifting", "clean", "active"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]

    def shaped(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    for batch in batches:
        for model, part, score in zip(*(batch.column(k).to_pylist() for k in ("model", "range", "score")), strict=True):
            if key != (model, part):
                done()
                key, ends, n, high, low = (model, part), list(STARTS), 0, True, True
            score = math.nan if score is None else score
            ends = [alert_step(e, score)[0] for e in ends]
            n, high, low = n + 1, high and score >= ALERT, low and score <= RECOVER
        yield shaped(out)
        out.clear()
    done()
    yield shaped(out)


def _scan(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """The state before each range of a model; a row for each range."""
    state, rows = (0, 0, False), []
    for r in pdf.sort_values("range").itertuples(index=False):
        rows.append((key[0], r.range, *state))
        d, c, active = state
        k = STARTS.index((min(d, ALERT_BATCHES), min(c, RECOVER_BATCHES), active))
        state = (int(r.drifting[k]) + (d - min(d, ALERT_BATCHES)) * bool(r.high), int(r.clean[k]) + (c - min(c, RECOVER_BATCHES)) * bool(r.low), bool(r.active[k]))
    return pd.DataFrame(rows, columns=["model", "range", "d0", "c0", "a0"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, (0, 0, False)
    for batch in batches:
        rows = []
        for model, part, score, *start in zip(*(batch.column(k).to_pylist() for k in ("model", "range", "score", "d0", "c0", "a0")), strict=True):
            if key != (model, part):
                key, state = (model, part), tuple(start)
            score = math.nan if score is None else score
            state, transition = alert_step(state, score)
            rows.append((*state, transition, _severity(transition, score)))
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
        new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("model", "seq", "score")), *new], names=["model", "seq", "score", "drifting", "clean", "active", "transition", "severity"])


def _ranged_alerts(scores: DataFrame, range_rows: int) -> DataFrame:
    """A model of at most range_rows rows is read in order at once. For longer ones, ranges of seq hold about range_rows rows of all of them
    together, so that no task takes such a model whole: what a range makes of each state is worked out for each range, these are applied
    one after the other, and then the rows of each range from its own start."""
    rows = scores.select(F.col("model").cast("string").alias("model"), F.col("seq").cast("long").alias("seq"), F.col("score").cast("double").alias("score"))
    large = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > range_rows).select(F.col("model").alias("l_model"), "n").cache()
    n = large.agg(F.sum("n")).first()[0] or 0  # at most a model for each range_rows rows
    begun = {"range": F.lit(0), "d0": F.lit(0).cast("long"), "c0": F.lit(0).cast("long"), "a0": F.lit(False)}
    if not n:
        return _sorted_ranges(rows.withColumns(begun)).mapInArrow(_apply, ALERT_SCHEMA)
    own = rows["model"].eqNullSafe(large["l_model"])
    short = rows.join(large, own, "left_anti").withColumns(begun)
    rows = rows.join(large, own, "left_semi")
    parts = max(int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // range_rows))
    bounds = sorted(set(rows.approxQuantile("seq", [k / parts for k in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    if bounds:
        rows = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="seq", outputCol="range", handleInvalid="keep").transform(rows)  # no seq: the last
    else:
        rows = rows.withColumn("range", F.when(F.col("seq").isNull(), 1).otherwise(0))
    rows = rows.withColumn("range", F.col("range").cast("int"))
    each = _sorted_ranges(rows).mapInArrow(_transitions, "model string, range int, n long, high boolean, low boolean, drifting array<long>, clean array<long>, active array<boolean>")
    starts = each.groupBy("model").applyInPandas(_scan, "model string, range int, d0 long, c0 long, a0 boolean")
    starts = starts.withColumnsRenamed({"model": "s_model", "range": "s_range"})
    joined = rows.join(starts, rows["model"].eqNullSafe(starts["s_model"]) & (rows["range"] == starts["s_range"])).drop("s_model", "s_range")
    return _sorted_ranges(joined.unionByName(short)).mapInArrow(_apply, ALERT_SCHEMA)


def drift_alerts(scores: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """scores: model, seq, score; batch or stream. Each score with the state after it: an alert starts after three scores of 0.5 or more in a
    row, and ends after two of 0.1 or less; scores between set both counters back."""
    if not scores.isStreaming:
        return _ranged_alerts(scores, range_rows)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, new = _alerts(key[0], pd.concat(list(frames)), tuple(state.get) if state.exists else (0, 0, False))
        state.update(new)
        yield out

    return scores.groupBy("model").applyInPandasWithState(step, ALERT_SCHEMA, "drifting long, clean long, active boolean", "append", GroupStateTimeout.NoTimeout)


def running_usage(events: DataFrame, *keys: str, value: str = "tokens") -> DataFrame:
    """Totals that grow while runs are active; in update mode each batch gives the changed ones."""
    return events.groupBy(*keys).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("events"))


def debounced(updates: DataFrame, key: list[str], ts: str, payload: str, flag: str, quiet: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """The latest payload of each burst of updates of a key, once it was quiet; flags are OR-ed."""
    source = updates.withWatermark(ts, late) if updates.isStreaming else updates
    bursts = source.groupBy(*key, F.session_window(ts, quiet).alias("burst"))
    return bursts.agg(F.max_by(payload, F.struct(ts, payload)).alias(payload), F.max(flag).alias(flag), F.count(F.lit(1)).alias("updates")).select(*key, F.col("burst.start").alias("start"), F.col("burst.end").alias("end"), payload, flag, "updates")


def numbered(events: DataFrame, thread: str, order: str) -> DataFrame:
    """Adds seq, counted on within each thread from batch to batch (thread, order and seq are returned)."""
    schema = f"{thread} string, {order} long, seq long"

    def count(key, pdf, n):
        pdf = pdf.sort_values(order)
        return pd.DataFrame({thread: str(key[0]), order: pdf[order].to_numpy(), "seq": range(n + 1, n + 1 + len(pdf))}), n + len(pdf)

    rows = events.select(F.col(thread).cast("string").alias(thread), F.col(order).cast("long").alias(order)).groupBy(thread)
    if not events.isStreaming:
        return rows.applyInPandas(lambda key, pdf: count(key, pdf, 0)[0], schema)

    def step(key, frames, state: GroupState):
        out, n = count(key, pd.concat(list(frames)), state.get[0] if state.exists else 0)
        state.update((n,))
        yield out

    return rows.applyInPandasWithState(step, schema, "n long", "append", GroupStateTimeout.NoTimeout)
