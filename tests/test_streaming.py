import datetime as dt
import random

from spectrel.streaming import monitors


def stream(spark, tmp_path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def drained(df, name, mode, spark):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


SCORES = [0.6, 0.7, 0.3, 0.6, 0.6, 0.8, 0.05, 0.2, 0.1, 0.0, 0.9]


def test_alert_states(spark, tmp_path):
    rows = [("m", k, s) for k, s in enumerate(SCORES)] + [("other", k, 0.9) for k in range(3)]
    schema = "model string, seq long, score double"
    batch = {(r["model"], r["seq"]): r["transition"] for r in monitors.drift_alerts(spark.createDataFrame(rows, schema)).collect()}
    started = {k for k, v in batch.items() if v == "alert_started"}
    assert started == {("m", 5), ("other", 2)} and {k for k, v in batch.items() if v == "alert_recovered"} == {("m", 9)}
    src = stream(spark, tmp_path, [rows[:4], rows[4:8], rows[8:]], schema)
    got = {(r["model"], r["seq"]): r["transition"] for r in drained(monitors.drift_alerts(src), "alerts", "append", spark)}
    assert got.keys() == batch.keys()


def test_numbering_goes_on(spark, tmp_path):
    schema = "thread string, at long"
    src = stream(spark, tmp_path, [[("a", 1), ("b", 2)], [("a", 3), ("a", 4)]], schema)
    got = sorted((r["thread"], r["at"], r["seq"]) for r in drained(monitors.numbered(src, "thread", "at"), "numbers", "append", spark))
    assert len(got) == 4 and sorted(s for t, _, s in got if t == "a") == [1, 2, 3]


def test_running_usage_and_bursts(spark, tmp_path):
    src = stream(spark, tmp_path, [[("r", 5)], [("r", 7), ("s", 1)]], "run string, tokens long")
    got = drained(monitors.running_usage(src, "run"), "usage", "complete", spark)
    assert {r["run"]: r["tokens"] for r in got} == {"r": 12, "s": 1}
    t0 = dt.datetime(2026, 1, 1)
    rows = [("k", t0, "a", False), ("k", t0 + dt.timedelta(seconds=20), "b", True), ("k", t0 + dt.timedelta(seconds=80), "c", False)]
    out = monitors.debounced(spark.createDataFrame(rows, "key string, ts timestamp, payload string, flag boolean"), ["key"], "ts", "payload", "flag").orderBy("start").collect()
    assert [(r["payload"], r["flag"], r["updates"]) for r in out] == [("b", True, 2), ("c", False, 1)]


def test_alerts_of_a_long_key_in_ranges(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(6)
    runs = [float(x) for x in r.choice([0.0, 0.05, 0.3, 0.6, 0.9], 300) for _ in range(int(r.integers(1, 30)))]
    rows = [("hot", 3 * k, s) for k, s in enumerate(runs)] + [(m, k, SCORES[k % 11]) for m in ("b", None) for k in range(40)]
    want = []
    for m in ("hot", "b", None):
        state = (0, 0, False)
        for seq, score in sorted((q, s) for n, q, s in rows if n == m):
            state, transition = monitors.alert_step(state, score)
            want.append((m, seq, score, *state, transition))
    monkeypatch.setattr(monitors, "_alerts", None)  # no frame takes a whole key
    for size in (7, 100, 10**9):
        got = monitors.drift_alerts(spark.createDataFrame(rows, "model string, seq long, score double").repartition(3), size).drop("severity").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_alerts_of_short_and_long_keys(spark):
    r = random.Random(5)
    rows = [(m, k, r.choice([0.05, 0.3, 0.9, 0.9])) for m, n in (("long", 900), ("short", 40), (None, 300), ("one", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "model string, seq long, score double").repartition(3)
    want = {}
    for m in {x[0] for x in rows}:
        state = (0, 0, False)
        for _, k, score in sorted(x for x in rows if x[0] == m):
            state, transition = monitors.alert_step(state, score)
            want[m, k] = (*state, transition)
    for size in (50, 299, 1000):
        alerts = monitors.drift_alerts(df, size)
        assert {(x["model"], x["seq"]): (x["drifting"], x["clean"], x["active"], x["transition"]) for x in alerts.collect()} == want
    plan = alerts._jdf.queryExecution().toString()
    assert "_transitions" not in plan and "Join" not in plan  # short keys alone: each row is worked on once
