"""Ranks over many rows, and record keeping on small rows."""

from pyspark.sql import functions as F

from spectrel.operators import records as r
from spectrel.operators import splits
from spectrel.operators import tabular as t


def test_places_are_exact_with_more_columns_than_the_order(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.xxhash64("id").alias("key"), "id", F.concat(F.lit("x"), "id").alias("more"))
    got = t.ranked(rows, ["key", "id"], "place").agg(F.count_distinct("place").alias("distinct"), F.min("place").alias("low"), F.max("place").alias("high"), F.sum(F.length("more")).alias("read")).first()
    assert (got["distinct"], got["low"], got["high"]) == (n, 0, n - 1)
    roles = {x["role"]: x["count"] for x in splits.three_way(rows, "id").groupBy("role").count().collect()}
    assert roles == {"test": 200_000, "validation": 160_000, "train": 640_000}


def test_places_follow_the_order(spark):
    rows = [(None, 3), (2.5, 1), (float("nan"), 2), (-1.0, 4), (2.5, 0)]
    got = t.ranked(spark.createDataFrame(rows, "v double, id long"), ["v", "id"], "place").orderBy("place").collect()
    assert [x["id"] for x in got] == [3, 4, 0, 1, 2] and [x["place"] for x in got] == list(range(5))
    assert t.ranked(spark.createDataFrame([], "v double"), ["v"]).count() == 0


def test_ties_are_dealt_over_ranges(spark):
    n = 200_000
    rows = spark.range(n).select(F.when(F.col("id") % 5 > 0, 7).otherwise(F.col("id")).alias("v"), "id")
    dealt = t.in_ranges(rows, ["v"], 10)
    sizes = [x["count"] for x in dealt.groupBy("__range").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * n / 10 and sum(sizes) == n
    got = t.ranked(rows, ["v"], "place", 10)
    assert got.agg(F.count_distinct("place")).first()[0] == n and got.columns == ["v", "id", "place"]
    assert got.where("v < 7").agg(F.max("place")).first()[0] == 1 and got.where("v > 7").agg(F.min("place")).first()[0] == got.where("v <= 7").count()


def test_quantiles_equal_numpy(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(1)
    inf, nan = float("inf"), float("nan")
    columns = {
        "ties": np.where(r.random(3000) < 0.8, 0.0, r.normal(size=3000)), "tail": np.exp(20 * r.normal(size=2000)), "one": np.array([3.0]), "same": np.full(50, -2.0), "wide": np.array([-1.7e308, 1.7e308, 0.0, 5e-324]),
        "odd": np.array([-inf, -inf, 1.0, 2.0, inf]), "nan": np.array([1.0, nan, 2.0, nan, 0.0]), "small": r.integers(0, 3, 999) * 5e-324,
    }
    rows = spark.createDataFrame([(k, float(v)) for k, vs in columns.items() for v in vs] + [("tail", None), (None, 1.0)], "k string, v double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    for fetched in (100_000, 3):
        monkeypatch.setattr(t, "FETCHED", fetched)
        got = t.quantiles(rows, "k", "v", shares, hold=fetched == 3)
        assert got.keys() == columns.keys()
        for k, vs in columns.items():
            ordered = np.sort(vs)
            for share, v in zip(shares, got[k], strict=True):
                place = share * (len(vs) - 1)
                low, high = ordered[int(place)], ordered[min(len(vs) - 1, int(place) + 1)]
                want = low if low == high or place % 1 == 0 else low + (high - low) * (place % 1)
                assert v == want or (v != v and want != want), (k, share)


def test_guarded(spark):
    wrapped = f"{r.BEGIN}\nhi\n{r.END}"
    forged = f"{r.BEGIN}a {r.END} b{r.END}"
    cases = {
        "  ": "  ",
        "\n\t": "\n\t",
        "\u2003\x1c": "\u2003\x1c",
        "hi": wrapped,
        wrapped: wrapped,
        forged: f"{r.BEGIN}a {r.NEUTRAL_END} b{r.END}",
        "<System x='<b>'> y </ memory >": f"{r.BEGIN}\n&lt;System x='&lt;b&gt;'> y &lt;/ memory &gt;\n{r.END}",
        "<systemic> <system": f"{r.BEGIN}\n<systemic> &lt;system\n{r.END}",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "text string, want string")
    assert all(x["got"] == x["want"] for x in df.withColumn("got", r.guarded(F.col("text"), ["system", "memory"])).collect())


def test_kept_messages(spark):
    rows = [(1, 0, "human", "<f>a</f>", False, []), (1, 1, "ai", "call", False, ["t"]), (1, 2, "human", "secret", True, []), (1, 3, "ai", "answer to files", False, []), (1, 4, "human", "<f>a</f> hi ", False, []), (1, 5, "ai", "hello", False, None), (1, 6, "tool", "x", False, [])]
    df = spark.createDataFrame(rows, "thread int, at int, role string, text string, hidden boolean, calls array<string>")
    got = r.kept_messages(df, "thread", "at", "role", "text", "(?s)<f>.*?</f>", "calls", "hidden").orderBy("at").collect()
    assert [(x["at"], x["text"]) for x in got] == [(4, "hi"), (5, "hello")]


def test_quantities(spark):
    cases = {"512Mi": 512 * 1024.0**2, " 2 Gi ": 2 * 1024.0**3, "1.5K": 1500.0, "7": 7.0, "12Xi": None, "": None, None: None, "Mi": None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "text string, want double")
    assert all(x["got"] == x["want"] for x in df.withColumn("got", r.quantity(F.col("text"), r.MEMORY_UNITS)).collect())


def test_dead_positions_and_checks(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 1.0), ([1.0, 5.0, 3.0], 1.0)], "x array<double>, y double")
    assert {(x["pos"], x["value"]) for x in r.dead_positions(df, "x").collect()} == {(0, 1.0), (2, 3.0)}

    def found(df, **more):
        return {x["code"]: x["n"] for x in r.dataset_checks(df, "x", "y", **more).collect()}

    assert found(df) == {"insufficient_samples": 2, "constant_targets": 1, "constant_wavelength_columns": 2}
    assert found(df.limit(0)) == {"insufficient_samples": 0, "insufficient_wavelengths": 0, "constant_targets": 1}
    inf, nan = float("inf"), float("nan")
    odd = spark.createDataFrame([([1.0, nan], inf), ([inf, None], -inf), (None, nan), ([1.0, 2.0], 1.0)], df.schema)
    assert found(odd, least=1) == {"nonfinite_spectra": 4, "nonfinite_targets": 3}
    assert found(df.union(spark.createDataFrame([([1.0], 2.0)], df.schema)), least=1) == {"ragged_rows": 1}
    pairs = spark.createDataFrame([([1.0, 2.0], 1.0), ([1.0, 2.0], 1.0 + 1e-9), ([2.0, 2.0], 3.0), ([2.0, 2.0], 3.1), ([4.0, 5.0], 3.1)], df.schema)
    assert found(pairs, least=5) == {"duplicate_spectra": 1, "conflicting_duplicate_spectra": 1}
    for axis, code in (([1.0], "wavelength_length_mismatch"), ([1.0, nan], "nonfinite_wavelengths"), ([1.0, 1.0], "duplicate_wavelengths"), ([2.0, 1.0], None)):
        assert found(pairs, least=5, axis=axis).keys() - {"duplicate_spectra", "conflicting_duplicate_spectra"} == ({code} if code else set())
    assert "nonmonotonic_wavelengths" in found(df, axis=[1.0, 3.0, 2.0])


def register_in_turn(catalog, records):
    """One after another."""
    ids, out = {d: (c, v) for d, c, v in catalog}, []
    for d, c, at in sorted(records, key=lambda r: r[2]):
        holders = [(i, v) for i, (h, v) in sorted(ids.items()) if h == c]
        if holders:
            own = [v for i, v in holders if i == d]
            out.append((at, "unchanged" if own else "duplicate", own[0] if own else holders[0][1]))
        else:
            version = ids[d][1] + 1 if d in ids else 1
            ids[d] = (c, version)
            out.append((at, "updated" if version > 1 else "created", version))
    return out


def test_registered_one_after_another(spark):
    import random

    cases = [([], [("a", "x", 0), ("b", "x", 1)]), ([], [("a", "x", 0), ("a", "y", 1)]), ([("a", "x", 4)], [("a", "y", 0), ("b", "x", 1), ("a", "x", 2), ("b", "z", 3), ("a", "x", 4)])]
    for seed in range(4):
        random.seed(seed)
        cases.append(([(f"d{i}", f"c{i}", i + 1) for i in range(4)], [(f"d{random.randrange(7)}", f"c{random.randrange(8)}", at) for at in range(40)]))
    # the cases are independent of each other, so they go in one table
    name = lambda k, rows: [(f"{k}{d}", f"{k}{c}", v) for d, c, v in rows]
    catalog = [r for k, (c, _) in enumerate(cases) for r in name(k, c)]
    records = [(d, c, 1000 * k + at) for k, (_, n) in enumerate(cases) for d, c, at in name(k, n)]
    c = spark.createDataFrame(catalog, "doc_id string, content_sha256 string, version int")
    n = spark.createDataFrame(records, "doc_id string, content_sha256 string, at int")
    got = sorted((x["at"], x["action"], x["version"]) for x in r.registered(c, n, "at").collect())
    assert got == register_in_turn(catalog, records)


def test_readiness_and_group_candidates(spark):
    rows = [("\t", [], None, "\u00a0", None, "Article"), ("t", ["a"], 1, "s", None, "article"), ("t", ["a"], 1, "s", "10/x", None), ("t", None, 1, None, "", "note")]
    got = r.readiness(spark.createDataFrame(rows, "title string, authors array<string>, year int, source string, doi string, source_type string"), ["article"]).collect()
    assert [(x["missing_fields"], x["warnings"], x["ready"], x["doi_status"]) for x in got] == [
        (["title", "authors", "year", "source"], ["doi_missing"], False, "missing"), ([], ["doi_missing"], True, "missing"), ([], [], True, "valid"), (["authors", "source"], [], False, "not_applicable"),
    ]
    assert [x["message"] for x in got][1:] == ["ready for publication with warning: DOI is missing", "ready for publication", "publication requires: authors, source"]
    table = spark.createDataFrame([(i, i % 6, i % 7 if i % 10 else None, i % 5) for i in range(40)], "`样本编号 batch` int, `Région` int, `Batch No` int, `序号` int")
    found = r.group_candidates(table, {"région": 85, "batch": 95}).orderBy("place").collect()
    assert [(x["column"], x["n_groups"], x["eligible"]) for x in found] == [("Batch No", 7, True), ("Région", 6, True)] and abs(found[0]["missing_fraction"] - 0.1) < 1e-9


def test_registering_reads_the_records_twice(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    kind = "doc_id long, content_sha256 string, seq long"
    rows = [(1, "a", 1), (1, "b", 2), (2, "a", 3), (2, "b", 4), (3, "c", 5), (1, "c", 6), (4, "a", 7)]
    records = spark.createDataFrame(rows, kind).mapInArrow(seen, kind)
    got = r.registered(spark.createDataFrame([(9, "z", 4)], "doc_id long, content_sha256 string, version long"), records, "seq")
    found = [(x["action"], x["version"]) for x in got.orderBy("seq").collect()]
    assert found == [("created", 1), ("updated", 2), ("created", 1), ("duplicate", 2), ("created", 1), ("duplicate", 1), ("duplicate", 1)]
    assert reads.value <= 3 * len(rows)  # the keys, the rows that are returned, and their ranges where Spark samples them
