from pyspark.sql import functions as F

from spectrel.operators import rules as r


def test_row_checks(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [2.0, 2.0]), (5, [1.0, float("nan"), -1.0]), (6, [1.0, 2.0])]
    got = {(x["id"], x["code"], x["n"]) for x in r.row_checks(spark.createDataFrame(rows, "id int, x array<double>"), "id", "x").collect()}
    assert got == {(1, "empty", 0), (2, "empty", 0), (3, "all_zero", 2), (4, "constant", 2), (5, "non_finite", 1), (5, "negative", 1)}


def test_catalog_and_preview(spark):
    c = spark.createDataFrame([("read_file", "reads a file"), ("write_file", "writes"), ("search", None)], "n string, d string")
    names = lambda q: [x["n"] for x in r.catalog_search(c, "n", "d", q).collect()]
    assert names("select:search, nope") == ["search"] and names("+file writes") == ["write_file", "read_file"] and names("file") == ["read_file", "write_file"] and names("+") == [] and names("") == []
    text = "a" * 60 + "\n" + "b" * 200
    out = spark.createDataFrame([(text,), ("short",), (None,)], "t string").select(r.preview(F.col("t"), 100, 20).alias("p")).collect()
    assert out[0]["p"].startswith("a" * 60 + "\n\n... 180 characters") and out[0]["p"].endswith("b" * 20) and out[1]["p"] == "short" and out[2]["p"] is None


def test_entities_and_scrub(spark):
    df = spark.createDataFrame([(1, "We use PLS and 主成分; plsr."), (2, "nothing")], "id int, t string")
    found = {(x["category"], tuple(x["names"])) for x in r.entities(df, "id", "t", {"m": {"pls": [], "pca": ["主成分"], "svm": []}}).collect()}
    assert found == {("m", ("pca", "pls"))}
    assert df.select(r.scrubbed(F.lit("Keep this. I uploaded a file. And  this."), "uploaded")).first()[0] == "Keep this. And this."


def test_words_end_at_accented_letters_as_in_sql(spark):
    from spectrel.operators import events as e

    rows = [(1, 1, "un laéaux"), (2, 1, "x"), (2, 2, "alas"), (3, 1, None), (4, 1, "La"), (4, 2, None), (5, 1, "la_"), (6, 1, "éla.")]
    got = e.recent_signal(spark.createDataFrame(rows, "c int, t int, x string"), "c", "t", "x", [r"(?i)\bthe\b", r"(?i)\bla\b"], 2)
    assert {x["c"]: x["signal"] for x in got.collect()} == {1: True, 2: False, 3: None, 4: True, 5: False, 6: True}
    df = spark.createDataFrame([("A theé b. C.",)], "x string")
    assert df.select(r.scrubbed(F.col("x"), r"\bthe\b")).first()[0] == "C."
    assert r.word_edges(r"a\\b\d") == r"a\\b\d"


def test_gates_and_scores(spark):
    m = spark.createDataFrame([(1, 0.95, 4.5, 3.0, 1.0), (2, 0.85, 2.0, 1.0, 1.0), (3, None, 9.0, None, 1.0)], "id int, r2 double, rpd double, p double, cv double")
    got = {x["id"]: (x["grade"], x["passed"], x["overfitting"]) for x in r.quality(m, rmsep="p", rmsecv="cv").collect()}
    assert got == {1: ("excellent", True, True), 2: ("fair", False, False), 3: ("poor", False, False)}
    req = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"])], "r array<string>, s array<string>")
    assert [x[0] for x in req.select(r.coverage(F.col("r"), F.col("s"))).collect()] == [0.5, 1.0]
    errors = spark.createDataFrame([(1.0, 0.99), (1.0, 0.999), (0.0, 0.0)], "b double, a double")
    assert [x[0] for x in errors.select(r.adopted(F.col("b"), F.col("a"))).collect()] == [True, False, False]
