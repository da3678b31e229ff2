import pytest
from pyspark.sql import functions as F

from spectrel.sources import files


def test_load_and_names(spark, tmp_path):
    for folder, text in (("a", "id,v\n1,x\n2,\n"), ("b", "id,v\n3,y\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "my data.csv").write_text(text)
    (tmp_path / "x.bin").write_bytes(b"\0")
    got = files.load_files(spark, [f"{tmp_path}/a/my data.csv", f"{tmp_path}/b/my data.csv", f"{tmp_path}/x.bin"])
    assert list(got) == ["my_data", "my_data_1"] and spark.sql("SELECT sum(id) AS s FROM my_data").first()["s"] == 3
    assert files.table_name("9 a-b") == "t_9_a_b"


def test_selectors():
    assert files.columns_of("8:", 10) == [8, 9] and files.columns_of(":2,-1", 5, dropped=0) == [1, 4]
    for bad in ("9", "0"):
        with pytest.raises(ValueError):
            files.columns_of(bad, 5, dropped=0)


def test_numbers_profile_and_spectra(spark, tmp_path):
    path = f"{tmp_path}/s.csv"
    (tmp_path / "s.csv").write_text("name;1100;1110;y\na;1,5;−2;3\nb;n/a;1.000,5;4\nc;inf;7;x\n")
    assert files.delimiter(spark, path) == ";"
    df = spark.read.option("header", True).option("sep", ";").csv(path)
    rows = files.spectra(df, ["1100", "1110"], ["y"], "name", ",").orderBy("sample_id").collect()
    assert [r["x"] for r in rows] == [[1.5, -2.0], [None, 1000.5], [None, 7.0]] and rows[2]["y"] == {"y": None}
    kinds = {r["column_name"]: (r["kind"], r["missing"]) for r in files.profile(df, ",").collect()}
    assert kinds["1110"] == ("numeric", 0) and kinds["name"][0] == "text" and kinds["1100"][1] == 1
    left = files.spectra(df, ["1100"], [], "name", ",")
    assert files.joined_blocks(left, files.spectra(df, ["1110"], [], "name", ",")).where("sample_id = 'a'").first()["x"] == [1.5, -2.0]
    with pytest.raises(Exception, match="not in both"):
        files.joined_blocks(left, left.where("sample_id = 'a'")).collect()
    files.check_size(left)


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b\nc", b"\x01\xff")], "n int, t string, b binary")
    for kind in ("csv", "json", "md"):
        files.export(df, f"{tmp_path}/out.{kind}")
    assert spark.read.json(f"{tmp_path}/out.json").first()["b"] == "01FF"
    lines = {r["value"] for r in spark.read.text(f"{tmp_path}/out.md").collect()}
    assert lines == {"| n | t | b |", "| --- | --- | --- |", "| 1 | a\\|b c | 01FF |"}
    with pytest.raises(ValueError):
        files.export(df, f"{tmp_path}/out.xyz")
    x = spark.createDataFrame([([1.0, 2.5], {"y": 3.0})], "x array<double>, y map<string,double>")
    files.save_spectra(x, f"{tmp_path}/spectra", [1100.0, 1110.5], "y")
    assert spark.read.option("header", True).csv(f"{tmp_path}/spectra").first().asDict() == {"y": "3", "1100": "1", "1110.5": "2.5"}


def test_trees_and_feeds(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.md").write_text("hello")
    (tmp_path / "d" / "e" / "b.md").write_text("there")
    (tmp_path / "d" / "c.md").write_bytes(b"x\0y")
    assert sorted(r["text"] for r in files.text_files(spark, f"{tmp_path}/d", "*.md").collect()) == ["hello", "there"]
    (tmp_path / "f.xml").write_text("<feed><entry><id>http://x.org/abs/2101.00001v2</id><title>A\n  b</title><published>2021</published><author><name>Li  M</name></author><author><name>B</name></author></entry></feed>")
    assert tuple(files.feed_entries(spark, f"{tmp_path}/f.xml").first()) == ("2101.00001", "A b", ["Li M", "B"], "2021")
