import numpy as np
import pytest

from spectrel.operators import chunking, sqlfunctions


def test_scalars(spark):
    sqlfunctions.register(spark)
    sqlfunctions.register(spark)
    spark.createDataFrame([(0, [1.0, 2.0, 4.0]), (1, [3.0, 3.0]), (2, []), (3, None)], "id int, x array<double>").createOrReplaceTempView("rows")
    got = {r["id"]: r for r in spark.sql("SELECT id, array_mean(x) AS m, snv(x) AS s, l2_normalized(x) AS n, array_difference(x) AS d, array_dot(x, x) AS q FROM rows").collect()}
    x = np.array([1.0, 2.0, 4.0])
    assert np.allclose(got[0]["s"], (x - x.mean()) / x.std()) and np.allclose(got[0]["n"], x / np.linalg.norm(x)) and got[0]["d"] == [1.0, 2.0] and got[0]["q"] == 21.0
    assert got[1]["s"] == [0.0, 0.0] and got[2]["m"] is None and got[2]["d"] == [] and got[3]["s"] is None and got[3]["d"] is None
    texts = ["近红外 a.b-c, d!", "", "  x  "]
    spark.createDataFrame([(t,) for t in texts], "t string").createOrReplaceTempView("texts")
    assert [r[0] for r in spark.sql("SELECT estimated_tokens(t) FROM texts").collect()] == [chunking.tokens(t) for t in texts]


def test_chunks_as_a_table(spark):
    sqlfunctions.register(spark)
    text = "# A\n\none two three. four\n\n## B\n\n<!-- page: 3 --> five six seven eight nine ten\n\neleven"
    spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string").createOrReplaceTempView("texts")
    for strategy in chunking.STRATEGIES:
        got = spark.sql(f"SELECT id, c.* FROM texts, LATERAL text_chunks(t, 12, '{strategy}') c ORDER BY id, chunk_index").collect()
        want = [(1, i, c["section_path"], c["content"], c["tokens"], c["page_start"], c["page_end"]) for i, c in enumerate(chunking.chunked(text, 12, 0, strategy))]
        assert [tuple(r) for r in got] == want
    with pytest.raises(Exception, match="strategy is one of"):
        spark.sql("SELECT * FROM texts, LATERAL text_chunks(t, 12, 'lines')").collect()
