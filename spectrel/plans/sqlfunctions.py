"""Queries that are SQL alone, with the functions that the library registers."""

from __future__ import annotations

from spectrel.operators import sqlfunctions
from spectrel.plans.registry import ORACLES, query, table


def _run(spark, sf_dir, name: str, sql: str):
    sqlfunctions.register(spark)
    table(spark, sf_dir, name).createOrReplaceTempView(f"spectrel_{name}")
    return spark.sql(sql)


@query("sql_kernels", ORACLES["spectral_position_stats"])
def sql_kernels(spark, sf_dir):
    return _run(spark, sf_dir, "embeddings", "SELECT CAST(pos AS BIGINT) AS pos, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (SELECT posexplode(x) AS (pos, v) FROM (SELECT snv(CAST(embedding AS ARRAY<DOUBLE>)) AS x FROM spectrel_embeddings)) GROUP BY pos")


@query("sql_page_chunks", ORACLES["page_span_chunks"])
def sql_page_chunks(spark, sf_dir):
    text = "array_join(transform(sequence(1, CAST(1 + doc_id % 4 AS INT)), p -> concat('<!-- page: ', p, ' --> words of page number ', p)), '\\n\\n')"
    return _run(spark, sf_dir, "documents", f"SELECT d.doc_id, c.chunk_index, c.page_start, c.page_end, c.tokens FROM (SELECT doc_id, {text} AS text FROM spectrel_documents) d, LATERAL text_chunks(d.text, 20, 'paragraphs') c")
