"""Queries of rule tables: gates, validation, evidence, entities, catalogs, traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrel.operators import rules as r
from spectrel.plans.registry import query, table
from spectrel.plans.spectral import spectra


@query("quality_grades", """WITH m AS (SELECT user_id, avg(value) / 60 AS r2, stddev_samp(value) / 10 AS rpd FROM events GROUP BY user_id),
s AS (SELECT user_id, CASE WHEN r2 >= 0.9 THEN 'excellent' WHEN r2 >= 0.8 THEN 'good' WHEN r2 >= 0.6 THEN 'fair' ELSE 'poor' END AS r2_status, CASE WHEN rpd >= 4 THEN 'excellent' WHEN rpd >= 3 THEN 'good' WHEN rpd >= 1.5 THEN 'fair' ELSE 'poor' END AS rpd_status FROM m WHERE rpd IS NOT NULL),
g AS (SELECT *, least(list_position(['poor', 'fair', 'good', 'excellent'], r2_status), list_position(['poor', 'fair', 'good', 'excellent'], rpd_status)) AS k FROM s)
SELECT user_id, r2_status, rpd_status, ['poor', 'fair', 'good', 'excellent'][k] AS grade, k >= 3 AS passed FROM g""")
def quality_grades(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy("user_id").agg((F.avg("value") / 60).alias("r2"), (F.stddev_samp("value") / 10).alias("rpd"))
    return r.quality(m.where("rpd IS NOT NULL")).drop("r2", "rpd")


@query("spectra_checks", "WITH p AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT vec_id, 'negative' AS code, CAST(count(*) AS INTEGER) AS n FROM p WHERE v < 0 GROUP BY vec_id")
def spectra_checks(spark, sf_dir):
    return r.row_checks(spectra(spark, sf_dir), "vec_id", "x")


@query("outlying_targets", "WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS z FROM orders, s WHERE abs(o_totalprice - m) > 1.5 * s")
def outlying_targets(spark, sf_dir):
    return r.outlying_targets(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("y")), "o_orderkey", "y", 1.5).select("o_orderkey", F.round("z", 6).alias("z"))


@query("evidence_support", """WITH h AS (SELECT l_orderkey AS q, l_suppkey AS d, bool_or(l_returnflag IN ('A', 'N')) AS ok, bool_or(l_linestatus = 'F') AS doi FROM lineitem GROUP BY 1, 2),
n AS (SELECT q, count(*) AS documents, count(*) FILTER (WHERE ok) AS acceptable, count(*) FILTER (WHERE doi) AS with_doi FROM h GROUP BY q)
SELECT q, documents, acceptable, with_doi, CASE WHEN with_doi = documents THEN 'complete' WHEN with_doi > 0 THEN 'partial' ELSE 'missing' END AS doi_completeness,
CASE WHEN documents >= 2 AND acceptable >= 2 AND documents >= 3 THEN 'strong' WHEN documents >= 2 AND acceptable >= 2 THEN 'moderate' ELSE 'limited' END AS support_level, documents >= 2 AND acceptable >= 2 AS ready FROM n""")
def evidence_support(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("d"), F.when(F.col("l_returnflag").isin("A", "N"), "A").otherwise("D").alias("tier"), F.when(F.col("l_linestatus") == "F", "10.1/x").alias("doi"))
    return r.evidence(hits, "q", "d", "tier", "doi", "decision")


DICTIONARY = {"license": {"apache": ["apache license"], "mit": [], "gpl": ["gnu general public license"]}, "abuse": {"idiot": ["moron"], "trash": []}}


@query("entity_extraction", r"""WITH t AS (SELECT * FROM (VALUES ('license', 'apache', 'apache|apache license'), ('license', 'mit', 'mit'), ('license', 'gpl', 'gpl|gnu general public license'), ('abuse', 'idiot', 'idiot|moron'), ('abuse', 'trash', 'trash')) v(category, name, p)),
h AS (SELECT DISTINCT doc_id, category, name FROM documents, t WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])(' || p || ')($|[^\p{L}\p{N}])')) SELECT doc_id, category, string_agg(name, ',' ORDER BY name) AS names FROM h GROUP BY doc_id, category""")
def entity_extraction(spark, sf_dir):
    return r.entities(table(spark, sf_dir, "documents"), "doc_id", "text", DICTIONARY).withColumn("names", F.array_join("names", ","))


@query("entity_union", r"""WITH t AS (SELECT * FROM (VALUES ('license', 'apache', 'apache|apache license'), ('license', 'mit', 'mit'), ('license', 'gpl', 'gpl|gnu general public license'), ('abuse', 'idiot', 'idiot|moron'), ('abuse', 'trash', 'trash')) v(category, name, p)),
h AS (SELECT DISTINCT source, category, name FROM documents, t WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])(' || p || ')($|[^\p{L}\p{N}])')) SELECT source, category, string_agg(name, ',' ORDER BY name) AS names FROM h GROUP BY source, category""")
def entity_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = r.entities(docs, "doc_id", "text", DICTIONARY).join(docs.select("doc_id", "source"), "doc_id")
    return r.merged_entities(found, "source").withColumn("names", F.array_join("names", ","))


@query("catalog_search", "SELECT p_partkey, p_name, CASE WHEN contains(lower(p_name), 'a') THEN 2 ELSE 1 END AS score FROM part WHERE contains(lower(p_name || ' ' || p_type), 'a') ORDER BY score DESC, p_name, p_partkey LIMIT 5")
def catalog_search(spark, sf_dir):
    return r.catalog_search(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "p_name", "p_type", "a").drop("p_type")


@query("text_preview", "SELECT doc_id, length(text) > 300 AS shortened, right(text, 100) AS ending FROM documents")
def text_preview(spark, sf_dir):
    p = r.preview(F.col("text"), 200, 100)
    return table(spark, sf_dir, "documents").select("doc_id", p.contains("characters left out").alias("shortened"), F.right(p, F.lit(100)).alias("ending"))


@query("memory_facts", "WITH f AS (SELECT user_id, event_id, props, value / 100 AS c FROM events WHERE value / 100 >= 0.1), d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id, lower(trim(props)) ORDER BY event_id) = 1) SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_id) AS INTEGER) AS rank FROM d QUALIFY rank <= 10")
def memory_facts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("c", F.col("value") / 100)
    return r.facts(e, "user_id", "props", "c", ["event_id"], 0.1, 10).select("user_id", "event_id", "rank")


@query("registry_versions", "SELECT o_custkey, max(o_orderkey) AS latest, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best FROM orders GROUP BY o_custkey")
def registry_versions(spark, sf_dir):
    return r.best_version(table(spark, sf_dir, "orders").withColumn("m", F.col("o_totalprice").cast("double")), "o_custkey", "o_orderkey", "m")


@query("trace_scores", "SELECT user_id, round(100 * sum((CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) * (event_id % 3 + 1)) / sum(event_id % 3 + 1), 2) AS score, bool_and(event_type <> 'error') AS passed FROM events GROUP BY user_id")
def trace_scores(spark, sf_dir):
    checks = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") != "error", 1.0).otherwise(0.0).alias("value"), (F.col("event_id") % 3 + 1).alias("weight"))
    return r.trace_scores(checks, "user_id")


@query("class_gate", "WITH m AS (SELECT source, avg(quality) AS b, avg(1 - toxic) AS f, least(avg(quality), avg(1 - toxic)) AS r FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY source) SELECT source, b >= 0.8 AND f >= 0.8 AND r >= 0.6 AS passed, CASE WHEN b >= 0.8 AND f >= 0.8 AND r >= 0.6 AND least(b, f, r) >= 0.9 THEN 'A' WHEN b >= 0.8 AND f >= 0.8 AND r >= 0.6 THEN 'B' WHEN least(b, f, r) >= 0.5 THEN 'C' ELSE 'F' END AS grade FROM m")
def class_gate(spark, sf_dir):
    m = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.avg("quality").alias("balanced_accuracy"), F.avg(1 - F.col("toxic")).alias("macro_f1"))
    return r.class_gate(m.withColumn("least_recall", F.least("balanced_accuracy", "macro_f1"))).select("source", "passed", "grade")


@query("drift_index")
def drift_index(spark, sf_dir):
    from spectrel.operators import gram

    x = spectra(spark, sf_dir)
    return r.drift_index(gram.mahalanobis(x, "x", gram.grams(x, "x")[0])).select(F.round("drift_index", 6).alias("drift_index"))


@query("scrubbed_messages", r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '(?i)[^.!?\n]*(?:\bupload(ed)?\b|\bthe\b)[^.!?\n]*[.!?]?', '', 'g'), ' {2,}', ' ', 'g')) AS text FROM conversations")
def scrubbed_messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", r.scrubbed(F.col("text"), r"\bupload(ed)?\b|\bthe\b").alias("text"))
