"""Queries over record keeping: threads, catalogs, column candidates, dataset checks, resource samples, message guards."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from spectrel.functions import kernels
from spectrel.operators import documents as d
from spectrel.operators import records as r
from spectrel.operators import tabular as t
from spectrel.plans.knowledge import _COS
from spectrel.plans.registry import query, table


@query("thread_search", "SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'view') AND CAST(json_extract(props, '$.k') AS BIGINT) = 7 ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 1")
def thread_search(spark, sf_dir):
    return r.search(table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], 20, 1, "props", {"k": 7}, event_type=["click", "view"]).select("event_id", "user_id")


@query("event_filter_page", "SELECT event_id FROM events WHERE event_type IN ('error', 'purchase') AND event_id > 100 ORDER BY event_id LIMIT 25")
def event_filter_page(spark, sf_dir):
    return r.search(table(spark, sf_dir, "events").where("event_id > 100"), ["event_id"], 25, event_type=["error", "purchase"]).select("event_id")


@query("waiting_runs", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate <= DATE '1996-06-30' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def waiting_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").withColumn("status", F.col("o_orderstatus")).withColumn("day", F.col("o_orderdate").cast("date"))
    return r.waiting(runs, ["O", "P"], "day", date(1996, 6, 30), ["day", "o_orderkey"], 50).select("o_orderkey")


@query("newest_runs", "SELECT user_id, event_id, k FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS k FROM events) WHERE k <= 3")
def newest_runs(spark, sf_dir):
    return t.top_per_group(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3, "k").select("user_id", "event_id", "k")


@query("deleted_events", "SELECT count(*) FILTER (WHERE user_id = 3) AS deleted, count(*) FILTER (WHERE user_id IS DISTINCT FROM 3) AS kept FROM events")
def deleted_events(spark, sf_dir):
    kept, gone = r.without(table(spark, sf_dir, "events"), F.col("user_id") == 3)
    return gone.crossJoin(kept.agg(F.count(F.lit(1)).alias("kept")))  # one row each


@query(
    "filtered_vector_search",
    f"{_COS} SELECT query_id, vec_id, score FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s.vec_id) AS k FROM s JOIN embeddings e ON s.vec_id = e.vec_id WHERE e.label < 5) WHERE k <= 10",
)
def filtered_vector_search(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return d.nearest(v.where("label < 5"), "vec_id", "embedding", q, "query_id", "qv", 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(
    "reranked_results",
    f"{_COS}, c AS (SELECT s.query_id, s.vec_id, e.label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s.vec_id) AS k FROM s JOIN embeddings e ON s.vec_id = e.vec_id), n AS (SELECT * FROM c WHERE k <= 20), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY k) AS w FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k) AS p FROM b WHERE w <= 4), q AS (SELECT *, greatest(0, least(1, (vec_id % 13) / 10.0 - 0.1)) AS g FROM p WHERE p <= 8) SELECT query_id, vec_id, round(CAST(g AS DOUBLE), 6) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY g DESC, p) AS INTEGER) AS place FROM q",
)
def reranked_results(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    hits = d.nearest(v, "vec_id", "embedding", q, "query_id", "qv", 20).select("query_id", "vec_id", F.round("score", 6).alias("score")).join(v.select("vec_id", "label"), "vec_id")
    scores = hits.select("query_id", "vec_id", (F.col("vec_id") % 13 / 10.0 - 0.1).alias("rerank_score"))
    return r.reranked(hits, scores, "query_id", "vec_id", "label", [F.desc("score"), "vec_id"], 8, 4).select("query_id", "vec_id", F.round("rerank_score", 6).alias("rerank_score"), "place")


@query(
    "kept_messages",
    """WITH m AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' AND turn = 0 AND conv_id % 3 = 0 THEN '<uploaded_files>a</uploaded_files>' WHEN role = 'user' AND turn = 0 AND conv_id % 3 = 1 THEN '<uploaded_files>a</uploaded_files>' || text ELSE text END AS t FROM conversations WHERE role IN ('user', 'assistant')),
    c AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' AND contains(t, '<uploaded_files>') THEN regexp_replace(regexp_replace(t, '<uploaded_files>a</uploaded_files>', ''), '^\\s+|\\s+$', '', 'g') ELSE t END AS text, role = 'user' AND t = '<uploaded_files>a</uploaded_files>' AS only_files FROM m),
    l AS (SELECT *, lag(only_files) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM c)
    SELECT conv_id, turn, md5(text) AS digest FROM l WHERE NOT only_files AND NOT (role <> 'user' AND coalesce(before, false))""",
)
def kept_messages(spark, sf_dir):
    block, first = "<uploaded_files>a</uploaded_files>", (F.col("role") == "user") & (F.col("turn") == 0)
    text = F.when(first & (F.col("conv_id") % 3 == 0), block).when(first & (F.col("conv_id") % 3 == 1), F.concat(F.lit(block), "text")).otherwise(F.col("text"))
    role = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai")
    messages = table(spark, sf_dir, "conversations").withColumns({"text": text, "role": role})
    return r.kept_messages(messages, "conv_id", "turn", "role", "text", r"(?s)<uploaded_files>.*?</uploaded_files>").select("conv_id", "turn", F.md5("text").alias("digest"))


@query("ordering_checks", "SELECT user_id, min(event_id) FILTER (WHERE event_type = 'error') AS first_at, min(event_id) FILTER (WHERE event_type = 'purchase') AS then_at, coalesce(min(event_id) FILTER (WHERE event_type = 'purchase') > min(event_id) FILTER (WHERE event_type = 'error'), false) AS in_order FROM events GROUP BY user_id")
def ordering_checks(spark, sf_dir):
    return r.follows(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "error", "purchase")


@query(
    "catalog_register",
    """WITH RECURSIVE d AS (SELECT doc_id, dense_rank() OVER (ORDER BY coalesce(text, '')) AS t FROM documents), c AS (SELECT doc_id, 2 * t AS h, 1 + doc_id % 3 AS version FROM d WHERE doc_id % 2 = 0),
    e AS (SELECT 2 * doc_id AS seq, doc_id, CASE WHEN doc_id % 4 < 2 THEN 2 * t ELSE 2 * t + 1 END AS h FROM d UNION ALL SELECT 2 * doc_id + 1, doc_id - doc_id % 3, 2 * t FROM d WHERE doc_id % 7 < 3),
    n AS (SELECT *, row_number() OVER (ORDER BY seq) AS k FROM e),
    s AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, '' AS action, CAST(0 AS BIGINT) AS version,
      (SELECT map_from_entries(list(struct_pack(k := h, v := struct_pack(i := i, n := v)))) FROM (SELECT h, min(doc_id) AS i, CAST(arg_min(version, doc_id) AS BIGINT) AS v FROM c GROUP BY h)) AS held,
      (SELECT map_from_entries(list(struct_pack(k := doc_id, v := struct_pack(h := h, n := CAST(version AS BIGINT))))) FROM c) AS ids
    UNION ALL SELECT n.k, n.seq,
      CASE WHEN s.ids[n.doc_id].h = n.h THEN 'unchanged' WHEN s.held[n.h] IS NOT NULL THEN 'duplicate' WHEN s.ids[n.doc_id] IS NOT NULL THEN 'updated' ELSE 'created' END,
      CASE WHEN s.ids[n.doc_id].h = n.h THEN s.ids[n.doc_id].n WHEN s.held[n.h] IS NOT NULL THEN s.held[n.h].n ELSE coalesce(s.ids[n.doc_id].n, 0) + 1 END,
      CASE WHEN s.held[n.h] IS NOT NULL OR s.ids[n.doc_id].h = n.h THEN s.held
        ELSE map_concat(map_from_entries(list_filter(map_entries(s.held), lambda x: x.value.i <> n.doc_id)), MAP {n.h: struct_pack(i := n.doc_id, n := coalesce(s.ids[n.doc_id].n, 0) + 1)}) END,
      CASE WHEN s.held[n.h] IS NOT NULL OR s.ids[n.doc_id].h = n.h THEN s.ids ELSE map_concat(s.ids, MAP {n.doc_id: struct_pack(h := n.h, n := coalesce(s.ids[n.doc_id].n, 0) + 1)}) END
      FROM s JOIN n ON n.k = s.k + 1)
    SELECT seq, action, version FROM s WHERE k > 0""",
)
def catalog_register(spark, sf_dir):
    """Half of the documents are in the catalog. Then all come, some changed, and after some of them another of their text under a near id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    catalog = docs.where("doc_id % 2 = 0").select("doc_id", F.sha2("text", 256).alias("content_sha256"), (1 + F.col("doc_id") % 3).alias("version"))
    new = docs.select((2 * F.col("doc_id")).alias("seq"), "doc_id", F.sha2(F.when(F.col("doc_id") % 4 < 2, F.col("text")).otherwise(F.concat("text", F.lit("x"))), 256).alias("content_sha256"))
    again = docs.where("doc_id % 7 < 3").select((2 * F.col("doc_id") + 1).alias("seq"), (F.col("doc_id") - F.col("doc_id") % 3).alias("doc_id"), F.sha2("text", 256).alias("content_sha256"))
    return r.registered(catalog, new.unionByName(again), "seq").select("seq", "action", "version")


_MISSING = {"title": "i % 4 = 1 OR NOT regexp_matches(substr(coalesce(text, ''), 1, 20), '[^\\s]')", "authors": "i % 5 = 0", "year": "i % 7 = 0", "source": "i % 9 = 2 OR source IS NULL"}


@query(
    "publication_readiness",
    f"""WITH d AS (SELECT *, doc_id AS i FROM documents), m AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in _MISSING.items())}], lambda x: x IS NOT NULL) AS f, i % 3 <> 0 AND lang = 'en' AS w FROM d)
    SELECT doc_id, array_to_string(f, ',') AS missing, len(f) = 0 AS ready, CASE WHEN doc_id % 3 = 0 THEN 'valid' WHEN lang = 'en' THEN 'missing' ELSE 'not_applicable' END AS doi_status,
    CASE WHEN w THEN 'doi_missing' ELSE '' END AS warnings, CASE WHEN len(f) > 0 THEN 'publication requires: ' || array_to_string(f, ', ') WHEN w THEN 'ready for publication with warning: DOI is missing' ELSE 'ready for publication' END AS message FROM m""",
)
def publication_readiness(spark, sf_dir):
    i = F.col("doc_id")
    records = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 4 == 1, "\t\n").otherwise(F.substring("text", 1, 20)).alias("title"), F.when(i % 5 != 0, F.array("source")).alias("authors"), F.when(i % 7 != 0, F.lit(2000)).alias("year"),
        F.when(i % 9 == 2, "\n ").otherwise(F.col("source")).alias("source"), F.when(i % 3 == 0, "10.1000/x").alias("doi"), F.when(F.col("lang") == "en", "Journal_Article").otherwise("note").alias("source_type"),
    )
    return r.readiness(records, ["journal_article"]).select("doc_id", F.concat_ws(",", "missing_fields").alias("missing"), "ready", "doi_status", F.concat_ws(",", "warnings").alias("warnings"), "message")


@query("model_versions", "SELECT user_id, event_type, max(event_id) AS version, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def model_versions(spark, sf_dir):
    models = table(spark, sf_dir, "events").withColumn("model", F.concat_ws("/", "user_id", "event_type"))
    return r.newest_versions(models, "model", "event_id").select("user_id", "event_type", F.col("event_id").alias("version"), "value")


@query("message_budgets", "SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= CASE WHEN role = 'user' THEN 300 ELSE 600 END")
def message_budgets(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations").withColumn("cost", F.length("text"))
    return r.two_budgets(messages, "conv_id", ["turn"], "cost", F.col("role") == "user", 600, 300).select("conv_id", "turn")


@query(
    "categorical_profiles",
    """WITH c AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders),
    n AS (SELECT "column", value, count(*) AS n FROM c WHERE value IS NOT NULL GROUP BY ALL), f AS (SELECT "column", count(*) AS n_unique, sum(n) AS present FROM n GROUP BY ALL)
    SELECT n."column", n.value, n.n, f.n_unique, f.n_unique > 3 AS truncated FROM n JOIN f ON n."column" = f."column" WHERE n_unique BETWEEN 2 AND 20 AND n_unique < present QUALIFY row_number() OVER (PARTITION BY n."column" ORDER BY n.n DESC, n.value) <= 3""",
)
def categorical_profiles(spark, sf_dir):
    return r.categorical_profiles(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"], 20, 3)


@query(
    "group_candidates",
    """WITH c AS (SELECT 'o_orderpriority' AS "column", 90 AS score, count(DISTINCT o_orderpriority) AS n_groups, count(o_orderpriority) AS present, count(*) AS rows FROM orders UNION ALL SELECT 'o_orderstatus', 70, count(DISTINCT o_orderstatus), count(o_orderstatus), count(*) FROM orders UNION ALL SELECT 'o_custkey', 50, count(DISTINCT o_custkey), count(o_custkey), count(*) FROM orders),
    e AS (SELECT *, 1 - present / rows <= 0.2 AND n_groups BETWEEN 5 AND greatest(5, least(100, CAST(round_even(rows * 0.25, 0) AS BIGINT))) AS eligible FROM c)
    SELECT "column", score, n_groups, round(1 - present / rows, 6) AS missing_fraction, eligible, CAST(row_number() OVER (ORDER BY eligible DESC, score DESC, n_groups, "column") AS INTEGER) AS place FROM e""",
)
def group_candidates(spark, sf_dir):
    return r.group_candidates(table(spark, sf_dir, "orders"), {"priority": 90, "status": 70, "custkey": 50}).withColumn("missing_fraction", F.round("missing_fraction", 6))


@query("dataset_checks", "SELECT 'nonfinite_targets' AS code, 'error' AS severity, count(*) AS n FROM embeddings WHERE vec_id % 40 = 0 UNION ALL SELECT 'constant_wavelength_columns', 'warning', 1 UNION ALL SELECT 'nonmonotonic_wavelengths', 'error', 1")
def dataset_checks(spark, sf_dir):
    """One position is the same in all rows, some targets are infinite or null, and the axis turns back."""
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.array(F.lit(1.0)), F.slice(F.col("embedding").cast("array<double>"), 2, 63)).alias("x"), F.when(F.col("vec_id") % 80 == 0, float("inf")).when(F.col("vec_id") % 40 != 0, F.col("label")).alias("y"))
    return r.dataset_checks(rows, "x", "y", axis=[float(k % 60) for k in range(64)])


@query(
    "duplicate_checks",
    """WITH g AS (SELECT embedding, count(*) AS n, max(y) - min(y) > 1e-10 + 1e-7 * abs(min(y)) AS differs FROM (SELECT embedding, label + 0.0 AS y FROM embeddings UNION ALL SELECT embedding, label + CASE WHEN vec_id % 3 = 0 THEN 1.0 ELSE 0.0 END FROM embeddings WHERE vec_id % 5 = 0) GROUP BY embedding HAVING count(*) > 1)
    SELECT CASE WHEN differs THEN 'conflicting_duplicate_spectra' ELSE 'duplicate_spectra' END AS code, CASE WHEN differs THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM g GROUP BY differs""",
)
def duplicate_checks(spark, sf_dir):
    """A fifth of the spectra stand twice, every third of those with another target."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"), F.col("label").cast("double").alias("y"))
    more = rows.where("vec_id % 5 = 0").withColumn("y", F.col("y") + F.when(F.col("vec_id") % 3 == 0, 1.0).otherwise(0.0))
    return r.dataset_checks(rows.unionByName(more), "x", "y")


@query("roles_by_column", "SELECT CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'test' END AS role, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def roles_by_column(spark, sf_dir):
    return r.by_column(table(spark, sf_dir, "orders"), "o_orderstatus", {"F": "train", "O": "test"}).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query(
    "partition_manifest",
    "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS role, count(*) AS n, sha256(CAST(sum(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 12) AS BIGINT)) AS VARCHAR) || '|' || CAST(count(*) AS VARCHAR)) AS digest, 2 AS version, 1 AS parent FROM orders GROUP BY 1",
)
def partition_manifest(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("role", F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train"))
    return r.partition_manifest(rows, "o_orderkey", "role", 2, 1)


@query(
    "transfer_pairs",
    "WITH a AS (SELECT trim(CAST(vec_id AS VARCHAR)) AS sample_id, 1 AS s, 0 AS t FROM embeddings UNION ALL SELECT trim(CAST(vec_id AS VARCHAR)), 0, 1 FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT trim(CAST(vec_id AS VARCHAR)), 0, 1 FROM embeddings WHERE vec_id % 11 = 0) SELECT sample_id, CAST(sum(s) AS BIGINT) AS in_source, CAST(sum(t) AS BIGINT) AS in_target, sum(s) = 1 AND sum(t) = 1 AS paired FROM a GROUP BY 1",
)
def transfer_pairs(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id")
    return r.paired(v, v.where("vec_id % 7 <> 0").unionAll(v.where("vec_id % 11 = 0")), "vec_id")


@query("best_experiments", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS best, min(o_totalprice) AS error FROM orders GROUP BY 1, 2")
def best_experiments(spark, sf_dir):
    return r.comparable_best(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", "o_totalprice")


@query(
    "resource_summary",
    """WITH s AS (SELECT l_returnflag, CASE WHEN l_linenumber = 5 THEN NULL WHEN l_linenumber % 2 = 0 THEN CAST(floor(l_quantity) AS BIGINT) * 1024 ELSE CAST(floor(l_quantity) AS BIGINT) * 1048576 END AS m, l_linenumber * 0.001 AS c FROM lineitem)
    SELECT l_returnflag, count(*) AS n, CAST(sum(m) AS BIGINT) AS total, round(avg(m), 3) AS mean, CAST(max(m) AS BIGINT) AS largest, round(CAST(sum(c) AS DOUBLE), 6) AS cores, count(*) FILTER (WHERE m IS NULL) AS unread FROM s GROUP BY 1""",
)
def resource_summary(spark, sf_dir):
    n = F.floor("l_quantity").cast("string")
    memory = F.when(F.col("l_linenumber") == 5, "about a lot").when(F.col("l_linenumber") % 2 == 0, F.concat(n, F.lit("Ki"))).otherwise(F.concat(n, F.lit(" Mi")))
    samples = table(spark, sf_dir, "lineitem").select("l_returnflag", memory.alias("memory"), F.concat(F.col("l_linenumber").cast("string"), F.lit("m")).alias("cpu"))
    out = r.resource_summary(samples, "l_returnflag", "memory", "cpu")
    return out.select("l_returnflag", "n", F.col("total_bytes").cast("long").alias("total"), F.round("mean_bytes", 3).alias("mean"), F.col("max_bytes").cast("long").alias("largest"), F.round("cores", 6).alias("cores"), "unread")


@query(
    "guarded_messages",
    """SELECT conv_id, turn, md5(CASE WHEN turn % 4 = 2 THEN chr(10) || chr(9) ELSE '--- BEGIN USER INPUT ---' || chr(10) || CASE WHEN conv_id % 2 = 0 THEN '&lt;system a="1"&gt;' ELSE '[END USER INPUT]' END || text || chr(10) || '--- END USER INPUT ---' END) AS digest FROM conversations WHERE role = 'user'""",
)
def guarded_messages(spark, sf_dir):
    text = F.concat(F.when(F.col("conv_id") % 2 == 0, '<system a="1">').otherwise("--- END USER INPUT ---"), "text")
    text = F.when(F.col("turn") % 4 == 2, "\n\t").otherwise(text)
    users = table(spark, sf_dir, "conversations").where("role = 'user'")
    return users.select("conv_id", "turn", F.md5(r.guarded(text, ["system", "memory"])).alias("digest"))


@query(
    "kernel_rnv",
    """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings), p AS (SELECT *, list_aggregate(e, 'quantile_cont', 0.25) AS p FROM x),
    s AS (SELECT *, list_aggregate(list_filter(e, lambda v: v <= p), 'stddev_pop') + 1e-10 AS sd FROM p) SELECT vec_id, round(list_sum(list_transform(e, lambda v: abs((v - p) / sd))), 4) AS total FROM s""",
)
def kernel_rnv(spark, sf_dir):
    x = kernels.rnv(F.col("embedding").cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(kernels.total(F.transform(x, F.abs)), 4).alias("total"))


@query("markdown_outline", "SELECT doc_id, 1 AS line, 2 AS level, source AS title FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, CAST(3 + length(text) - length(replace(text, chr(10), '')) AS INTEGER), 3, 'the end' FROM documents WHERE text IS NOT NULL")
def markdown_outline(spark, sf_dir):
    text = F.concat(F.lit("## "), "source", F.lit("\n"), "text", F.lit("\n###  the end #"))
    return d.outline(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.alias("text")), "doc_id", "text")
