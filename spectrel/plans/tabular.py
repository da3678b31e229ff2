"""Queries over the uploaded-table surface: SQL text, joins, grouping, windows, profiles, paging, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spectrel.operators import tabular as t
from spectrel.plans.registry import query, table


def sql_over(spark, sf_dir, text, *names):
    """SQL text over given tables: their names are rewritten to this run's views."""
    views = {}
    for n in names:
        views[n] = f"spectrel_{n}"
        table(spark, sf_dir, n).createOrReplaceTempView(views[n])
    return spark.sql(t.rewrite_names(text, views))


def register_sql(name: str, tables: tuple, text: str, oracle: str | None = None):
    query(name, oracle or text)(lambda spark, sf_dir: sql_over(spark, sf_dir, text, *tables))


register_sql("sql_filter_distinct", ("orders",), "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders WHERE o_totalprice > 100000 AND o_orderdate >= DATE '1995-01-01'")
register_sql(
    "sql_join_group",
    ("customer", "orders", "nation"),
    "SELECT n.n_name, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS revenue FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
)
register_sql(
    "sql_left_anti_semi",
    ("customer", "orders"),
    "SELECT c.c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) THEN 'buyer' ELSE 'idle' END AS kind FROM customer c",
)
register_sql(
    "sql_grouping_sets",
    ("lineitem",),
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
)
register_sql("sql_cube", ("part",), "SELECT p_brand, CAST(p_size AS STRING) AS size, count(*) AS n FROM part GROUP BY CUBE (p_brand, CAST(p_size AS STRING))")
register_sql("sql_rollup", ("orders",), "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
register_sql(
    "sql_running_total",
    ("orders",),
    "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders",
)
register_sql(
    "sql_conditional_pivot",
    ("orders",),
    "SELECT o_orderpriority, CAST(sum(CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 0 END) AS BIGINT) AS first_half, CAST(sum(CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END) AS BIGINT) AS second_half FROM orders GROUP BY o_orderpriority",
)
register_sql("sql_union_except", ("customer", "supplier"), "(SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
register_sql("sql_monthly", ("orders",), "SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS month, count(*) AS n, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders GROUP BY 1")


@query("pivot_status", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def pivot_status(spark, sf_dir):
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


@query("inspect_customer", "SELECT column_name, rows, non_null FROM (SELECT 'c_custkey' AS column_name, count(*) AS rows, count(c_custkey) AS non_null FROM customer UNION ALL SELECT 'c_nationkey', count(*), count(c_nationkey) FROM customer)")
def inspect_customer(spark, sf_dir):
    return t.inspect(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")).select("column_name", "rows", "non_null")


def _summary(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25,
    round(median({c}), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max, count(*) - count({c}) AS nulls FROM (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice FROM lineitem)"""


@query("numeric_summary", f"{_summary('l_quantity')} UNION ALL {_summary('l_extendedprice')}")
def numeric_summary(spark, sf_dir):
    found = t.numeric_summary(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"))
    return found.select("column_name", "count", *(F.round(c, 4).alias(c) for c in ("mean", "std", "min", "q25", "median", "q75", "max")), "nulls")


_COUNTS = """WITH c AS (SELECT 'event_type' AS column_name, event_type AS value, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'props', props, count(*) FROM events GROUP BY props)"""


@query("categorical_summary", f"""{_COUNTS}, r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS k FROM c WHERE value IS NOT NULL)
SELECT column_name, CAST(sum(n) AS BIGINT) AS count, count(*) AS distinct_values, max(CASE WHEN k = 1 THEN value END) AS mode, CAST(0 AS BIGINT) AS nulls FROM r GROUP BY column_name""")
def categorical_summary(spark, sf_dir):
    return t.categorical_summary(table(spark, sf_dir, "events"), "event_type", "props")


@query("top_values", f"""{_COUNTS}, r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank, 100.0 * n / sum(n) OVER (PARTITION BY column_name) AS percent FROM c WHERE value IS NOT NULL)
SELECT column_name, value, n, CAST(rank AS INTEGER) AS rank, round(CAST(percent AS DOUBLE), 6) AS percent FROM r WHERE rank <= 5""")
def top_values(spark, sf_dir):
    return t.top_values(table(spark, sf_dir, "events"), "event_type", "props").withColumn("percent", F.round(F.col("percent").cast("double"), 6))


@query("class_bars", """WITH c AS (SELECT CAST(p_size AS VARCHAR) AS v, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS k FROM c)
SELECT CASE WHEN k <= 12 THEN v ELSE 'other' END AS value, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def class_bars(spark, sf_dir):
    return t.folded_counts(table(spark, sf_dir, "part"), "p_size", 12)


@query("target_histogram", """WITH l AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT CAST(least(19, floor((value - lo) / ((hi - lo) / 20))) AS INTEGER) AS bin, count(*) AS n FROM events, l WHERE value IS NOT NULL GROUP BY 1""")
def target_histogram(spark, sf_dir):
    return t.histogram(table(spark, sf_dir, "events"), "value", 20).select("bin", "n")


@query("page_after", "SELECT event_id, event_type FROM events WHERE event_id > 400 ORDER BY event_id LIMIT 50")
def page_after(spark, sf_dir):
    return t.page_after(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 400, 50)


@query("page_before", "SELECT event_id, event_type FROM (SELECT * FROM events WHERE event_id < 400 ORDER BY event_id DESC LIMIT 50)")
def page_before(spark, sf_dir):
    return t.page_before(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 400, 50)


@query("page_has_more", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS position, TRUE AS has_more FROM customer QUALIFY position <= 20")
def page_has_more(spark, sf_dir):
    return t.has_more(table(spark, sf_dir, "customer"), [F.desc("c_acctbal"), "c_custkey"], 20).select("c_custkey", F.col("position").cast("long").alias("position"), "has_more")


@query("global_rank", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders")
def global_rank(spark, sf_dir):
    return t.ranked(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "place").select("o_orderkey", "place")


@query("evenly_spaced_rows", "SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS place, count(*) OVER () AS n FROM supplier) WHERE place IN (SELECT CAST(round_even(CAST(i AS DOUBLE) * (n - 1) / 10, 0) AS BIGINT) FROM range(0, 11) r(i))")
def evenly_spaced_rows(spark, sf_dir):
    return t.evenly_spaced(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"], 11).select("s_suppkey")


@query("curve_envelope", """WITH p AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
b AS (SELECT *, CASE WHEN n <= 20 THEN place ELSE floor(place * 10 / n) END AS bucket FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY value, event_id) AS lo, row_number() OVER (PARTITION BY user_id, bucket ORDER BY value DESC, event_id) AS hi FROM b)
SELECT user_id, event_id, value FROM r WHERE lo = 1 OR hi = 1""")
def curve_envelope(spark, sf_dir):
    return t.envelope(table(spark, sf_dir, "events").where("value IS NOT NULL"), "user_id", "event_id", "value", 20)


@query("index_ranges", """WITH d AS (SELECT DISTINCT o_custkey AS k, CAST(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) // 30 AS BIGINT) AS p FROM orders), i AS (SELECT k, p, p - row_number() OVER (PARTITION BY k ORDER BY p) AS g FROM d)
SELECT k, min(p) AS first, max(p) AS last, count(*) AS n FROM i GROUP BY k, g""")
def index_ranges(spark, sf_dir):
    months = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.floor(F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")) / 30).alias("p"))
    return t.islands(months, "k", "p")


@query("budget_prefix", "SELECT o_orderkey FROM (SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS used FROM orders) WHERE used <= 500000")
def budget_prefix(spark, sf_dir):
    return t.within_budget(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 500_000).select("o_orderkey")


@query("latest_per_key", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, sf_dir):
    return t.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("merge_changes", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0.0 ELSE CAST(c_acctbal AS DOUBLE) END AS balance FROM customer")
def merge_changes(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("balance"))
    return t.merge(base, base.where("c_custkey % 7 = 0").withColumn("balance", F.lit(0.0)), ["c_custkey"])


@query("storage_reconcile", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left_only' WHEN d.doc_id IS NULL THEN 'right_only' ELSE 'both' END AS state FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def storage_reconcile(spark, sf_dir):
    return t.reconcile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("typed_json_match", "SELECT event_id FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract_string(props, '$.k') AS BIGINT) = 3")
def typed_json_match(spark, sf_dir):
    return table(spark, sf_dir, "events").where(t.typed_match(F.col("props"), "k", 3)).select("event_id")


@query("name_search_page", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND p_size > 10 ORDER BY p_partkey LIMIT 40 OFFSET 10")
def name_search_page(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.lower("p_name").contains("a") & (F.col("p_size") > 10)).orderBy("p_partkey").offset(10).limit(40).select("p_partkey", "p_name")


@query("value_stats_by_config", """WITH s AS (SELECT l_returnflag AS config, avg(l_quantity) AS m, stddev_samp(l_quantity) AS d, min(l_quantity) AS lo, max(l_quantity) AS hi, row_number() OVER (ORDER BY l_returnflag) AS k FROM lineitem GROUP BY 1)
SELECT config, round(m, 6) AS mean, round(d, 6) AS std, CAST(lo AS DOUBLE) AS min, CAST(hi AS DOUBLE) AS max, round(m - (SELECT m FROM s WHERE k = 1), 6) AS delta FROM s""")
def value_stats_by_config(spark, sf_dir):
    stats = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("config")).agg(F.avg("l_quantity").cast("double").alias("m"), F.stddev_samp("l_quantity").alias("d"), F.min("l_quantity").cast("double").alias("min"), F.max("l_quantity").cast("double").alias("max"))
    first = F.first("m").over(Window.partitionBy().orderBy("config").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return stats.select("config", F.round("m", 6).alias("mean"), F.round("d", 6).alias("std"), "min", "max", F.round(F.col("m") - first, 6).alias("delta"))
