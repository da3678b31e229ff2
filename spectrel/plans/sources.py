"""Queries of the source layer's expressions and of splits over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrel.operators import documents as d
from spectrel.operators import splits
from spectrel.plans.registry import query, table
from spectrel.sources import files


def _profile(c: str) -> str:
    gone = f"({c} IS NULL OR lower(trim(CAST({c} AS VARCHAR))) IN ('', 'na', 'n/a', 'nan', 'null', 'none', '-', '--'))"
    return f"SELECT '{c}' AS column_name, round(coalesce(avg(CASE WHEN NOT {gone} THEN CASE WHEN try_cast(trim(CAST({c} AS VARCHAR)) AS DOUBLE) IS NULL THEN 0.0 ELSE 1.0 END END), 0), 6) AS numeric_share, count(*) FILTER (WHERE {gone}) AS missing, count(DISTINCT CASE WHEN NOT {gone} THEN CAST({c} AS VARCHAR) END) AS distinct_values FROM documents"


@query("column_profile", " UNION ALL ".join(map(_profile, ("doc_id", "lang", "source"))))
def column_profile(spark, sf_dir):
    p = files.profile(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"))
    return p.select("column_name", F.round("numeric_share", 6).alias("numeric_share"), "missing", "distinct_values")


@query("markdown_rows", "SELECT '| ' || CAST(n_nationkey AS VARCHAR) || ' | ' || replace(n_name, '|', '\\|') || ' |' AS line FROM nation UNION ALL SELECT '| ' || CAST(s_suppkey AS VARCHAR) || ' | ' || replace(s_name, '|', '\\|') || ' |' FROM supplier")
def markdown_rows(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    return n.select(files.markdown_row([F.col("n_nationkey"), F.col("n_name")]).alias("line")).unionByName(s.select(files.markdown_row([F.col("s_suppkey"), F.col("s_name")]).alias("line")))


@query("parsed_numbers", "SELECT event_id, round(value, 4) AS v FROM events")
def parsed_numbers(spark, sf_dir):
    """Numbers written with a decimal comma and a Unicode minus, read back."""
    text = F.replace(F.replace(F.format_string("%.6f", "value"), F.lit("."), F.lit(",")), F.lit("-"), F.lit("−"))
    return table(spark, sf_dir, "events").select("event_id", F.round(files.number(text, ","), 4).alias("v"))


@query("fold_numbers", "SELECT vec_id, CAST(CAST('0x' || substr(md5('42|' || CAST(vec_id AS VARCHAR)), 1, 15) AS BIGINT) % 5 AS INTEGER) AS fold FROM embeddings")
def fold_numbers(spark, sf_dir):
    return splits.folds(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 5)


@query("straddling_groups", "SELECT user_id, count(DISTINCT event_type) AS n_roles FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def straddling_groups(spark, sf_dir):
    return splits.straddling_groups(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("page_outline", "SELECT page_id, trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)) AS title, length(html) AS n_chars FROM pages")
def page_outline(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", d.html_title(F.col("html")).alias("title"), F.length("html").cast("long").alias("n_chars"))


@query("metadata_merge", "SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN 'patched' END, lang) AS lang, source FROM documents")
def metadata_merge(spark, sf_dir):
    """A patch of metadata by id and content digest, right side first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("meta"))
    patch = docs.where("doc_id % 4 = 0").select("doc_id", "sha", F.create_map(F.lit("lang"), F.lit("patched")).alias("new"))
    joined = docs.join(patch, ["doc_id", "sha"], "left")
    meta = F.map_concat(F.map_filter("meta", lambda k, v: ~F.map_contains_key(F.coalesce("new", F.create_map().cast("map<string,string>")), k)), F.coalesce("new", F.create_map().cast("map<string,string>")))
    return joined.select("doc_id", meta.alias("m")).select("doc_id", F.col("m")["lang"].alias("lang"), F.col("m")["source"].alias("source"))


@query("lineage_recovery", "WITH m AS (SELECT doc_id, text, count(*) OVER (PARTITION BY text) AS n FROM documents) SELECT doc_id, CASE WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS state FROM m")
def lineage_recovery(spark, sf_dir):
    """Which stored content each row comes from, by digest; several candidates are ambiguous."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    n = docs.groupBy("sha").agg(F.count(F.lit(1)).alias("n"))
    return docs.join(n, "sha").select("doc_id", F.when(F.col("n") == 1, "found").otherwise("ambiguous").alias("state"))


@query("usage_by_owner", "SELECT source AS owner, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(sum(octet_length(encode(text))) AS DOUBLE) / 1000000 > 0.2 AS over_quota FROM documents GROUP BY source")
def usage_by_owner(spark, sf_dir):
    by = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("owner")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).alias("bytes"))
    return by.withColumn("over_quota", F.col("bytes") / 1_000_000 > 0.2)
