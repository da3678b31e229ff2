from pyspark.sql import functions as F

from spectrel.llm import common, neardup


def op9_near_duplicates(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    found = neardup.components_of(docs, words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
