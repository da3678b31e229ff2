from pyspark.sql import functions as F

from spectrel.llm import common, licenses


def op7_licenses(spark, sf_dir):
    found = licenses.scan(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"),
        F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score",
    )
