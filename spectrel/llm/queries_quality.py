from pyspark.sql import functions as F

from spectrel.llm import common, quality


def op3_quality(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    net = quality.fit(docs, common.table(spark, sf_dir, "labels", "doc_id", "quality"))
    found = quality.classify(docs, net)
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
