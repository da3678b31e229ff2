from pyspark.sql import functions as F

from spectrel.llm import common, lm


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


def op5_kneser_ney(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    model = lm.train(docs.where(~held_out()), common.new_folder(spark, "lm"))
    return lm.score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


