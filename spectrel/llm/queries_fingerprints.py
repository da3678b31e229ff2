from spectrel.llm import common, fingerprints


def op8_fingerprints(spark, sf_dir):
    return fingerprints.with_next(common.table(spark, sf_dir, "documents", "doc_id", "text"))
