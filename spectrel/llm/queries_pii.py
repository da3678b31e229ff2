from pyspark.sql import functions as F

from spectrel.llm import common, pii


def joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number_of(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op1_pii(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    found = pii.scan(docs, pii.fit(docs))
    return found.select("doc_id", *(number_of(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
