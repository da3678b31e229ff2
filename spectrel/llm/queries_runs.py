import zlib

import numpy as np
from pyspark.sql import functions as F

from spectrel.llm import common, runs


def planted(doc_id, n):
    """For a tenth of the documents, by the digest of their id: the words from one on repeat a shorter stretch."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op11_periodic_runs(spark, sf_dir):
    found = runs.find(common.table(spark, sf_dir, "documents", "doc_id", "text"), planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        digest(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
