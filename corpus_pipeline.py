"""The training-data pipeline over documents: quality, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spectrel.llm import common, decontaminate, neardup, packing, pii, quality
from spectrel.llm.queries_packing import tokenizer_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier, learned on this stage's input, scores 0.5 or more."""
    net = quality.fit(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.keep_good(docs, net)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return neardup.keep_one(docs, words=5, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold ten consecutive words of a benchmark item (or all words of a shorter one)."""
    return decontaminate.remove(docs, common.table(spark, sf_dir, "benchmark", "item_id", "text"), window=10)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in every text."""
    return pii.redact(docs, pii.fit(docs.select("doc_id", "text")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 4096 tokens."""
    return packing.pack_digests(docs.select("doc_id", "text"), tokenizer_path(), size=4096, end_id=2)


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", clean), ("personal_data", private), ("packing", packed)]

#: SQL can express neither the networks nor the packing; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents", "*")
    for name, stage in STAGES:
        folder = common.new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
