"""Named queries over the given tables and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrel.functions import kernels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ("tabular", "spectral", "selection", "knowledge", "rules", "sources", "records", "sqlfunctions")


def query(name: str, oracle: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under a name."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def load_all() -> None:
    """Import the modules that register queries."""
    from importlib import import_module

    for name in MODULES:
        import_module(f"spectrel.plans.{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "spectral_position_stats",
    """
    WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
    m AS (SELECT vec_id, e, list_avg(e) AS mu FROM x),
    s AS (SELECT vec_id, e, mu, sqrt(list_avg(list_transform(e, lambda v: (v - mu) * (v - mu)))) AS sd FROM m),
    p AS (SELECT unnest(range(0, len(e))) AS pos, unnest(list_transform(e, lambda v: CASE WHEN sd = 0 THEN 0 ELSE (v - mu) / sd END)) AS v FROM s)
    SELECT CAST(pos AS BIGINT) AS pos, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM p GROUP BY pos
    """,
)
def spectral_position_stats(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select(kernels.snv(F.col("embedding").cast("array<double>")).alias("x"))
    return (
        x.select(F.posexplode("x").alias("pos", "v"))
        .groupBy(F.col("pos").cast("long").alias("pos"))
        .agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"))
    )
