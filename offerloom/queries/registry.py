"""Registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """Rows dealt to all tasks by key.

    A table of short rows is a few splits however many rows it has, so what is computed from them
    would keep a few cores busy.
    """
    spark = rows.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(shuffled, spark.sparkContext.defaultParallelism), *key)
