"""Stored pages and request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.schemas import PAGES, REQUESTS


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def valid_pages(pages: DataFrame) -> DataFrame:
    """Pages answered below status 400 with a body of at least 200 characters."""
    return pages.where(
        (F.col("status") < 400) & (F.length("html") >= rules.MIN_PAGE_CHARS)
    )


def read_requests(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Request log of JSON lines, as a table or as a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(REQUESTS).json(path)
