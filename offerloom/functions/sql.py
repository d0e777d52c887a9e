"""The Column rules as SQL functions, for users who write ``spark.sql``.

The body of a function is the SQL text that Spark itself gives for the Column rule, so that a rule is
stated once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from offerloom.functions import price, text, url

#: name -> (argument, its type, rule); rules without lambda functions, which have no SQL text.
SQL_FUNCTIONS: dict[str, tuple[str, str, Callable[[Column], Column]]] = {
    "parse_price": ("s", "STRING", price.parse_price),
    "parse_price_kopecks": ("s", "STRING", price.parse_price_kopecks),
    "title_key": ("s", "STRING", text.title_key),
    "url_host": ("u", "STRING", url.host),
    "url_path": ("u", "STRING", url.path),
    "url_query": ("u", "STRING", url.query_string),
    "url_key": ("u", "STRING", url.url_key),
    "is_ru_host": ("h", "STRING", url.is_ru),
    "is_blacklisted_host": ("h", "STRING", url.is_blacklisted),
    "is_fetch_blocked_host": ("h", "STRING", url.is_fetch_blocked),
}


def _body(spark: SparkSession, argument: str, kind: str, rule: Callable) -> tuple[str, str]:
    """Result type and SQL text of a rule."""
    frame = spark.createDataFrame([], f"{argument} {kind}").select(
        rule(F.col(argument)).alias("result")
    )
    plan = frame._jdf.queryExecution().analyzed()
    return frame.schema[0].dataType.simpleString(), plan.projectList().head().child().sql()


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions of this session and return their names."""
    for name, (argument, kind, rule) in SQL_FUNCTIONS.items():
        result, body = _body(spark, argument, kind, rule)
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({argument} {kind}) "
            f"RETURNS {result} RETURN {body}"
        )
    return list(SQL_FUNCTIONS)
