"""Whole jobs as SQL table functions, for users who write ``spark.sql``.

``register_jobs(spark, offers="shop.offers")`` makes ``SELECT * FROM price_summary('s1')`` and
``SELECT * FROM price_summary()`` run the job of that name over the table. The plan is the job's own,
laid down in a temporary view that the function reads: nothing runs before a query does, and a query for
one search filters the table before the job groups it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from offerloom.operators import summaries, urls

#: name -> job on a table of offers; each returns rows with ``search_id``.
OFFER_JOBS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "price_summary": summaries.price_summary,
    "source_groups": summaries.source_groups,
    "summary_rollup": summaries.summary_rollup,
}
#: name -> job on a table of links with ``search_id`` and ``url``.
LINK_JOBS: dict[str, Callable[[DataFrame], DataFrame]] = {"classified_urls": urls.classify_urls}


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _register(spark: SparkSession, name: str, result: DataFrame) -> None:
    view = f"_rows_of_{name}"
    result.createOrReplaceTempView(view)
    fields = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in result.schema)
    key = result.schema["search_id"].dataType.simpleString()
    columns = ", ".join(f"r.{_quoted(c)}" for c in result.columns)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(search {key} DEFAULT NULL) "
        f"RETURNS TABLE({fields}) RETURN SELECT {columns} FROM {view} r "
        f"WHERE {name}.search IS NULL OR r.search_id = {name}.search"
    )


def register_jobs(
    spark: SparkSession, offers: str | None = None, links: str | None = None
) -> list[str]:
    """Create the table functions over the named tables or views and return their names.

    The argument of each is one search, or null (the default) for all of them. Rows of searches
    without an id come with all searches only. An empty table gives no rows.
    """
    made = []
    for table, jobs in ((offers, OFFER_JOBS), (links, LINK_JOBS)):
        if table is not None:
            for name, job in jobs.items():
                _register(spark, name, job(spark.table(table)))
                made.append(name)
    return made
