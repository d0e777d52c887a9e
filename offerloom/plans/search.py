"""From searches and the offers of all sources to one response document per search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.operators.searching import normalise_queries
from offerloom.operators.summaries import response_documents
from offerloom.sources.dims import gate_sources


def source_texts(normalised: DataFrame) -> DataFrame:
    """Text each kind of source is asked: marketplaces the original, other shops the corrected."""
    return normalised.select(
        "search_id",
        "region_id",
        F.col("original").alias("marketplace_text"),
        F.col("corrected").alias("other_text"),
    )


def search_responses(
    searches: DataFrame,
    offers: Sequence[DataFrame],
    corrections: DataFrame | None = None,
    outcomes: DataFrame | None = None,
    enabled: Sequence[str] | None = None,
) -> DataFrame:
    """Nested response of every search: query, summary, ordered groups with offers.

    ``offers`` are tables in the canonical schema, one or more per source; ``outcomes`` gives
    errors and states of sources (search_id, source, error, status).
    """
    normalised = normalise_queries(searches, corrections)
    queries = normalised.select(
        "search_id", "original", "corrected", F.col("region_id").alias("region"), "region_name"
    )
    merged = gate_sources(reduce(DataFrame.unionByName, offers), enabled)
    return response_documents(queries, merged, outcomes, enabled=enabled)
