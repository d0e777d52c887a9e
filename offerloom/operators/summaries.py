"""Price summaries and per-source groups of a search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.operators.ranking import exact_ranks, lower_middle, top_n, upper_middle
from offerloom.schemas import PRODUCT_FIELDS
from offerloom.sources.dims import sources_dim

_MIDDLES = {"_low": (0.5, lower_middle), "_high": (0.5, upper_middle)}


def priced(offers: DataFrame) -> DataFrame:
    return offers.where(F.col("price") > 0)


def _medians(offers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with the two middle prices ``_low`` and ``_high`` of the priced offers."""
    return exact_ranks(priced(offers), keys, "price", _MIDDLES).drop("n")


def price_summary(offers: DataFrame, keys: Sequence[str] = ("search_id",)) -> DataFrame:
    """Count, minimum, floored median and maximum of the positive prices per key.

    Keys without priced offers stay, with 0 and NULLs.
    """
    keys = list(keys)
    price = F.when(F.col("price") > 0, F.col("price"))
    totals = offers.groupBy(*keys).agg(
        F.count(price).alias("total_found"),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
    )
    return totals.join(_medians(offers, keys), keys, "left").select(
        *keys, "total_found", "min_price", _middle().alias("median_price"), "max_price"
    )


def _middle() -> Column:
    """Floor of the mean of two integers without leaving the integers."""
    return F.expr("(_low + _high) div 2")


def source_groups(
    offers: DataFrame, keys: Sequence[str] = ("search_id", "source")
) -> DataFrame:
    """Offer count, minimum over all prices (zeros too) and sorted distinct shops per group.

    The shops are made distinct before they are gathered, so a group's array holds its
    shops, never its offers.
    """
    keys = list(keys)
    per_shop = offers.groupBy(*keys, "source_domain").agg(
        F.count("*").alias("_n"), F.min("price").alias("_min")
    )
    return per_shop.groupBy(*keys).agg(
        F.sum("_n").alias("count"),
        F.min("_min").alias("min_price"),
        F.array_sort(F.collect_set(F.nullif(F.col("source_domain"), F.lit("")))).alias("domains"),
    )


def summary_rollup(offers: DataFrame) -> DataFrame:
    """Per-source and overall figures of a search in one table.

    ``level`` is 0 for one source and 1 for the whole search (``source`` is NULL there).
    Offers are first combined per (search, source, price), then both levels are formed
    from the combined rows.
    """
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.col("source").alias("src")),
        F.struct(F.lit(1).alias("level"), F.lit(None).cast("string").alias("src")),
    )
    price = F.when(F.col("price") > 0, F.col("price"))
    totals = (
        offers.groupingSets(
            [("search_id", "source"), ("search_id",)], "search_id", "source"
        )
        .agg(
            F.grouping("source").cast("int").alias("level"),
            F.count("*").alias("count"),
            F.count(price).alias("total_found"),
            F.min(price).alias("min_price"),
            F.max(price).alias("max_price"),
        )
    )
    leveled = offers.select(
        "search_id", "price", F.explode(levels).alias("_l")
    ).select("search_id", F.col("_l.level").alias("level"), F.col("_l.src").alias("source"), "price")
    middles = _medians(
        leveled.withColumn("_src", F.coalesce("source", F.lit(""))), ["search_id", "level", "_src"]
    )
    return (
        totals.withColumn("_src", F.coalesce("source", F.lit("")))
        .join(middles, ["search_id", "level", "_src"], "left")
        .select(
            "search_id", "source", "level", "count", "total_found", "min_price",
            _middle().alias("median_price"), "max_price",
        )
    )


def partial_summary(groups: DataFrame, offers: DataFrame) -> DataFrame:
    """Summary of what has arrived so far: stated counts, rounded median.

    ``groups`` has ``search_id, source, count``; ``offers`` the offers received. The total
    takes the larger of the stated and the received count of each source.
    """
    received = offers.groupBy("search_id", "source").agg(F.count("*").alias("_received"))
    totals = (
        groups.join(received, ["search_id", "source"], "full")
        .groupBy("search_id")
        .agg(
            F.sum(
                F.greatest(F.coalesce("count", F.lit(0)), F.coalesce("_received", F.lit(0)))
            ).alias("total_found")
        )
    )
    prices = priced(offers).groupBy("search_id").agg(
        F.min("price").alias("min_price"), F.max("price").alias("max_price")
    )
    return (
        totals.join(prices, "search_id", "left")
        .join(_medians(offers, ["search_id"]), "search_id", "left")
        .select(
            "search_id", "total_found", "min_price",
            F.expr("(_low + _high + 1) div 2").alias("median_price"), "max_price",
        )
    )


def order_groups(groups: DataFrame, enabled: Sequence[str] | None = None) -> DataFrame:
    """Attach display name and canonical order, keep enabled sources."""
    dim = sources_dim(groups.sparkSession, enabled)
    return groups.join(F.broadcast(dim), "source")


def fill_sources(
    groups: DataFrame, searches: DataFrame, enabled: Sequence[str] | None = None
) -> DataFrame:
    """Every enabled source once per search; sources without offers get zero groups."""
    slots = searches.select("search_id").withColumn("_slot", F.explode(_source_slots(enabled)))
    slots = slots.select("search_id", "_slot.*")
    return (
        slots.join(groups, ["search_id", "source"], "left")
        .withColumn("count", F.coalesce("count", F.lit(0)))
        .withColumn("domains", F.coalesce("domains", F.array().cast("array<string>")))
    )


def arrived_sources(groups: DataFrame, enabled: Sequence[str] | None = None) -> DataFrame:
    """Progress view: only the sources that have answered, in canonical order columns."""
    return order_groups(groups, enabled)


def _source_slots(enabled: Sequence[str] | None) -> Column:
    chosen = [s for s in rules.SOURCES if not enabled or "*" in enabled or s[0] in enabled]
    return F.array(
        *[
            F.struct(
                F.lit(source).alias("source"),
                F.lit(name).alias("display_name"),
                F.lit(order).alias("ord"),
            )
            for source, name, order in chosen
        ]
    )


def empty_response(searches: DataFrame, enabled: Sequence[str] | None = None) -> DataFrame:
    """One zero group per enabled source for each search."""
    return searches.select("search_id", F.explode(_source_slots(enabled)).alias("_s")).select(
        "search_id",
        "_s.*",
        F.lit(0).cast("bigint").alias("count"),
        F.lit(None).cast("bigint").alias("min_price"),
        F.array().cast("array<string>").alias("domains"),
    )


def final_status(status: Column, count: Column, error: Column) -> Column:
    """Explicit status, else complete / error / empty from the outcome."""
    return F.coalesce(
        F.nullif(status, F.lit("")),
        F.when(count > 0, "complete")
        .when(F.coalesce(error, F.lit("")) != "", "error")
        .otherwise("empty"),
    )


def with_diagnostics(groups: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Give empty ``other`` groups without an error their diagnosis text and status."""
    joined = groups.join(diagnoses.select("search_id", "diagnosis"), "search_id", "left")
    silent = (
        (F.col("source") == "other")
        & (F.col("count") == 0)
        & (F.coalesce("error", F.lit("")) == "")
        & F.col("diagnosis").isNotNull()
    )
    return (
        joined.withColumns(
            {
                "error": F.when(silent, F.col("diagnosis")).otherwise(F.col("error")),
                "status": F.when(silent, F.lit("empty_with_diagnostics")).otherwise(
                    F.col("status")
                ),
            }
        )
        .drop("diagnosis")
    )


def response_documents(
    searches: DataFrame,
    offers: DataFrame,
    outcomes: DataFrame | None = None,
    per_source: int = rules.MAX_PER_SOURCE,
    enabled: Sequence[str] | None = None,
) -> DataFrame:
    """One nested document per search: query, summary, groups with their offers.

    Counts, domains and the summary are those of all offers. A group's products are cut to
    ``per_source`` (the feature's limit), so a document holds at most that many offers for each
    of the few sources.

    ``searches`` needs search_id, original, corrected, region, region_name;
    ``outcomes`` may give (search_id, source, error, status).
    """
    capped = top_n(offers, ["search_id", "source"], [F.col("position")], per_source)
    product = F.struct(F.col("position"), *[F.col(c) for c in PRODUCT_FIELDS])
    counted = offers.groupBy("search_id", "source").agg(
        F.count("*").alias("count"),
        F.min("price").alias("min_price"),
        F.array_sort(F.collect_set(F.nullif(F.col("source_domain"), F.lit("")))).alias("domains"),
    )
    shown = capped.groupBy("search_id", "source").agg(F.collect_list(product).alias("_products"))
    groups = counted.join(shown, ["search_id", "source"])
    by_position = F.array_sort(
        "_products", lambda a, b: F.when(a["position"] < b["position"], -1).otherwise(1)
    )
    groups = groups.withColumn(
        "products",
        F.transform(by_position, lambda p: F.struct(*[p[c].alias(c) for c in PRODUCT_FIELDS])),
    ).drop("_products")
    if outcomes is None:
        groups = groups.withColumn("error", F.lit(None).cast("string")).withColumn(
            "status", F.lit(None).cast("string")
        )
    else:
        groups = groups.join(outcomes, ["search_id", "source"], "full").withColumn(
            "count", F.coalesce("count", F.lit(0))
        )
    groups = order_groups(groups, enabled).withColumn(
        "status", final_status(F.col("status"), F.col("count"), F.col("error"))
    )
    group_struct = F.struct(
        "ord", "source", "display_name", "count", "min_price", "domains", "products", "error",
        "status", F.lit(per_source).alias("expected_max"),
    )
    per_search = groups.groupBy("search_id").agg(F.collect_list(group_struct).alias("_groups"))
    ordered_groups = F.array_sort(
        "_groups", lambda a, b: F.when(a["ord"] < b["ord"], -1).otherwise(1)
    )
    figures = ("total_found", "min_price", "median_price", "max_price")
    found = price_summary(offers)
    summary = per_search.select("search_id", ordered_groups.alias("groups")).join(
        found.select("search_id", F.struct(*figures).alias("summary")), "search_id", "left"
    )
    return searches.join(summary, "search_id", "left").select(
        "search_id",
        F.struct("original", "corrected", "region", "region_name").alias("query"),
        "summary",
        F.coalesce(F.col("groups"), F.array()).alias("groups"),
    )


def write_responses(documents: DataFrame, path: str) -> None:
    """Write the nested documents as JSON lines."""
    documents.write.mode("overwrite").json(path)
