"""Small fixed dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions.query import resolve_region


def regions_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(rules.REGIONS),
        "region_id string, region_name string, market_id int, delivery_code int, "
        "city_name string, search_keyword string",
    )


def region_list(spark: SparkSession) -> DataFrame:
    """Region choices: id and name."""
    return regions_dim(spark).select(
        F.col("region_id").alias("id"), F.col("region_name").alias("name")
    )


def parse_enabled(setting: str | None) -> list[str] | None:
    """Comma-separated source list; empty or ``*`` enables all (None)."""
    text = (setting or "").strip()
    if not text or text == "*":
        return None
    return [part.strip() for part in text.split(",") if part.strip()]


def sources_dim(spark: SparkSession, enabled: Sequence[str] | None = None) -> DataFrame:
    """Sources with display name and canonical order, reduced to the enabled ones."""
    rows = [s for s in rules.SOURCES if not enabled or "*" in enabled or s[0] in enabled]
    return spark.createDataFrame(rows, "source string, display_name string, ord int")


def domain_rules_dim(spark: SparkSession) -> DataFrame:
    """One row per rule and domain, ``ord`` telling which rule comes first."""
    rows = [
        (domain, name, list(categories), group, listing, challenge, order)
        for order, (name, domains, categories, group, listing, challenge) in enumerate(
            rules.DOMAIN_RULES
        )
        for domain in domains
    ]
    return spark.createDataFrame(
        rows,
        "rule_domain string, rule string, categories array<string>, canonical_group string, "
        "has_listing boolean, has_challenge boolean, ord int",
    )


def cdn_ranges_dim(spark: SparkSession) -> DataFrame:
    """Article volume ranges ``lo < volume <= hi`` with their image host number."""
    highs = [high for high, _ in rules.CDN_RANGES]
    lows = [-1, *highs[:-1]]
    rows = [(lo, high, host) for lo, (high, host) in zip(lows, rules.CDN_RANGES)]
    return spark.createDataFrame(rows, "lo bigint, hi bigint, host int")


def with_region(df: DataFrame, region_col: str = "region") -> DataFrame:
    """Resolve the region id and add the region's columns."""
    resolved = df.withColumn("region_id", resolve_region(F.coalesce(region_col, F.lit(""))))
    return resolved.join(F.broadcast(regions_dim(df.sparkSession)), "region_id", "left")


def gate_sources(df: DataFrame, enabled: Sequence[str] | None) -> DataFrame:
    """Rows of the enabled sources; nothing set keeps all."""
    if not enabled or "*" in enabled:
        return df
    return df.where(F.col("source").isin(*enabled))


def gate_region(df: DataFrame, region: Column, allowed: str = rules.DEFAULT_REGION) -> DataFrame:
    """Rows of the one region a feed serves."""
    return df.where(region == allowed)
