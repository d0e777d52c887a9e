"""URL classification as one projection over any table with a URL column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions import url as u
from offerloom.operators.planning import computed_once


def url_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host, path and query_string."""
    c = F.col(url_col)
    return computed_once(
        df, {"host": u.host(c), "path": u.path(c), "query_string": u.query_string(c)}
    )


def url_kinds(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add the URL parts and the flags rejected, product and listing."""
    c = F.col(url_col)
    host, path = F.col("host"), F.col("path")
    rejected, product = F.col("rejected"), F.col("product")
    flagged = computed_once(
        url_parts(df, url_col),
        {
            "rejected": u.is_rejected(c, host, path, F.col("query_string")),
            "product": u.looks_like_product(path),
        },
    )
    return computed_once(flagged, {"listing": u.looks_like_listing(path, rejected, product)})


def classify_urls(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add the page-kind flags and scores of every URL.

    Parts are computed once, then the flags that build on them, then the scores; no shuffle
    and no Python.
    """
    host, path = F.col("host"), F.col("path")
    rejected, product = F.col("rejected"), F.col("product")
    return url_kinds(df, url_col).withColumns(
        {
            "is_ru": u.is_ru(host),
            "fetch_blocked": u.is_fetch_blocked(host),
            "blacklisted": u.is_blacklisted(host),
            "depth_bonus": u.depth_bonus(path),
            "is_grid": u.is_grid(path, rejected, product),
            "grid_priority": u.grid_priority(host, path),
            "domain_rule": u.domain_rule(host),
            "listing_key": u.listing_key(host),
            "quality": u.quality(host, path, rejected, product, F.col("listing")),
        }
    )


def attach_domain_rules(df: DataFrame, domain_rules: DataFrame, host_col: str = "host") -> DataFrame:
    """First matching rule of a rule table of any size.

    The suffix test becomes an equi join: each distinct host is exploded into its label
    suffixes and looked up, so nothing compares every host with every rule.
    """
    hosts = df.select(F.col(host_col).alias("_host")).distinct()
    suffixed = hosts.select("_host", F.explode(u.host_suffixes(F.col("_host"))).alias("rule_domain"))
    matched = suffixed.join(domain_rules, "rule_domain")
    first = (
        matched.groupBy("_host")
        .agg(
            F.min_by(
                F.struct("rule", "categories", "canonical_group", "has_listing", "has_challenge"),
                "ord",
            ).alias("_r")
        )
        .select("_host", "_r.*")
    )
    return (
        df.join(first, F.col(host_col) == F.col("_host"), "left")
        .drop("_host")
        .withColumn("listing_key", F.coalesce("canonical_group", F.col(host_col)))
    )


def final_offers(offers: DataFrame) -> DataFrame:
    """Offers whose URL is not a listing and whose title or URL is not a category page.

    Takes ``title`` and ``product_url``; adds nothing.
    """
    keep = offers.columns
    classified = url_kinds(offers.drop("host", "path", "query_string"), "product_url")
    category = u.is_category_listing(F.col("title"), F.col("path"), F.col("product"))
    return classified.where(~F.col("listing") & ~category).select(
        *[c for c in keep if c in classified.columns]
    )


def range_join(
    df: DataFrame, value: str, ranges: DataFrame, width: int, lo: str = "lo", hi: str = "hi"
) -> DataFrame:
    """Join each value to the range ``lo < value <= hi`` that holds it.

    Ranges are cut into buckets of ``width`` and joined on the bucket, with the range test as
    the rest: an equi join instead of comparing all values with all ranges.
    """
    cut = ranges.withColumn(
        "_bucket",
        F.explode(
            F.sequence(
                F.floor((F.col(lo) + 1) / width).cast("bigint"),
                F.floor(F.col(hi) / width).cast("bigint"),
            )
        ),
    )
    bucketed = df.withColumn("_bucket", F.floor(F.col(value) / width).cast("bigint"))
    inside = (
        (bucketed["_bucket"] == cut["_bucket"])
        & (F.col(value) > F.col(lo))
        & (F.col(value) <= F.col(hi))
    )
    return bucketed.join(cut, inside, "left").drop("_bucket")


def cdn_images(df: DataFrame, ranges: DataFrame, article: str = "article") -> DataFrame:
    """Image host and URL per article number from a range table.

    Articles above the table get the last host plus one, clamped like the rest.
    """
    volumes = df.withColumn("_volume", F.floor(F.col(article) / 100_000).cast("bigint"))
    joined = range_join(volumes, "_volume", ranges, 256)
    number = F.least(
        F.lit(rules.CDN_MAX),
        F.greatest(
            F.lit(rules.CDN_MIN), F.coalesce("host", F.lit(rules.CDN_RANGES[-1][1] + 1))
        ),
    )
    return (
        joined.withColumn("cdn_host", number)
        .withColumn("image_url", u.cdn_image_url(F.col(article), F.col("cdn_host")))
        .drop("_volume", "lo", "hi", "host")
    )
