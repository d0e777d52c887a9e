"""Sitemaps: plain or gzipped XML, indexes and their product URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions import url as u
from offerloom.functions.query import classify_slug
from offerloom.functions.text import has
from offerloom.operators.ranking import first_by, top_n


def _read(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return (
        spark.read.format("xml")
        .option("rowTag", row_tag)
        .option("ignoreNamespace", "true")
        .option("mode", "DROPMALFORMED")
        .schema("loc string")
        .load(path)
        .select(F.trim("loc").alias("loc"), F.input_file_name().alias("file"))
        .where(F.coalesce("loc", F.lit("")) != "")
    )


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """Page locations; a truncated file gives its complete entries."""
    return _read(spark, path, "url")


def read_sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    """Locations of child sitemaps."""
    return _read(spark, path, "sitemap")


def product_urls(locs: DataFrame, per_domain: int) -> DataFrame:
    """First product URLs of each domain's own sitemap, distinct by URL.

    ``locs``: domain, position, loc.
    """
    own = F.regexp_replace(F.lower("domain"), r"www\.", "")
    host = F.replace(u.netloc(F.col("loc")), F.lit("www."), F.lit(""))
    usable = locs.where(F.contains(host, own) & u.is_sitemap_product(F.col("loc")))
    distinct = first_by(usable, ["domain", "loc"], [F.asc("position")])
    return top_n(distinct, ["domain"], [F.asc("position")], per_domain)


def expand_sitemap_index(
    index: DataFrame, children: DataFrame, per_domain: int, max_children: int | None = None
) -> DataFrame:
    """Product URLs of the child sitemaps an index names.

    ``index``: domain, position, loc (child sitemaps and stray pages); ``children``:
    parent_sitemap, position, loc. Only children that look like product sitemaps are read,
    pages named in the index itself come first.
    """
    named = index.where(has(F.col("loc"), f"(?:{rules.SITEMAP_CHILD})"))
    if max_children is not None:
        named = top_n(named, ["domain"], [F.asc("position")], max_children)
    named = named.select(
        "domain", F.col("position").alias("_c"), F.col("loc").alias("parent_sitemap")
    )
    below = children.join(named, "parent_sitemap").select(
        "domain", F.struct(F.lit(1).alias("t"), F.col("_c").cast("bigint").alias("c"),
                           F.col("position").cast("bigint").alias("p")).alias("position"), "loc"
    )
    direct = index.select(
        "domain", F.struct(F.lit(0).alias("t"), F.lit(0).cast("bigint").alias("c"),
                           F.col("position").cast("bigint").alias("p")).alias("position"), "loc"
    )
    return product_urls(direct.unionByName(below), per_domain)


def market_products(
    locs: DataFrame, limit: int | None = None, categories: Sequence[str] | None = None
) -> DataFrame:
    """Marketplace product URLs, first of each numeric id, in no order.

    ``locs``: position, loc. ``limit`` keeps the first of all in order of position.
    """
    parsed = locs.select(
        "position", F.col("loc").alias("url"), u.market_product(F.col("loc")).alias("_m")
    ).where(F.col("_m").isNotNull())
    products = parsed.select(
        "position", "url", "_m.slug", "_m.numeric_id", classify_slug(F.col("_m.slug")).alias("category")
    )
    if categories is not None:
        products = products.where(F.col("category").isin(*categories))
    distinct = first_by(products, ["numeric_id"], [F.asc("position")])
    return distinct if limit is None else distinct.orderBy("position").limit(limit)
