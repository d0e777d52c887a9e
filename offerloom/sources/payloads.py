"""Stored search-API answers as offers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions import offer as o
from offerloom.functions import price as p
from offerloom.functions import url as u
from offerloom.schemas import PAYLOAD


def read_payload_products(payloads: DataFrame, limit: int = rules.MAX_PER_SOURCE) -> DataFrame:
    """Products of each answer in order.

    Top-level products win; the nested list counts only with at least five items, because
    throttled answers hold a single unrelated one.
    """
    parsed = payloads.withColumn("_p", F.from_json("body", PAYLOAD))
    top, nested = F.col("_p.products"), F.col("_p.data.products")
    chosen = F.when(F.coalesce(F.size(top), F.lit(0)) > 0, top).when(
        F.coalesce(F.size(nested), F.lit(0)) >= rules.MIN_NESTED_PRODUCTS, nested
    )
    return parsed.select(
        "search_id", F.posexplode(F.slice(chosen, 1, limit)).alias("position", "product")
    )


def payload_offers(products: DataFrame) -> DataFrame:
    """Canonical offers; products without id, name or a positive price are dropped."""
    product = F.col("product")
    zero = F.lit(0).cast("bigint")

    def first_positive(*columns):
        return F.coalesce(*[F.when(c != 0, c) for c in columns])

    rated = products.select(
        "search_id",
        F.col("position").cast("bigint").alias("position"),
        product["id"].alias("article"),
        product["name"].alias("title"),
        p.payload_price(product).alias("price"),
        o.payload_characteristics(product).alias("characteristics"),
        first_positive(
            product["reviewRating"], product["nmReviewRating"], product["rating"]
        ).alias("rating"),
        first_positive(product["nmFeedbacks"], product["feedbacks"]).alias("reviews_count"),
    ).where(
        (F.coalesce("article", zero) != 0)
        & (F.coalesce("title", F.lit("")) != "")
        & (F.col("price") > 0)
    )
    return rated.select(
        "search_id",
        F.lit("wildberries").alias("source"),
        "position",
        F.lit("wildberries.ru").alias("source_domain"),
        "title",
        o.payload_description(
            F.col("characteristics"), F.col("rating"), F.col("reviews_count")
        ).alias("description"),
        "price",
        F.lit("RUB").alias("currency"),
        u.cdn_image_url(F.col("article")).alias("image_url"),
        F.format_string(
            "https://www.wildberries.ru/catalog/%d/detail.aspx", F.col("article")
        ).alias("product_url"),
        "characteristics",
        "rating",
        "reviews_count",
        F.lit(0.0).alias("relevance_score"),
        F.lit(rules.CONFIDENCE["payload"]).alias("confidence"),
    )
