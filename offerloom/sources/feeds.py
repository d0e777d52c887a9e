"""Shop feeds in three parts: id lists per search, prices and details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions import offer as o
from offerloom.functions import price as p
from offerloom.functions.text import strip, strip_markup
from offerloom.operators.ranking import first_by

_IDS = "struct<body:struct<products:array<string>>>"
_PRICES = (
    "struct<body:struct<materialPrices:array<struct<productId:string,"
    "price:struct<salePrice:bigint,basePromoPrice:bigint,basePrice:bigint>>>>>"
)
_DETAILS = (
    "struct<body:struct<productId:string,name:string,description:string,"
    "nameTranslit:string,images:array<string>>>"
)


def read_feed_ids(feed: DataFrame, limit: int = 5) -> DataFrame:
    ids = F.filter(
        F.from_json("body", _IDS)["body"]["products"],
        lambda x: x.isNotNull() & ~x.isin("", "0"),
    )
    return feed.select(
        "search_id", F.posexplode(F.slice(ids, 1, limit)).alias("position", "product_id")
    )


def read_feed_prices(feed: DataFrame) -> DataFrame:
    """Rubles per product: sale, then promo, then base price; the newest answer wins."""
    items = feed.select(
        "fetched_at",
        F.posexplode(F.from_json("body", _PRICES)["body"]["materialPrices"]).alias("_i", "item"),
    ).select(
        "fetched_at",
        "_i",
        F.col("item.productId").alias("product_id"),
        p.feed_price(
            F.col("item.price.salePrice"),
            F.col("item.price.basePromoPrice"),
            F.col("item.price.basePrice"),
        ).alias("price_rub"),
    )
    usable = items.where((F.coalesce("product_id", F.lit("")) != "") & F.col("price_rub").isNotNull())
    return first_by(usable, ["product_id"], [F.desc("fetched_at"), F.desc("_i")]).select(
        "product_id", "price_rub"
    )


def read_feed_details(feed: DataFrame) -> DataFrame:
    body = F.from_json("body", _DETAILS)["body"]
    rows = feed.select("fetched_at", body.alias("b")).where(F.col("b.productId").isNotNull())
    newest = first_by(
        rows.withColumn("product_id", F.col("b.productId")), ["product_id"], [F.desc("fetched_at")]
    )
    return newest.select(
        "product_id",
        strip(F.coalesce("b.name", F.lit(""))).alias("title"),
        strip_markup(F.col("b.description")).alias("description"),
        o.feed_image(F.get("b.images", 0)).alias("image_url"),
        o.feed_url(F.col("b.productId"), F.col("b.nameTranslit")).alias("product_url"),
    )


def join_feeds(ids: DataFrame, prices: DataFrame, details: DataFrame) -> DataFrame:
    """Feed offers of each search; without price or title an id is dropped."""
    return (
        ids.join(prices, "product_id")
        .join(details.where(F.col("title") != ""), "product_id")
        .withColumns(
            {
                "source_domain": F.lit("www.mvideo.ru"),
                "confidence": F.lit(rules.CONFIDENCE["feed"]),
                "method": F.lit("feed"),
                "relevance_score": F.lit(0.0),
            }
        )
    )


def read_feed_triplet(
    ids: DataFrame, prices: DataFrame, details: DataFrame, limit: int = 5
) -> DataFrame:
    return join_feeds(read_feed_ids(ids, limit), read_feed_prices(prices), read_feed_details(details))
