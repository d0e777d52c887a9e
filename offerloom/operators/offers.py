"""Canonical offers per source, enrichment and quality labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions import offer as o
from offerloom.functions import url as u
from offerloom.operators.ranking import first_by
from offerloom.schemas import OFFER_COLUMNS

_DEFAULTS = {
    "description": ("string", ""),
    "currency": ("string", "RUB"),
    "image_url": ("string", ""),
    "characteristics": ("map<string,string>", None),
    "rating": ("double", None),
    "reviews_count": ("bigint", None),
    "relevance_score": ("double", 0.0),
    "confidence": ("double", 1.0),
}


def to_offers(df: DataFrame, source: str) -> DataFrame:
    """Project onto the offer schema.

    ``price_rub`` (rubles) becomes kopecks, missing columns and values get their defaults.
    """
    out = df.withColumn("source", F.lit(source))
    if "price" not in out.columns:
        out = out.withColumn("price", F.coalesce(F.col("price_rub"), F.lit(0)) * 100)
    for name, (kind, default) in _DEFAULTS.items():
        value = (
            F.create_map().cast(kind)
            if name == "characteristics"
            else F.lit(default).cast(kind)
        )
        current = F.col(name).cast(kind) if name in out.columns else None
        out = out.withColumn(name, value if current is None else F.coalesce(current, value))
    return out.select(
        *[
            F.col(c).cast("bigint").alias(c) if c in ("price", "position") else F.col(c)
            for c in OFFER_COLUMNS
        ]
    )


def page_meta_offers(meta: DataFrame) -> DataFrame:
    """Marketplace offers from page metadata; a missing price gives 0 and a marker."""
    marked = meta.withColumn(
        "characteristics",
        o.mark_incomplete(
            F.map_filter(
                F.create_map(
                    F.lit("availability"), F.col("availability"),
                    F.lit("currency"), F.col("currency"),
                ),
                lambda k, v: v.isNotNull(),
            ),
            F.col("price_rub"),
        ),
    ).withColumn("incomplete", F.col("price_rub").isNull())
    projected = marked.where(F.col("title").isNotNull()).withColumns(
        {
            "source_domain": F.lit("ozon.ru"),
            "product_url": F.coalesce("canonical_url", "url"),
            "image_url": F.coalesce("image_url", F.lit("https://www.ozon.ru/favicon.ico")),
            "currency": F.lit("RUB"),
        }
    )
    return to_offers(projected, "ozon")


def _one_stored(details: DataFrame, key: str, content: list[Column]) -> DataFrame:
    """One row per key: the newest where times are known, else settled by content."""
    newest = [F.desc_nulls_last("fetched_at")] if "fetched_at" in details.columns else []
    return first_by(details, [key], [*newest, *[c.desc_nulls_last() for c in content]])


def enrich_cards(offers: DataFrame, details: DataFrame) -> DataFrame:
    """Card offers with the specifications of their stored detail page.

    ``details``: url_key, state, specs (map), prose. Specifications replace the preview's
    when there are any; the description is rendered anew, keeping bought count and delivery;
    confidence rises to 0.95. Missing and blocked pages leave the preview. Of several stored
    pages of a card one stands, the newest if ``details`` has ``fetched_at``.
    """
    usable = _one_stored(
        details.where(F.col("state") == "ok"), "url_key", [F.to_json("specs"), F.col("prose")]
    ).select("url_key", "specs", "prose")
    joined = offers.withColumn("url_key", u.url_key(F.col("product_url"), 3)).join(
        usable, "url_key", "left"
    )
    found = F.col("prose").isNotNull() | F.col("specs").isNotNull()
    has_specs = F.coalesce(F.size("specs"), F.lit(0)) > 0
    has_prose = F.coalesce("prose", F.lit("")) != ""
    chars = F.when(has_specs, F.col("specs")).otherwise(F.col("characteristics"))
    rendered = o.card_description(
        F.col("_chars"),
        F.col("rating"),
        F.col("reviews_count"),
        o.snippet_bought(F.col("description")),
        o.snippet_delivery(F.col("description")),
        F.coalesce("prose", F.lit("")),
    )
    return (
        joined.withColumn("_chars", chars)
        .withColumn("description", F.when(found, rendered).otherwise(F.col("description")))
        .withColumn("characteristics", F.col("_chars"))
        .withColumn(
            "confidence",
            F.when(has_specs | has_prose, F.lit(rules.CONFIDENCE["card_enriched"])).otherwise(
                F.col("confidence")
            ),
        )
        .drop("url_key", "specs", "prose", "_chars")
    )


def enrich_tiles(offers: DataFrame, details: DataFrame, first: int = 2) -> DataFrame:
    """Tile offers with stored details for the first ``first`` ranks of each search.

    ``details``: product_url, state, description, characteristics. Reading stops at the
    first blocked page, so ranks behind it keep their preview. Of several stored pages of a
    product one stands, as for cards.
    """
    once = _one_stored(
        details,
        "product_url",
        [F.col("state"), F.col("description"), F.to_json("characteristics")],
    )
    facts = once.select(
        "product_url",
        F.col("state").alias("_state"),
        F.col("description").alias("_prose"),
        F.col("characteristics").alias("_chars"),
    )
    joined = offers.join(facts, "product_url", "left")
    block = (
        joined.where((F.col("rank") <= first) & (F.col("_state") == "blocked"))
        .groupBy("search_id")
        .agg(F.min("rank").alias("_block"))
    )
    joined = joined.join(block, "search_id", "left")
    applies = (
        (F.col("rank") <= first)
        & (F.col("_state") == "ok")
        & (F.col("_block").isNull() | (F.col("rank") < F.col("_block")))
    )
    specs = F.coalesce("_chars", F.create_map().cast("map<string,string>"))
    rendered = o.detail_description(F.coalesce("_prose", F.lit("")), specs)
    return (
        joined.withColumn(
            "description",
            F.when(applies & (rendered != ""), rendered).otherwise(F.col("description")),
        )
        .withColumn(
            "characteristics",
            F.when(applies & (F.size(specs) > 0), specs).otherwise(F.col("characteristics")),
        )
        .drop("_state", "_prose", "_chars", "_block")
    )


def has_required(title: Column, price: Column, url: Column) -> Column:
    return F.coalesce((F.trim(title) != "") & (price > 0) & url.startswith("http"), F.lit(False))


def in_categories(df: DataFrame, categories: list[str] | None) -> DataFrame:
    """Rows of the wanted categories; None keeps all."""
    return df if categories is None else df.where(F.col("category").isin(*categories))
