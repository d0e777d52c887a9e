"""Offers of the three marketplaces from stored answers and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions.offer import card_page_state
from offerloom.operators import cards, neardup, selection
from offerloom.operators.offers import enrich_cards, enrich_tiles, to_offers
from offerloom.operators.ranking import first_by
from offerloom.operators.settling import settle
from offerloom.sources.payloads import payload_offers, read_payload_products


def payload_source(payloads: DataFrame) -> DataFrame:
    """Offers of the search-API source, 15 per search."""
    return selection.first_n(payload_offers(read_payload_products(payloads)))


def card_source(pages: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Offers of the card source: pages in turn, near duplicates dropped, enriched.

    ``pages``: search_id, page, html. ``details``: stored card pages (url, html).
    """
    states = pages.select("search_id", "page", card_page_state(F.col("html")).alias("state"))
    parsed = cards.article_offers(pages)
    # one running number over the pages of a search: the page above the place on it
    numbered = settle(
        parsed.withColumn("position", F.shiftleft(F.col("page").cast("bigint"), 32) + F.col("position"))
    )
    collected = neardup.collect_cards(numbered, states)
    ranked = collected.drop("position").withColumn(
        "position", (F.col("rank") - 1).cast("bigint")
    )
    offers = to_offers(ranked, "yandex_market")
    return offers if details is None else enrich_cards(offers, cards.card_details(details))


def broad_source(
    pages: DataFrame,
    embeddings: DataFrame | None = None,
    queries: DataFrame | None = None,
    details: DataFrame | None = None,
) -> DataFrame:
    """Offers of the tile source in two stages: broad read, then the closest by meaning.

    ``pages``: search_id, html. ``embeddings``: title, embedding; ``queries``: search_id,
    query_embedding. Without vectors the first offers stand. ``details``: stored product pages
    (url, html) for the first two ranks.
    """
    broad = cards.broad_offers(pages)
    if embeddings is not None and queries is not None:
        of_title = first_by(embeddings.select("title", "embedding"), ["title"], [F.col("embedding")])
        vectors = broad.join(of_title, "title", "left")
        chosen = selection.semantic_top_k(vectors, queries).drop("embedding")
    else:
        chosen = selection.first_n(
            broad, rules.SEMANTIC_TOP_K, ("search_id",)
        ).withColumns({"rank": F.col("position") + 1, "similarity": F.lit(None).cast("double")})
    chosen = chosen.withColumn("characteristics", F.create_map().cast("map<string,string>"))
    if details is not None:
        chosen = enrich_tiles(chosen, cards.tile_details(details))
    placed = chosen.drop("position").withColumns(
        {
            "position": (F.col("rank") - 1).cast("bigint"),
            "source_domain": F.lit("ozon.ru"),
            "image_url": F.coalesce("image_url", F.lit("https://www.ozon.ru/favicon.ico")),
            "relevance_score": F.coalesce("similarity", F.lit(0.0)),
        }
    )
    return selection.first_n(to_offers(placed, "ozon"))
