"""Expanding listing pages into product links along the stored link graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions.url import host, url_key
from offerloom.operators.ranking import first_by, top_n
from offerloom.operators.setops import ordered_union


def _visits(seeds: DataFrame, links: DataFrame, depth: int, per_page: int, budget: int):
    """Pages read per seed: breadth first, distinct, at most ``budget`` of them.

    Level by level, each level cut before the next join: a page gives at most ``per_page``
    catalogue links and a seed at most ``budget`` pages, so fan-out is bounded by constants.
    The loop runs ``depth`` times over plans, not over rows.
    """
    first = seeds.select(
        "seed_id", url_key(F.col("url")).alias("page"), F.lit(0).alias("depth"),
        F.array(F.lit(0).cast("bigint")).alias("path"),
    )
    catalogue = links.where(F.col("target") == "catalogue").select(
        F.col("page").alias("_from"), "position", F.col("link").alias("_to")
    )
    catalogue = top_n(catalogue, ["_from"], [F.asc("position")], per_page)
    levels, frontier = [first], first
    for level in range(1, depth + 1):
        step = frontier.join(catalogue, frontier["page"] == catalogue["_from"]).select(
            "seed_id",
            F.col("_to").alias("page"),
            F.lit(level).alias("depth"),
            F.concat("path", F.array(F.col("position").cast("bigint"))).alias("path"),
        )
        known = reduce(DataFrame.unionByName, levels).select("seed_id", "page")
        fresh = step.join(known, ["seed_id", "page"], "left_anti")
        fresh = first_by(fresh, ["seed_id", "page"], [F.asc("path")])
        frontier = top_n(fresh, ["seed_id"], [F.asc("path")], budget)
        levels.append(frontier)
    # breadth first: shallower pages come first, then the order of discovery
    return top_n(
        reduce(DataFrame.unionByName, levels), ["seed_id"], [F.asc("depth"), F.asc("path")],
        budget, "visit",
    )


def harvest(
    seeds: DataFrame,
    links: DataFrame,
    per_listing: int = rules.HARVEST_PER_LISTING,
    depth: int = rules.HARVEST_DEPTH,
    per_page: int = rules.HARVEST_CATALOGUES_PER_PAGE,
) -> DataFrame:
    """First ``per_listing`` product links found from each seed page.

    ``seeds``: seed_id, url. ``links``: page, position, link, target (see
    ``extraction.page_links``); a page without links was not stored and costs its visit.
    """
    budget = max(2, depth + 1)
    visits = _visits(seeds, links, depth, per_page, budget)
    products = links.where(F.col("target") == "product").select("page", "position", "link")
    # A visited page can contribute at most its first ``per_listing`` links.
    products = top_n(products, ["page"], [F.asc("position")], per_listing * budget)
    found = visits.select("seed_id", "visit", "page").join(products, "page")
    order = [F.asc("visit"), F.asc("position")]
    distinct = first_by(found, ["seed_id", "link"], order)
    return top_n(distinct, ["seed_id"], order, per_listing, "rank").select(
        "seed_id", "rank", "link"
    )


def expand_listings(
    candidates: DataFrame,
    links: DataFrame,
    per_listing: int = rules.HARVEST_PER_LISTING,
    max_listings: int = rules.HARVEST_LISTINGS,
    depth: int = rules.HARVEST_DEPTH,
) -> DataFrame:
    """Direct candidates, the first listings, and the products harvested from them.

    ``candidates`` are classified (``listing`` flag) with search_id, position, url, title,
    snippet, provider, similarity. Result keeps the first of each URL in that order as
    ``part`` 0, 1, 2.
    """
    direct = candidates.where(~F.col("listing"))
    listings = top_n(
        candidates.where("listing"), ["search_id"], [F.asc("position")], max_listings
    )
    seeds = listings.select(F.struct("search_id", "position").alias("seed_id"), "url")
    found = harvest(seeds, links, per_listing, depth)
    harvested = (
        found.select("seed_id.*", "rank", "link")
        .join(listings.drop("url"), ["search_id", "position"])
        .withColumn("url", F.col("link"))
        .withColumn("provider", F.concat("provider", F.lit("+catalog")))
    )
    columns = ["search_id", "position", "url", "title", "snippet", "provider", "similarity"]
    parts = ordered_union(
        direct.select(*columns, F.lit(0).alias("rank")),
        listings.select(*columns, F.lit(0).alias("rank")),
        harvested.select(*columns, "rank"),
    ).withColumnRenamed("src_ord", "part")
    keyed = parts.withColumn("url_key", url_key(F.col("url")))
    return first_by(
        keyed, ["search_id", "url_key"], [F.asc("part"), F.asc("position"), F.asc("rank")]
    ).withColumn("domain", host(F.col("url")))
