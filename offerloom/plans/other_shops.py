"""Offers of the dynamic "other shops" source for all searches at once.

The order in which offers are accepted is made explicit: the stage that found them
(listing grids of known categories, grids of the filtered candidates, the ranked pool,
grids of unknown categories), then the page's rank, then the place on the page. Pages are
read once per distinct URL, however many searches want them, and page texts are joined
only to URLs that survived the URL rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions import url as u
from offerloom.functions.query import is_relevant, query_needles
from offerloom.operators import extraction, harvest, setops
from offerloom.operators.offers import to_offers
from offerloom.operators.planning import computed_once
from offerloom.operators.ranking import first_by, top_n
from offerloom.operators.selection import cap_per_domain
from offerloom.operators.settling import settle
from offerloom.operators.urls import classify_urls, final_offers
from offerloom.sources.pages import valid_pages

_HIT = ("search_id", "position", "url", "title", "snippet", "provider", "similarity")
GRID_PAGES = 5
LATE_GRID_PAGES = 3


def _by_quality(candidates: DataFrame) -> DataFrame:
    """Classified candidates with ``place`` in quality order."""
    classified = classify_urls(candidates)
    return classified.withColumn(
        "place", F.struct((-F.col("quality")).alias("q"), F.col("position").alias("p"))
    )


def _grid_urls(candidates: DataFrame, links: DataFrame, pages: int) -> DataFrame:
    """Listing pages to read per search: best of each shop, at most ``pages``.

    A shop's front page is replaced by its most promising catalogue link.
    """
    order = [F.desc("grid_priority"), F.asc("place")]
    best = first_by(candidates.where("is_grid"), ["search_id", "listing_key"], order)
    chosen = top_n(best, ["search_id"], order, pages, "page_rank")
    catalogue = links.where(F.col("target") == "catalogue").select("page", "position", "link")
    scored = catalogue.withColumn(
        "_priority", u.grid_priority(u.host(F.col("link")), u.path(F.col("link")))
    )
    fronts = first_by(scored, ["page"], [F.desc("_priority"), F.asc("position")]).select(
        F.col("page").alias("_page"), F.col("link").alias("_instead")
    )
    keyed = chosen.withColumn("_key", u.url_key(F.col("url")))
    is_front = F.regexp_replace("path", "/+$", "") == ""
    return (
        keyed.join(fronts, (F.col("_key") == F.col("_page")) & is_front & ~F.col("fetch_blocked"), "left")
        .select(
            "search_id", "page_rank", "similarity",
            F.coalesce("_instead", "_key").alias("page_url"),
        )
    )


def _stored(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored pages for the wanted URLs, each once."""
    urls = wanted.select(F.col("page_url").alias("_w")).distinct()
    newest = [F.desc_nulls_last("fetched_at")] if "fetched_at" in pages.columns else []
    keyed = valid_pages(pages).select(
        u.url_key(F.col("url")).alias("url"), "html", *(["fetched_at"] if newest else [])
    )
    found = keyed.join(urls, keyed["url"] == urls["_w"], "left_semi")
    # crawls of one page, and addresses that differ in their fragment only
    return first_by(found, ["url"], [*newest, F.xxhash64("html")]).select("url", "html")


def _acceptable(offers: DataFrame, needles: DataFrame) -> DataFrame:
    """Offers that are final and answer the query."""
    final = final_offers(offers)
    return (
        final.join(needles, "search_id")
        .where(is_relevant(F.col("title"), F.col("words"), F.col("nums")))
        .drop("words", "nums")
    )


_FOUND = (
    "title", "description", "price_rub", "image_url", "product_url", "source_domain", "method",
    "confidence",
)


def _wanted_offers(wanted: DataFrame, offers: DataFrame, needles: DataFrame) -> DataFrame:
    """Acceptable offers of the pages each search wants (``wanted`` carries the stage)."""
    joined = wanted.join(offers, "page_url").select(
        "search_id", "stage", "page_rank", "position", *_FOUND,
        F.col("similarity").alias("relevance_score"),
    )
    return _acceptable(joined, needles)


def _listing_offers(wanted: DataFrame, stored: DataFrame, needles: DataFrame) -> DataFrame:
    listed = extraction.extract_listings(stored, rules.LISTING_ITEMS_LIVE)
    return _wanted_offers(wanted, listed.select("page_url", "position", *_FOUND), needles)


def _single_offers(wanted: DataFrame, stored: DataFrame, needles: DataFrame) -> DataFrame:
    single = extraction.extract_offers(stored).select(
        F.col("url").alias("page_url"), F.lit(0).alias("position"), *_FOUND
    )
    return _wanted_offers(wanted, single, needles)


def _index_offers(index_hits: DataFrame, needles: DataFrame) -> DataFrame:
    """Offers served from the index without reading a page."""
    from offerloom.operators.searching import servable_from_index

    usable = servable_from_index(index_hits).select(
        "search_id", F.lit(2).alias("stage"), F.col("rank").alias("page_rank"),
        F.lit(0).alias("position"), "title", F.lit("").alias("description"),
        F.expr("last_price div 100").alias("price_rub"), "image_url",
        F.col("url").alias("product_url"), F.col("domain").alias("source_domain"), "method",
        "confidence", "relevance_score",
    )
    return _acceptable(usable, needles)


def _accept_order() -> list[Column]:
    return [F.asc("stage"), F.asc("page_rank"), F.asc("position")]


def collect_other_shops(
    searches: DataFrame,
    hits: DataFrame,
    pages: DataFrame,
    links: DataFrame,
    index_hits: DataFrame | None = None,
) -> DataFrame:
    """At most 15 offers per search from shops found through web search.

    ``searches``: search_id, query, category. ``hits``: search_id, position, url, title,
    snippet, provider, similarity (all variants and providers merged). ``pages``: url, status,
    html. ``links``: page, position, link, target. ``index_hits``: search_id, rank and index
    columns.
    """
    needles = computed_once(
        searches.select("search_id", "query"), {"_n": query_needles(F.col("query"))}
    ).select("search_id", "_n.words", "_n.nums")
    known = searches.where(F.col("category") != "unknown").select("search_id")
    unknown = searches.where(F.col("category") == "unknown").select("search_id")

    live = setops.select_candidates(classify_urls(hits.select(*_HIT)))
    live = live.select(
        "search_id", F.col("rank").cast("bigint").alias("position"),
        *[c for c in _HIT if c not in ("search_id", "position")],
    )
    # Later stages branch off these tables several times: they are written once instead of
    # being planned anew in every branch.
    candidates = settle(_by_quality(setops.merge_candidates(live).select(*_HIT)))

    first_pages = _grid_urls(
        candidates.join(known, "search_id", "left_semi"), links, GRID_PAGES
    ).withColumn("stage", F.lit(0))
    first_grid = settle(_listing_offers(first_pages, _stored(pages, first_pages), needles))
    sizes = first_grid.groupBy("search_id").agg(
        F.count_distinct(u.url_key(F.col("product_url"))).alias("_n")
    )
    full = sizes.where(F.col("_n") >= rules.MAX_RESULTS).select("search_id")

    ordered = candidates.drop("position").withColumn("position", F.col("place"))
    widened = harvest.expand_listings(
        ordered.join(full, "search_id", "left_anti"), links, rules.MAX_PER_DOMAIN, rules.MAX_RESULTS
    )
    # direct, listings, harvested: the place in that order
    widened = widened.withColumn("_place", F.struct("part", "position", "rank"))
    kept = ordered.join(full, "search_id", "left_semi").withColumn(
        "_place",
        F.struct(F.lit(0).alias("part"), F.col("position"), F.lit(0).alias("rank")),
    )
    columns = ["search_id", "_place", "url", "title", "snippet", "provider", "similarity"]
    pool_base = widened.select(*columns).unionByName(kept.select(*columns))
    reclassified = classify_urls(pool_base.withColumnRenamed("_place", "position"))
    viable = settle(
        setops.filter_and_sort(reclassified).withColumn(
            "place", F.struct((-F.col("_score")).alias("q"), F.col("position").alias("p"))
        )
    )

    second_pages = _grid_urls(viable.join(full, "search_id", "left_anti"), links, GRID_PAGES)
    pool = top_n(
        viable, ["search_id"], [F.desc("quality"), F.asc("place")], rules.RANK_POOL, "page_rank"
    ).select("search_id", "page_rank", "similarity", u.url_key(F.col("url")).alias("page_url"))
    late_pages = _grid_urls(
        viable.join(unknown, "search_id", "left_semi"), links, LATE_GRID_PAGES
    )
    # One reading of the pages serves the later grids and the pool.
    wanted = settle(
        second_pages.withColumn("stage", F.lit(1))
        .unionByName(pool.withColumn("stage", F.lit(2)))
        .unionByName(late_pages.withColumn("stage", F.lit(3)))
    )
    stored = _stored(pages, wanted)
    from_lists = settle(_listing_offers(wanted, stored, needles))
    # A pool page gives its listing when any of it is accepted, else itself as one product.
    answered = from_lists.where("stage = 2").select("search_id", "page_rank").distinct()
    pool_rest = wanted.where("stage = 2").join(answered, ["search_id", "page_rank"], "left_anti")
    singles = _single_offers(pool_rest, stored, needles)

    found = first_grid.unionByName(from_lists).unionByName(singles)
    if index_hits is not None:
        found = found.unionByName(_index_offers(index_hits, needles))
    distinct = first_by(
        found.withColumn("_key", u.url_key(F.col("product_url"))),
        ["search_id", "_key"],
        _accept_order(),
    )
    accepted = top_n(
        top_n(distinct, ["search_id", "source_domain"], _accept_order(), rules.MAX_PER_DOMAIN),
        ["search_id"],
        _accept_order(),
        rules.MAX_RESULTS,
        "accepted",
    )
    ranked = cap_per_domain(
        accepted.drop("position").withColumn("position", F.col("accepted").cast("bigint")),
        rank_col="rank",
    )
    return to_offers(
        ranked.drop("position").withColumn("position", (F.col("rank") - 1).cast("bigint")), "other"
    )
