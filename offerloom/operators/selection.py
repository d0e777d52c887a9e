"""Caps, tiers, paging, diversity and ranking of offers and candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions import similarity, url
from offerloom.operators.ranking import best_tier, first_by, top_n



def _relevance_order() -> list[Column]:
    return [F.desc("relevance_score"), F.asc("position")]


def first_n(
    offers: DataFrame, n: int = rules.MAX_PER_SOURCE, keys: Sequence[str] = ("search_id", "source")
) -> DataFrame:
    """First ``n`` offers per source and search by position."""
    return top_n(offers, keys, [F.asc("position")], n)


def cap_per_domain(
    offers: DataFrame,
    per_domain: int = rules.MAX_PER_DOMAIN,
    total: int = rules.MAX_RESULTS,
    keys: Sequence[str] = ("search_id",),
    rank_col: str | None = None,
) -> DataFrame:
    """At most ``per_domain`` offers of one shop, then ``total`` overall, best first."""
    order = _relevance_order()
    shops = top_n(offers, [*keys, "source_domain"], order, per_domain)
    return top_n(shops, keys, order, total, rank_col)


def diversify(
    candidates: DataFrame, limit: int, per_domain: int = 2, rank_col: str = "rank"
) -> DataFrame:
    """Up to ``per_domain`` per host in rank order, then fill up from the rest.

    Needs ``search_id, position, url, host, score``. The rest is reduced to the first
    ``limit`` new URLs per search, which is all the fill can use.
    """
    order = [F.desc("score"), F.asc("position")]
    primary = top_n(
        top_n(candidates, ["search_id", "host"], order, per_domain), ["search_id"], order, limit
    ).withColumn("_tier", F.lit(0))
    picked = primary.select("search_id", "url").distinct()
    spare = candidates.join(picked, ["search_id", "url"], "left_anti")
    spare = top_n(first_by(spare, ["search_id", "url"], order), ["search_id"], order, limit)
    both = primary.unionByName(spare.withColumn("_tier", F.lit(1)))
    return top_n(both, ["search_id"], [F.asc("_tier"), *order], limit, rank_col).drop("_tier")


def best_listing_per_domain(candidates: DataFrame) -> DataFrame:
    """Best grid page per shop (regional hosts share a key), by priority then position."""
    grids = candidates.where("is_grid")
    return first_by(
        grids, ["search_id", "listing_key"], [F.desc("grid_priority"), F.asc("position")]
    )


def first_nonempty(df: DataFrame, keys: Sequence[str], tier: str = "tier") -> DataFrame:
    """Rows of the first tier or attempt that has any, per key."""
    return best_tier(df, keys, F.col(tier))


def paged_collect(
    offers: DataFrame,
    key: str,
    limit: int = rules.MAX_RESULTS,
    max_pages: int | None = None,
    page_states: DataFrame | None = None,
) -> DataFrame:
    """Offers collected page by page with early stop.

    Takes ``search_id, page, position`` and the dedup ``key``. Reading stops at the first
    page that is missing, blocked (``page_states``: search_id, page, state) or brings no
    new key, and at ``limit`` offers.
    """
    if max_pages is not None:
        offers = offers.where(F.col("page") <= max_pages)
    if page_states is not None:
        good = page_states.where(F.col("state") == "ok").select("search_id", "page")
        offers = offers.join(good, ["search_id", "page"], "left_semi")
    fresh = first_by(offers, ["search_id", key], [F.asc("page"), F.asc("position")])
    # Only pages that brought something new can be read past; they must be 1, 2, 3, ...
    productive = fresh.select("search_id", "page").distinct()
    numbered = productive.withColumn(
        "_nth", F.row_number().over(W.partitionBy("search_id").orderBy("page"))
    )
    reached = numbered.where(F.col("page") == F.col("_nth")).select("search_id", "page")
    kept = fresh.join(reached, ["search_id", "page"], "left_semi")
    return top_n(kept, ["search_id"], [F.asc("page"), F.asc("position")], limit)


def best_capture(captures: DataFrame, target: int = rules.MAX_PER_SOURCE) -> DataFrame:
    """Scroll capture with most offers, earliest on ties; capturing stops at ``target``.

    Takes ``search_id, round, n_offers``; rounds after the first one that reaches the
    target were never taken and are ignored.
    """
    stop = captures.groupBy("search_id").agg(
        F.min(F.when(F.col("n_offers") >= target, F.col("round"))).alias("_stop")
    )
    usable = captures.join(stop, "search_id").where(
        F.col("_stop").isNull() | (F.col("round") <= F.col("_stop"))
    )
    return first_by(
        usable.drop("_stop"), ["search_id"], [F.desc("n_offers"), F.asc("round")]
    )


def rank_offers(offers: DataFrame) -> DataFrame:
    """Order by relevance, position breaking ties."""
    return offers.orderBy("search_id", *_relevance_order())


def sort_by_price(offers: DataFrame, direction: str = "asc") -> DataFrame:
    """Price order with unpriced offers last, position breaking ties."""
    price = F.when(F.col("price") > 0, F.col("price"))
    signed = price if direction == "asc" else -price
    return offers.orderBy("search_id", (F.col("price") <= 0).asc(), signed.asc(), "position")


def rank_pool(candidates: DataFrame, limit: int = rules.RANK_POOL) -> DataFrame:
    """Candidate pool by URL quality."""
    return top_n(candidates, ["search_id"], [F.desc("quality"), F.asc("position")], limit)


def above_threshold(scored: DataFrame, threshold: float, score: str = "similarity"):
    """(kept rows, first three rejected URLs per search)."""
    kept = scored.where(F.col(score) >= threshold)
    rejected = top_n(
        scored.where(F.col(score) < threshold), ["search_id"], [F.asc("position")], 3
    )
    samples = rejected.groupBy("search_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", F.substring("url", 1, 80).alias("u")))),
            lambda x: x["u"],
        ).alias("rejected_sample")
    )
    return kept, samples


def blended_rank(
    candidates: DataFrame,
    threshold: float = rules.SNIPPET_SIMILARITY,
    limit: int = rules.RANK_POOL,
    per_domain: int = 2,
) -> DataFrame:
    """Text similarity plus URL quality and depth, thresholded and spread over shops.

    Needs ``search_id, position, query, title, snippet, url, host, path, quality``.
    """
    text = F.trim(F.concat_ws(" ", "title", "snippet"))
    scored = candidates.withColumn(
        "similarity", similarity.token_overlap(F.col("query"), text)
    ).withColumn(
        "score",
        F.col("similarity")
        + F.greatest(F.col("quality"), F.lit(0.0)) * 0.15
        + url.depth_bonus(F.col("path")),
    )
    kept, _ = above_threshold(scored, threshold)
    return diversify(kept, limit, per_domain)


def semantic_top_k(
    offers: DataFrame, queries: DataFrame, k: int = rules.SEMANTIC_TOP_K
) -> DataFrame:
    """Closest ``k`` offers per search by cosine of stored unit vectors.

    ``offers`` has ``search_id, position, embedding``; ``queries`` ``search_id,
    query_embedding``. A search with at most ``k`` offers, or without a query vector, keeps
    its first ``k`` offers unscored and in order. The group sizes are combined map-side and
    meet only the already reduced rows.
    """
    scored = offers.join(queries.select("search_id", "query_embedding"), "search_id", "left")
    scored = scored.withColumn(
        "similarity", similarity.dot(F.col("embedding"), F.col("query_embedding"))
    ).drop("query_embedding")
    best = top_n(scored, ["search_id"], [F.desc_nulls_last("similarity"), F.asc("position")], k)
    sizes = offers.groupBy("search_id").agg(F.count("*").alias("_size"))
    return (
        best.join(sizes, "search_id")
        .withColumn("similarity", F.when(F.col("_size") > k, F.col("similarity")))
        .withColumn(
            "rank",
            F.row_number().over(
                W.partitionBy("search_id").orderBy(
                    F.desc_nulls_last("similarity"), F.asc("position")
                )
            ),
        )
        .drop("_size")
    )
