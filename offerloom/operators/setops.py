"""Ordered unions and differences where the first occurrence wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions import url
from offerloom.operators.ranking import best_tier, first_by, top_n


def ordered_union(*groups: DataFrame) -> DataFrame:
    """Union that remembers which input a row came from (``src_ord``)."""
    tagged = [df.withColumn("src_ord", F.lit(i)) for i, df in enumerate(groups)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def merge_candidates(*groups: DataFrame, blacklist: bool = True, match: str = "contains") -> DataFrame:
    """Union in the given order; first occurrence per URL without fragment wins."""
    merged = ordered_union(*groups)
    if blacklist:
        merged = merged.where(~url.is_blacklisted(url.host(F.col("url")), match))
    keyed = merged.withColumn("url_key", url.url_key(F.col("url")))
    return first_by(keyed, ["search_id", "url_key"], [F.asc("src_ord"), F.asc("position")])


def merge_by_id(*groups: DataFrame, key: str) -> DataFrame:
    """Union where an earlier provider's row wins for each id."""
    return first_by(
        ordered_union(*groups), ["search_id", key], [F.asc("src_ord"), F.asc("position")]
    )


def distinct_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return first_by(df, keys, order)


def filter_and_sort(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """Viable candidates, best first (``position`` is the new rank).

    Keeps quality >= 0; when a search has none, any candidate that is not rejected, at
    score 0; and only Russian hosts when a search has any. The tier is the order: viable
    Russian, viable, soft Russian, soft.
    """
    score = F.greatest(F.col("quality"), F.lit(0.0))
    usable = candidates.where(~F.col("rejected")).withColumn("_score", score)
    tier = (
        F.when((F.col("quality") >= 0) & F.col("is_ru"), 0)
        .when(F.col("quality") >= 0, 1)
        .when(F.col("is_ru"), 2)
        .otherwise(3)
    )
    pool = best_tier(usable, ["search_id"], tier)
    if limit is not None:
        pool = top_n(pool, ["search_id"], [F.desc("_score"), F.asc("position")], limit, "rank")
    return pool


def select_candidates(candidates: DataFrame, limit: int = rules.LIVE_HITS) -> DataFrame:
    """Product hits first, then listing pages as seeds, distinct, cut to ``limit``."""
    hits = filter_and_sort(candidates).where(F.col("quality") >= 0).withColumn("_part", F.lit(0))
    seeds = (
        candidates.where("listing").withColumn("_score", F.lit(0.0)).withColumn("_part", F.lit(1))
    )
    order = [F.asc("_part"), F.desc("_score"), F.asc("position")]
    both = hits.unionByName(seeds).withColumn("url_key", url.url_key(F.col("url")))
    distinct = first_by(both, ["search_id", "url_key"], order)
    return top_n(distinct, ["search_id"], order, limit, "rank").drop("_part", "_score")


def except_seen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys were not seen before."""
    return df.join(seen.select(*keys), keys, "left_anti")
