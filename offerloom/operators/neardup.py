"""Near-duplicate offers inside a search: first seen survives.

An offer is dropped when an earlier surviving offer of the search has the same URL key,
the same title key or a title ratio of at least 0.93. The outcome depends on the order
and a search may hold a third of all offers, so neither all pairs nor whole groups are
formed. The feature keeps the first 15 survivors, which allows this exact loop:

1. take the next 64 offers of each open search (a WindowGroupLimit, 64 rows per task and
   search), and walk them in order against the at most 15 survivors;
2. a search with 15 survivors, or without further offers, is finished;
3. for the others drop every later offer that resembles a survivor, and repeat.

After step 3 the next offer is a survivor for certain, so a search needs at most 15
rounds and nearly always one; work is linear in the offers.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom import rules
from offerloom.functions.text import title_key
from offerloom.functions.url import url_key
from offerloom.operators.ranking import first_by, top_n
from offerloom.operators.settling import settle

_OFFER = T.StructType(
    [
        T.StructField("position", T.LongType()),
        T.StructField("url_key", T.StringType()),
        T.StructField("title_key", T.StringType()),
    ]
)


def similar(left: str, right: str, ratio: float) -> bool:
    """Equal, or matched share of characters at least ``ratio`` (cheap bounds first)."""
    from difflib import SequenceMatcher

    if left == right:
        return True
    matcher = SequenceMatcher(None, left, right)
    return (
        matcher.real_quick_ratio() >= ratio
        and matcher.quick_ratio() >= ratio
        and matcher.ratio() >= ratio
    )


def _repeats(offer, survivors, ratio: float) -> bool:
    return any(
        offer["url_key"] == s["url_key"] or similar(offer["title_key"], s["title_key"], ratio)
        for s in survivors
    )


def _walker(limit: int, ratio: float):
    @F.pandas_udf(T.ArrayType(_OFFER))
    def walk(batches: pd.Series, survivors: pd.Series) -> pd.Series:
        out = []
        for batch, kept in zip(batches, survivors):
            kept = list(kept) if kept is not None else []
            for offer in batch if batch is not None else []:
                if len(kept) >= limit:
                    break
                if not _repeats(offer, kept, ratio):
                    kept.append(offer)
            out.append(kept)
        return pd.Series(out)

    return walk


def _repeat_test(ratio: float):
    @F.pandas_udf(T.BooleanType())
    def repeats(urls: pd.Series, titles: pd.Series, survivors: pd.Series) -> pd.Series:
        return pd.Series(
            [
                _repeats({"url_key": url, "title_key": title}, kept, ratio)
                for url, title, kept in zip(urls, titles, survivors)
            ]
        )

    return repeats


def near_duplicate_survivors(
    offers: DataFrame,
    limit: int = rules.MAX_RESULTS,
    ratio: float = rules.TITLE_RATIO,
    batch: int = 64,
) -> DataFrame:
    """First ``limit`` mutually dissimilar offers per search, in position order.

    Takes ``search_id, position, title, product_url``; position is unique in a search.
    """
    keyed = offers.select(
        "search_id",
        "position",
        url_key(F.col("product_url"), 3).alias("url_key"),
        title_key(F.col("title")).alias("title_key"),
    )
    # A later copy equal in both keys never survives.
    remaining = first_by(keyed, ["search_id", "url_key", "title_key"], [F.asc("position")])
    walk, repeats = _walker(limit, ratio), _repeat_test(ratio)
    no_survivors = F.lit(None).cast(T.ArrayType(_OFFER))
    open_searches = None
    finished = []
    while True:
        batches = (
            top_n(remaining, ["search_id"], [F.asc("position")], batch)
            .groupBy("search_id")
            .agg(
                F.array_sort(F.collect_list(F.struct("position", "url_key", "title_key"))).alias(
                    "offers"
                )
            )
        )
        if open_searches is None:
            state = batches.withColumn("survivors", no_survivors)
        else:
            state = open_searches.join(batches, "search_id", "left")
        state = state.select(
            "search_id",
            walk("offers", "survivors").alias("survivors"),
            F.coalesce(F.size("offers"), F.lit(0)).alias("taken"),
            F.array_max(F.transform("offers", lambda o: o["position"])).alias("last"),
        )
        state = settle(state)
        is_open = (F.size("survivors") < limit) & (F.col("taken") == batch)
        finished.append(state.where(~is_open).select("search_id", "survivors"))
        still_open = state.where(is_open)
        if still_open.isEmpty():
            break
        later = remaining.join(still_open, "search_id").where(F.col("position") > F.col("last"))
        remaining = settle(
            later.where(~repeats("url_key", "title_key", "survivors")).select(
                "search_id", "position", "url_key", "title_key"
            )
        )
        open_searches = still_open.select("search_id", "survivors")
    survivors = reduce(DataFrame.unionByName, finished)
    kept = survivors.select(
        "search_id", F.posexplode("survivors").alias("nth", "_s")
    ).select("search_id", F.col("_s.position").alias("position"), (F.col("nth") + 1).alias("rank"))
    return offers.join(kept, ["search_id", "position"])


def collect_cards(
    offers: DataFrame,
    page_states: DataFrame | None = None,
    limit: int = rules.MAX_RESULTS,
    max_pages: int = rules.PAGE_LIMIT,
) -> DataFrame:
    """Card pages read in turn, near duplicates dropped, early stop, cut to ``limit``.

    Takes ``search_id, page, position`` (position runs over all pages), ``title`` and
    ``product_url``. Reading stops before the first page that is missing, blocked or brings
    no survivor.
    """
    shown = offers.where(F.col("page") <= max_pages)
    if page_states is not None:
        good = page_states.where(F.col("state") == "ok").select("search_id", "page")
        shown = shown.join(good, ["search_id", "page"], "left_semi")
    survivors = near_duplicate_survivors(shown, limit)
    pages = survivors.groupBy("search_id").agg(
        F.array_sort(F.collect_set("page")).alias("_pages")  # at most max_pages values
    )
    reached = F.filter("_pages", lambda p, i: p == i + 1)
    return (
        survivors.join(pages, "search_id")
        .where(F.array_contains(reached, F.col("page")))
        .drop("_pages")
    )
