"""Search hits from JSON answers and saved result pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions import offer as o
from offerloom.functions import url as u
from offerloom.functions.text import first_of_each, squish, strip
from offerloom.operators.cards import serp_blocks
from offerloom.operators.planning import computed_once

_ANSWER = (
    "struct<results:array<struct<url:string,title:string,content:string,snippet:string>>>"
)


def _hits(df: DataFrame, kept: list[str], items: str, key_level, limit: int) -> DataFrame:
    """Distinct, allowed hits of each answer: all inside the answer's row."""

    def key(x):
        return x["url"] if key_level is None else u.url_key(x["url"], key_level)

    allowed = F.filter(
        items,
        lambda x: F.coalesce(x["url"].startswith("http"), F.lit(False))
        & ~u.is_blacklisted(u.host(x["url"])),
    )
    checked = computed_once(df, {"_ok": allowed})
    first = first_of_each(F.col("_ok"), key)
    return checked.select(
        *kept, F.posexplode(F.slice(first, 1, limit)).alias("rank", "_h")
    ).select(
        *kept, "rank", "_h.url", u.host(F.col("_h.url")).alias("domain"), "_h.title", "_h.snippet"
    )


def serp_from_json(answers: DataFrame, limit: int = 20) -> DataFrame:
    """Hits of JSON answers (``body``): first occurrence per URL, blacklist applied."""
    kept = [c for c in answers.columns if c != "body"]
    results = F.from_json("body", _ANSWER)["results"]
    items = F.transform(
        results,
        lambda x: F.struct(
            x["url"].alias("url"),
            F.coalesce(x["title"], F.lit("")).alias("title"),
            F.coalesce(F.nullif(x["content"], F.lit("")), x["snippet"], F.lit("")).alias("snippet"),
        ),
    )
    return _hits(computed_once(answers, {"_items": items}), kept, "_items", None, limit)


def market_urls_from_json(answers: DataFrame) -> DataFrame:
    """Marketplace product URLs named in JSON answers, first of each numeric id per answer."""
    from offerloom.functions.query import classify_slug

    kept = [c for c in answers.columns if c != "body"]
    urls = F.transform(F.from_json("body", _ANSWER)["results"], lambda x: x["url"])
    parsed = F.filter(
        F.transform(
            urls, lambda x: F.struct(x.alias("url"), u.market_product(x).alias("m"))
        ),
        lambda x: x["m"].isNotNull(),
    )
    found = computed_once(answers, {"_m": parsed})
    first = first_of_each(F.col("_m"), lambda x: x["m"]["numeric_id"])
    return found.select(*kept, F.posexplode(first).alias("rank", "_x")).select(
        *kept, "rank", "_x.url", "_x.m.slug", "_x.m.numeric_id",
        classify_slug(F.col("_x.m.slug")).alias("category"),
    )


def serp_from_html(pages: DataFrame, limit: int = 20) -> DataFrame:
    """Hits of saved result pages (``provider``, ``html``) of the three front ends.

    Breadcrumb lines are turned back into URLs and redirect links decoded; consent pages give
    nothing.
    """
    kept = [c for c in pages.columns if c != "html"]
    blocks = pages.where(~o.is_consent_page(F.col("html"))).withColumn(
        "_b", serp_blocks("html", "provider")
    )
    provider = F.col("provider")

    def hit(x):
        url = (
            F.when(provider == "bing", u.breadcrumb_url(x["cite"]))
            .when(provider == "yahoo", u.breadcrumb_url(x["cite"], loose=True))
            .otherwise(u.redirect_target(strip(x["href"])))
        )
        bare = squish(F.regexp_replace(x["title"], r"https?://\S+", ""))
        title = F.when(
            (provider == "yahoo") & (bare != ""), bare
        ).otherwise(strip(x["title"]))
        return F.struct(
            url.alias("url"), title.alias("title"), F.coalesce(x["snippet"], F.lit("")).alias("snippet")
        )

    hits = computed_once(blocks.drop("html"), {"_items": F.transform("_b", hit)})
    return _hits(hits, kept, "_items", 1, limit)
