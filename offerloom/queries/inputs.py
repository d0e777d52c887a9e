"""The given tables seen as offers, candidates, searches and logs.

Each view is defined twice, as a DataFrame and as the SQL the twins build on. Every view
reads its whole table, and its number of searches grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.queries.registry import spread, table

# Orders as offers: a customer is a search, the priority class the source.
_SOURCE_OF_PRIORITY = """case substr(o_orderpriority, 1, 1)
        when '1' then 'wildberries' when '2' then 'yandex_market'
        when '3' then 'other' else 'ozon' end"""

ORDER_OFFERS_SQL = f"""order_offers as (
    select cast(o_custkey as varchar) as search_id, {_SOURCE_OF_PRIORITY} as source,
           o_orderkey as position,
           'shop' || cast(o_orderkey % 7 as varchar) || '.ru' as source_domain,
           case when o_orderstatus = 'P' then 0
                else cast(round(o_totalprice * 100) as bigint) end as price,
           round((o_totalprice - floor(o_totalprice / 1000) * 1000) / 1000, 6) as relevance_score
    from orders)"""


def order_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_custkey").cast("string").alias("search_id"),
        F.expr(_SOURCE_OF_PRIORITY).alias("source"),
        F.col("o_orderkey").alias("position"),
        F.concat(
            F.lit("shop"), (F.col("o_orderkey") % 7).cast("string"), F.lit(".ru")
        ).alias("source_domain"),
        F.when(F.col("o_orderstatus") == "P", F.lit(0).cast("bigint"))
        .otherwise(F.round(F.col("o_totalprice") * 100).cast("bigint"))
        .alias("price"),
        F.round(
            (F.col("o_totalprice") - F.floor(F.col("o_totalprice") / 1000) * 1000) / 1000, 6
        ).alias("relevance_score"),
    )


# Parts as shop links of many shapes: products, family pages, catalogues, rejects.
_SLUG = "replace(p_name, ' ', '-')"
_LINK = f"""case p_size % 16
    when 0 then 'https://www.' || shop || '/product/' || slug || '-' || pk
    when 1 then 'https://' || shop || '/catalog/' || slug || '/'
    when 2 then 'https://' || shop || '/catalog/' || pk || '/'
    when 3 then 'http://' || shop || '/' || slug || '/'
    when 4 then 'https://spb.e2e4online.ru/catalog/item/' || pk || '/'
    when 5 then 'https://' || shop || '/catalog/apple_iphone-' || cast(p_size as varchar)
    when 6 then 'https://' || shop || '/compare?ids=' || pk
    when 7 then 'https://' || shop || '/news/' || slug
    when 8 then 'https://www.dns-shop.ru/catalog/17a8a/' || slug || '/?p=' || pk
    when 9 then 'https://' || shop || '/category/smartfony/' || slug
    when 10 then 'https://' || shop || '/de/' || slug || '/' || pk
    when 11 then 'https://' || shop || '/shiny/205-55-R16/'
    when 12 then 'https://' || shop || '/p/' || pk || '/#reviews'
    when 13 then 'https://market.ru/goods/' || pk
    when 14 then 'https://' || shop || '/smartfony/128gb-' || slug || '.html'
    else 'https://' || shop end"""
_SHOP = """case when p_partkey % 3 = 0 then 'shop' || cast(p_size % 5 as varchar) || '.ru'
         when p_partkey % 3 = 1 then 'store' || cast(p_size % 4 as varchar) || '.com'
         else 'moscow.technocity.ru' end"""

PART_LINKS_SQL = f"""part_links0 as (
    select p_partkey, p_name, p_brand, p_size, p_retailprice, {_SLUG} as slug,
           cast(p_partkey as varchar) as pk, {_SHOP} as shop from part),
part_links as (
    select p_brand as search_id, p_partkey as position, p_name as title,
           p_type_snippet as snippet, {_LINK} as url
    from (select part_links0.*, p_brand as p_type_snippet from part_links0))"""


def part_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    part = spread(rows, "p_partkey").select(
        "p_partkey", "p_name", "p_brand", "p_size",
        F.expr(_SLUG).alias("slug"),
        F.expr("cast(p_partkey as string)").alias("pk"),
        F.expr(_SHOP.replace("varchar", "string")).alias("shop"),
    )
    return part.select(
        F.col("p_brand").alias("search_id"),
        F.col("p_partkey").alias("position"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("snippet"),
        F.expr(_LINK.replace("varchar", "string")).alias("url"),
    )


# Crawled pages as search hits: the page language is the search.
PAGE_HITS_SQL = """page_hits as (
    select coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1), ''), '-')
             as search_id,
           page_id as position, url,
           coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), '') as title
    from pages)"""


def page_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.coalesce(
            F.nullif(F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)/", 1), F.lit("")),
            F.lit("-"),
        ).alias("search_id"),
        F.col("page_id").alias("position"),
        "url",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
    )


# Events as a request log: the event type decides status, layer and outcome.
REQUESTS_SQL = """requests as (
    select event_id as request_id, ts, cast(user_id as varchar) as user_id,
           event_type as endpoint,
           case event_type when 'error' then 429 when 'signup' then 403 else 200 end as status,
           value as latency_ms,
           event_type not in ('error', 'signup') as success,
           event_type = 'view' as cache_hit,
           case when event_type = 'click' then 'browser' else 'primary' end as layer
    from events)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("user_id"),
        kind.alias("endpoint"),
        F.when(kind == "error", 429).when(kind == "signup", 403).otherwise(200).alias("status"),
        F.col("value").alias("latency_ms"),
        (~kind.isin("error", "signup")).alias("success"),
        (kind == "view").alias("cache_hit"),
        F.when(kind == "click", "browser").otherwise("primary").alias("layer"),
    )
