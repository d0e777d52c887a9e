"""Whole plans over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.operators import extraction
from offerloom.operators.offers import to_offers
from offerloom.operators.settling import settle
from offerloom.plans import marketplaces, other_shops
from offerloom.plans.search import search_responses
from offerloom.queries.inputs import ORDER_OFFERS_SQL, order_offers
from offerloom.queries.registry import query, spread, table


@query("search_responses", f"""with {ORDER_OFFERS_SQL},
k as (select * from order_offers
      qualify row_number() over (partition by search_id, source order by position) <= 15),
s as (select search_id, count(*) filter (price > 0) as total_found, min(price) filter (price > 0) as min_price,
        cast(floor(median(price) filter (price > 0)) as bigint) as median_price, max(price) filter (price > 0) as max_price
      from order_offers group by search_id),
a as (select search_id, source, count(*) as n, min(price) as lo,
        array_to_string(list_sort(list_distinct(list(source_domain))), ',') as ds from order_offers group by search_id, source),
g as (select search_id, source, case source when 'wildberries' then 0 when 'yandex_market' then 1 when 'other' then 2 else 3 end as ord,
        any_value(n) as n, any_value(lo) as lo, any_value(ds) as ds,
        string_agg(cast(position as varchar), ',' order by position) as ps
      from k join a using (search_id, source) group by search_id, source),
d as (select search_id, string_agg(source || ':' || n || ':' || lo || ':' || ds || ':complete:' || ps, '|' order by ord) as groups
      from g group by search_id)
select cast(c_custkey as varchar) as search_id, trim(c_name) as original, 'spb' as region, 'Санкт-Петербург' as region_name,
  total_found, min_price, median_price, max_price, coalesce(groups, '') as groups
from customer left join s on s.search_id = cast(c_custkey as varchar) left join d on d.search_id = cast(c_custkey as varchar)""")
def search_responses_query(spark, sf_dir):
    searches = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("search_id"),
        F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("query"), F.lit(" SPB").alias("region"),
    )
    offers = order_offers(spark, sf_dir).withColumns(
        {
            "title": F.col("position").cast("string"),
            "product_url": F.concat(F.lit("https://a.ru/"), "position"),
        }
    )
    canonical = [
        to_offers(offers.where(F.col("source") == s), s)
        for s in ("wildberries", "yandex_market", "other", "ozon")
    ]
    documents = search_responses(searches, canonical)
    groups = F.transform(
        "groups",
        lambda g: F.concat_ws(
            ":", g["source"], g["count"].cast("string"), g["min_price"].cast("string"),
            F.array_join(g["domains"], ","), g["status"],
            F.array_join(F.transform(g["products"], lambda p: p["title"]), ","),
        ),
    )
    return documents.select(
        "search_id", "query.original", "query.region", "query.region_name", "summary.*",
        F.array_join(groups, "|").alias("groups"),
    )


@query("card_source", """with i as (
  select p_partkey // 24 as search_id, (p_partkey // 8) % 3 + 1 as page, p_partkey,
    p_name || ' ' || p_type || ' ' || p_brand as title, cast(floor(p_retailprice) as bigint) * 100 as price from part)
select search_id, p_partkey, price from i
qualify row_number() over (partition by search_id order by page, p_partkey) <= 15""")
def card_source(spark, sf_dir):
    """Three card pages per search; the link tells the offers apart, the titles are distinct
    by a long number."""
    part = table(spark, sf_dir, "part")
    number = F.sha2(F.col("p_partkey").cast("string"), 256)
    card = F.concat(
        F.lit('<article><h3 data-auto="snippet-title">'), number, F.lit('</h3><span data-auto="price-value">'),
        F.floor("p_retailprice"), F.lit(' ₽</span><a href="/card/'), "p_partkey", F.lit('">l</a></article>'))
    pages = (
        part.withColumn("card", card)
        .groupBy(F.expr("p_partkey div 24").alias("search_id"), F.expr("(p_partkey div 8) % 3 + 1").alias("page"))
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "card"))), lambda x: x["card"]), ""
            ).alias("html")
        )
    )
    offers = marketplaces.card_source(pages)
    return offers.select(
        "search_id", F.substring_index("product_url", "/", -1).cast("bigint").alias("p_partkey"), "price"
    )


@query("broad_source", """with q as (select label, min_by(embedding, vec_id) as qe from embeddings group by label),
g as (select label, label * 1000 + (row_number() over (partition by label order by vec_id) - 1) // 40 as search_id, vec_id, embedding from embeddings),
s as (select search_id, vec_id, list_dot_product(embedding::double[], qe::double[]) as sim,
        count(*) over (partition by search_id) as n from g join q using (label))
select search_id, vec_id, case when n > 20 then round(sim, 4) else 0 end as relevance_score from s
qualify row_number() over (partition by search_id order by case when n > 20 then -sim end, vec_id) <= 15""")
def broad_source(spark, sf_dir):
    from pyspark.sql import Window as W

    vectors = table(spark, sf_dir, "embeddings")
    nth = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    placed = vectors.withColumn(
        "search_id", F.col("label") * 1000 + F.floor(nth / 40)
    )
    title = F.concat(F.lit("vector number "), "vec_id")
    tile = F.concat(
        F.lit('<div class="tile-root"><a href="/product/'), "vec_id", F.lit('/"><span class="tsBody500Medium">'), title,
        F.lit('</span></a><span class="tsHead500Medium">100 ₽</span></div>'))
    pages = (
        placed.withColumn("tile", tile).groupBy("search_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "tile"))), lambda x: x["tile"]), "").alias("html"))
    )
    heads = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query_embedding"))
    queries = placed.select("search_id", "label").distinct().join(heads, "label").drop("label")
    named = vectors.select(title.alias("title"), "embedding")
    offers = marketplaces.broad_source(pages, named, queries)
    return offers.select(
        "search_id", F.regexp_extract("product_url", r"/(\d+)/", 1).cast("bigint").alias("vec_id"),
        F.round("relevance_score", 4).alias("relevance_score"),
    )


@query("other_shops", """with i as (
  select p_brand as search_id, p_partkey, cast(floor(p_retailprice) as bigint) * 100 as price,
    'shop' || cast(p_partkey % 40 as varchar) || '.ru' as domain from part),
p as (select * from i qualify row_number() over (partition by search_id order by p_partkey) <= 45),
w as (select * from p qualify row_number() over (partition by search_id order by p_partkey) <= 32),
c as (select * from w qualify row_number() over (partition by search_id, domain order by p_partkey) <= 5)
select search_id, p_partkey, domain, price from c
qualify row_number() over (partition by search_id order by p_partkey) <= 15""")
def other_shops_query(spark, sf_dir):
    """Every part is a product page found for its brand; the brand's query matches them all."""
    part = spread(
        table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice"), "p_partkey"
    )
    domain = F.concat(F.lit("shop"), F.col("p_partkey") % 40, F.lit(".ru"))
    url = F.concat(F.lit("https://"), domain, F.lit("/product/"), "p_partkey")
    searches = part.select(
        F.col("p_brand").alias("search_id"), F.lit("товар").alias("query"), F.lit("unknown").alias("category")
    ).distinct()
    hits = part.select(
        F.col("p_brand").alias("search_id"), F.col("p_partkey").alias("position"), url.alias("url"),
        F.col("p_name").alias("title"), F.lit("").alias("snippet"), F.lit("yahoo").alias("provider"),
        F.lit(0.0).alias("similarity"),
    )
    ld = F.to_json(
        F.struct(
            F.lit("Product").alias("@type"), F.concat(F.lit("товар "), "p_name").alias("name"),
            F.struct(F.floor("p_retailprice").cast("string").alias("price")).alias("offers"),
        )
    )
    pages = part.select(
        url.alias("url"), F.lit(200).alias("status"),
        F.concat(F.lit('<html><script type="application/ld+json">'), ld, F.lit("</script>"), F.repeat(F.lit("<p>x</p>"), 30)).alias("html"),
    )
    # the link table is a stored input of the plan
    links = settle(
        extraction.page_links(pages.drop("status")).withColumnRenamed("url", "page")
    )
    offers = other_shops.collect_other_shops(searches, hits, pages, links)
    return offers.select(
        "search_id", F.substring_index("product_url", "/", -1).cast("bigint").alias("p_partkey"),
        F.col("source_domain").alias("domain"), "price",
    )
