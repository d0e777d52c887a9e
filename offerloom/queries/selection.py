"""Summaries, groups, caps, tiers, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.operators import selection as sel
from offerloom.operators import setops, sql_jobs, summaries
from offerloom.operators.ranking import top_n
from offerloom.operators.urls import classify_urls
from offerloom.queries.inputs import (
    ORDER_OFFERS_SQL,
    PAGE_HITS_SQL,
    PART_LINKS_SQL,
    order_offers,
    page_hits,
    part_links,
)
from offerloom.queries.registry import query, table

_MEDIAN = "cast(floor(median(price)) as bigint)"


@query("price_summary", f"""with {ORDER_OFFERS_SQL}
select search_id, count(*) filter (price > 0) as total_found,
       min(price) filter (price > 0) as min_price,
       cast(floor(median(price) filter (price > 0)) as bigint) as median_price,
       max(price) filter (price > 0) as max_price
from order_offers group by search_id""")
def price_summary(spark, sf_dir):
    return summaries.price_summary(order_offers(spark, sf_dir))


@query("sql_table_functions", f"""with {ORDER_OFFERS_SQL}, {PART_LINKS_SQL},
one as (select min(search_id) as least from order_offers)
select search_id, 'all' as kind, count(*) filter (price > 0) as n,
       cast(floor(median(price) filter (price > 0)) as bigint) as median_price
from order_offers group by search_id
union all
select search_id, 'one', count(*) filter (price > 0),
       cast(floor(median(price) filter (price > 0)) as bigint)
from order_offers, one where search_id = least group by search_id
union all
select search_id, 'sources', count(distinct source), null from order_offers group by search_id
union all
select search_id, 'rollup', count(*), max(price) filter (price > 0) from order_offers group by search_id
union all
select search_id, 'links', count(*), null from part_links group by search_id""")
def sql_table_functions(spark, sf_dir):
    """Jobs called by name from SQL: over all searches, and over one."""
    offers = order_offers(spark, sf_dir)
    offers.createOrReplaceTempView("_order_offers")
    part_links(spark, sf_dir).createOrReplaceTempView("_part_links")
    sql_jobs.register_jobs(spark, offers="_order_offers", links="_part_links")
    return spark.sql("""
        SELECT search_id, 'all' AS kind, total_found AS n, median_price FROM price_summary()
        UNION ALL
        SELECT search_id, 'one', total_found, median_price
        FROM price_summary((SELECT min(search_id) FROM _order_offers))
        UNION ALL
        SELECT search_id, 'sources', count(*), NULL FROM source_groups() GROUP BY search_id
        UNION ALL
        SELECT search_id, 'rollup', count, max_price FROM summary_rollup() WHERE level = 1
        UNION ALL
        SELECT search_id, 'links', count(quality), NULL FROM classified_urls() GROUP BY search_id""")


@query("price_summary_by_source", f"""with {ORDER_OFFERS_SQL}
select source, count(*) filter (price > 0) as total_found,
       min(price) filter (price > 0) as min_price,
       cast(floor(median(price) filter (price > 0)) as bigint) as median_price,
       max(price) filter (price > 0) as max_price
from order_offers group by source""")
def price_summary_by_source(spark, sf_dir):
    return summaries.price_summary(order_offers(spark, sf_dir), ("source",))


@query("source_groups", f"""with {ORDER_OFFERS_SQL}
select search_id, source, count(*) as count, min(price) as min_price,
       array_to_string(list_sort(list_distinct(list(source_domain))), ',') as domains
from order_offers group by search_id, source""")
def source_groups(spark, sf_dir):
    groups = summaries.source_groups(order_offers(spark, sf_dir))
    return groups.withColumn("domains", F.array_join("domains", ","))


@query("summary_rollup", f"""with {ORDER_OFFERS_SQL}
select search_id, source, cast(grouping(source) as integer) as level, count(*) as count,
       count(*) filter (price > 0) as total_found, min(price) filter (price > 0) as min_price,
       cast(floor(median(price) filter (price > 0)) as bigint) as median_price,
       max(price) filter (price > 0) as max_price
from order_offers group by grouping sets ((search_id, source), (search_id))""")
def summary_rollup(spark, sf_dir):
    return summaries.summary_rollup(order_offers(spark, sf_dir))


_SLOTS = """slots(source, display_name, ord) as (values ('wildberries', 'Wildberries', 0),
  ('yandex_market', 'Яндекс Маркет', 1), ('other', 'Другие источники', 2), ('ozon', 'Ozon', 3))"""


@query("fixed_slots", f"""with {ORDER_OFFERS_SQL}, {_SLOTS},
g as (select search_id, source, count(*) as count, min(price) as min_price
      from order_offers group by search_id, source)
select cast(c_custkey as varchar) as search_id, slots.source, display_name, ord,
       coalesce(count, 0) as count, min_price
from customer cross join slots
left join g on g.search_id = cast(c_custkey as varchar) and g.source = slots.source""")
def fixed_slots(spark, sf_dir):
    searches = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("search_id")
    )
    groups = summaries.source_groups(order_offers(spark, sf_dir))
    return summaries.fill_sources(groups, searches).drop("domains")


@query("arrived_sources", f"""with {ORDER_OFFERS_SQL}, {_SLOTS}
select source, search_id, count(*) as count, any_value(display_name) as display_name,
       any_value(ord) as ord
from order_offers join slots using (source) where source in ('wildberries', 'ozon')
group by search_id, source""")
def arrived_sources(spark, sf_dir):
    groups = summaries.source_groups(order_offers(spark, sf_dir))
    return summaries.arrived_sources(groups, ["wildberries", "ozon"]).select(
        "source", "search_id", "count", "display_name", "ord"
    )


@query("empty_response", f"""with {_SLOTS}
select cast(c_custkey as varchar) as search_id, source, display_name, ord,
       cast(0 as bigint) as count
from customer cross join slots where source in ('other', 'ozon')""")
def empty_response(spark, sf_dir):
    searches = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("search_id")
    )
    return summaries.empty_response(searches, ["other", "ozon"]).drop("min_price", "domains")


@query("partial_summary", f"""with {ORDER_OFFERS_SQL},
r as (select search_id, source, count(*) as received from order_offers
      group by search_id, source),
t as (select search_id, cast(sum(greatest(received, received % 3 + 2)) as bigint) as total_found
      from r group by search_id)
select t.search_id, total_found, min(price) filter (price > 0) as min_price,
       cast(floor(median(price) filter (price > 0) + 0.5) as bigint) as median_price,
       max(price) filter (price > 0) as max_price
from t join order_offers using (search_id) group by t.search_id, total_found""")
def partial_summary(spark, sf_dir):
    offers = order_offers(spark, sf_dir)
    stated = offers.groupBy("search_id", "source").agg(
        (F.count("*") % 3 + 2).alias("count")
    )
    return summaries.partial_summary(stated, offers)


@query("cap_per_domain", f"""with {ORDER_OFFERS_SQL},
a as (select *, row_number() over (partition by search_id, source_domain
        order by relevance_score desc, position) as d from order_offers),
b as (select *, row_number() over (partition by search_id
        order by relevance_score desc, position) as rank from a where d <= 2)
select search_id, source_domain, position, relevance_score, rank from b where rank <= 6""")
def cap_per_domain(spark, sf_dir):
    capped = sel.cap_per_domain(order_offers(spark, sf_dir), 2, 6, rank_col="rank")
    return capped.select("search_id", "source_domain", "position", "relevance_score", "rank")


@query("cap_per_domain_hot", f"""with {ORDER_OFFERS_SQL},
a as (select *, row_number() over (partition by source, source_domain
        order by relevance_score desc, position) as d from order_offers),
b as (select *, row_number() over (partition by source
        order by relevance_score desc, position) as rank from a where d <= 5)
select source, source_domain, position, relevance_score, rank from b where rank <= 15""")
def cap_per_domain_hot(spark, sf_dir):
    capped = sel.cap_per_domain(
        order_offers(spark, sf_dir), keys=("source",), rank_col="rank"
    )
    return capped.select("source", "source_domain", "position", "relevance_score", "rank")


@query("first_n", f"""with {ORDER_OFFERS_SQL}
select search_id, source, position, price from order_offers
qualify row_number() over (partition by search_id, source order by position) <= 3""")
def first_n(spark, sf_dir):
    return sel.first_n(order_offers(spark, sf_dir), 3).select(
        "search_id", "source", "position", "price"
    )


@query("diversify", f"""with {PAGE_HITS_SQL},
c as (select search_id, position, url, length(title) as score,
             regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www[.]', '')
               as host from page_hits),
d as (select *, row_number() over (partition by search_id, host
        order by score desc, position) as dn from c),
p as (select * from d where dn <= 2
      qualify row_number() over (partition by search_id order by score desc, position) <= 30),
s as (select * from d where not exists (select 1 from p where p.search_id = d.search_id
        and p.url = d.url)
      qualify row_number() over (partition by search_id, url order by score desc, position) = 1),
u as (select *, 0 as tier from p union all select *, 1 from s)
select search_id, position, host, score, row_number() over (partition by search_id
         order by tier, score desc, position) as rank from u
qualify rank <= 30""")
def diversify(spark, sf_dir):
    hits = page_hits(spark, sf_dir).withColumn("score", F.length("title"))
    classified = classify_urls(hits).select("search_id", "position", "url", "score", "host")
    return sel.diversify(classified, 30).select("search_id", "position", "host", "score", "rank")


_FAMILY = """case when p_size < 10 then 0 when p_size < 30 then 1 else 2 end"""


@query("first_nonempty_tier", f"""with t as (
  select p_brand, p_name, p_partkey, {_FAMILY} as tier from part)
select p_brand as search_id, p_name as title, p_partkey as position, tier from t
qualify tier = min(tier) over (partition by p_brand, p_name)""")
def first_nonempty_tier(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    tiers = part.select(
        F.col("p_brand").alias("search_id"),
        F.col("p_name").alias("title"),
        F.col("p_partkey").alias("position"),
        F.expr(_FAMILY).alias("tier"),
    )
    return sel.first_nonempty(tiers, ["search_id", "title"]).select(
        "search_id", "title", "position", "tier"
    )


@query("paged_collect", """with o as (
  select l_orderkey // 4 as search_id, l_linenumber as page,
         l_orderkey * 10 + l_linenumber as base, l_suppkey % 20 as key, l_partkey from lineitem),
p as (select *, row_number() over (partition by search_id, page
        order by base, key, l_partkey) as position from o),
f as (select *, row_number() over (partition by search_id, key
        order by page, position) as seen from p),
n as (select distinct search_id, page from f where seen = 1),
m as (select *, row_number() over (partition by search_id order by page) as nth from n)
select f.search_id, f.page, f.position, f.key from f
join m on m.search_id = f.search_id and m.page = f.page and m.nth = m.page
where f.seen = 1
qualify row_number() over (partition by f.search_id order by f.page, f.position) <= 15""")
def paged_collect(spark, sf_dir):
    from pyspark.sql import Window as W

    lines = table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 4").alias("search_id"),
        F.col("l_linenumber").alias("page"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("base"),
        (F.col("l_suppkey") % 20).alias("key"),
        "l_partkey",
    )
    shown = lines.withColumn(
        "position",
        F.row_number().over(W.partitionBy("search_id", "page").orderBy("base", "key", "l_partkey")),
    )
    return sel.paged_collect(shown, "key").select("search_id", "page", "position", "key")


@query("best_capture", """with c as (
  select o_custkey as search_id, row_number() over (partition by o_custkey order by o_orderkey)
           as round, o_orderkey % 23 as n_offers from orders),
s as (select search_id, min(round) filter (n_offers >= 15) as stop from c group by search_id)
select c.search_id, c.round, c.n_offers from c join s using (search_id)
where stop is null or round <= stop
qualify row_number() over (partition by c.search_id order by n_offers desc, round) = 1""")
def best_capture(spark, sf_dir):
    from pyspark.sql import Window as W

    captures = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("search_id"),
        F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("round"),
        (F.col("o_orderkey") % 23).alias("n_offers"),
    )
    return sel.best_capture(captures)


@query("sort_by_price", f"""with {ORDER_OFFERS_SQL}
select search_id, position, price,
       row_number() over (partition by search_id order by price <= 0, price desc, position) as rank
from order_offers qualify rank <= 5""")
def sort_by_price(spark, sf_dir):
    order = [(F.col("price") <= 0).asc(), F.desc("price"), F.asc("position")]
    return top_n(order_offers(spark, sf_dir), ["search_id"], order, 5, "rank").select(
        "search_id", "position", "price", "rank"
    )


@query("rank_offers", f"""with {ORDER_OFFERS_SQL}
select search_id, source, position, relevance_score from order_offers""")
def rank_offers(spark, sf_dir):
    return sel.rank_offers(order_offers(spark, sf_dir)).select(
        "search_id", "source", "position", "relevance_score"
    )


_HOST = (
    "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www[.]', '')"
)


@query("merge_first_wins", f"""with {PART_LINKS_SQL}, {PAGE_HITS_SQL},
u as (select search_id, position, url, 0 as src_ord from part_links
      union all select search_id, position, url, 1 from page_hits
      union all select search_id, position + 1, replace(url, 'http://', 'https://'), 2
      from page_hits),
k as (select *, split_part(url, '#', 1) as url_key from u where not contains({_HOST}, 'market.ru'))
select search_id, position, url, src_ord, url_key from k
qualify row_number() over (partition by search_id, url_key order by src_ord, position) = 1""")
def merge_first_wins(spark, sf_dir):
    hits = page_hits(spark, sf_dir).select("search_id", "position", "url")
    secure = hits.select(
        "search_id",
        (F.col("position") + 1).alias("position"),
        F.replace("url", F.lit("http://"), F.lit("https://")).alias("url"),
    )
    links = part_links(spark, sf_dir).select("search_id", "position", "url")
    return setops.merge_candidates(links, hits, secure)


@query("except_seen", """select p_partkey, p_name, p_brand from part
where p_partkey not in (select l_suppkey from lineitem)""")
def except_seen(spark, sf_dir):
    numbers = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("p_partkey"))
    return setops.except_seen(numbers, seen, ["p_partkey"])


@query("merge_by_id", """with u as (
  select p_brand as search_id, p_partkey as id, p_partkey as position, 'index' as provider,
         0 as src_ord from part where p_size <= 25
  union all
  select p_brand, p_partkey, p_partkey + 1, 'live', 1 from part where p_size >= 20)
select * from u
qualify row_number() over (partition by search_id, id order by src_ord, position) = 1""")
def merge_by_id(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    base = part.select(
        F.col("p_brand").alias("search_id"), F.col("p_partkey").alias("id"), "p_size", "p_partkey"
    )
    indexed = base.where("p_size <= 25").select(
        "search_id", "id", F.col("p_partkey").alias("position"), F.lit("index").alias("provider")
    )
    live = base.where("p_size >= 20").select(
        "search_id", "id", (F.col("p_partkey") + 1).alias("position"),
        F.lit("live").alias("provider"),
    )
    return setops.merge_by_id(indexed, live, key="id")


@query("distinct_first", """select p_name, p_partkey, p_brand from part
qualify row_number() over (partition by p_name order by p_retailprice desc, p_partkey) = 1""")
def distinct_first(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return setops.distinct_first(
        part, ["p_name"], [F.desc("p_retailprice"), F.asc("p_partkey")]
    ).select("p_name", "p_partkey", "p_brand")
