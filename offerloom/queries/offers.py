"""Prices, titles, characteristics, payloads, feeds and enrichment."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.functions import offer as o
from offerloom.functions import price as p
from offerloom.functions import text as t
from offerloom.operators import offers as ops
from offerloom.queries.registry import query, table
from offerloom.sources import feeds, payloads
from offerloom.sources.pages import valid_pages


def _sql(expression: str) -> str:
    return expression.replace("varchar", "string")


_GROUPED = """case when floor(p_retailprice) >= 1000 then cast(cast(floor(p_retailprice / 1000) as bigint) as varchar)
      || ' ' || lpad(cast(cast(floor(p_retailprice) as bigint) % 1000 as varchar), 3, '0')
    else cast(cast(floor(p_retailprice) as bigint) as varchar) end"""
_WHOLE = "cast(floor(p_retailprice) as bigint)"
_PRICE_TEXT = f"""case p_size % 6 when 0 then {_GROUPED} || ' ₽'
    when 1 then cast({_WHOLE} as varchar) when 2 then cast({_WHOLE} as varchar) || '.50'
    when 3 then 'цена ' || {_GROUPED} || ' руб.' when 4 then 'abc' else '0' end"""


@query("parse_price", f"""select p_partkey,
  case when p_size % 6 < 4 then {_WHOLE} end as price_rub,
  case when p_size % 6 = 2 then ({_WHOLE} * 100 + 50) * 100 when p_size % 6 < 4 then {_WHOLE} * 100
       when p_size % 6 = 5 then 0 end as kopecks
from part""")
def parse_price(spark, sf_dir):
    texts = table(spark, sf_dir, "part").select(
        "p_partkey", F.expr(_sql(_PRICE_TEXT)).alias("price_text")
    )
    return texts.select(
        "p_partkey",
        p.parse_price(F.col("price_text")).alias("price_rub"),
        p.parse_price_kopecks(F.col("price_text")).alias("kopecks"),
    )


@query("plausible_price", f"""select p_partkey,
  case when p_size % 4 < 3 then {_WHOLE} end as price_rub
from part""")
def plausible_price(spark, sf_dir):
    # model number in front: only the last grouped number can be the price
    text = F.expr(_sql(f"""case p_size % 4 when 0 then {_GROUPED} when 1 then cast({_WHOLE} as varchar)
        when 2 then '90000000 ' || {_GROUPED} else '7' end"""))
    return table(spark, sf_dir, "part").select(
        "p_partkey", p.plausible_price(text).alias("price_rub")
    )


@query("page_price", f"""select p_partkey, {_WHOLE} as price_rub from part""")
def page_price(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.expr(_sql(f"""case p_size % 5
          when 0 then '<p>товар</p>'
          when 1 then concat('<b>1 ₽</b><span itemprop="price" content="', {_WHOLE}, '">')
          when 2 then concat('<div data-price="', {_WHOLE}, '">')
          when 3 then concat('<p>скидка 7 руб.</p><p>', {_GROUPED}, ' ₽</p>') else '<i></i>' end""")).alias("html"),
        F.expr(_sql(f"""case p_size % 5 when 0 then {_WHOLE} when 4 then 1L end""")).alias("structured"),
        F.expr(_sql(f"""case p_size % 5 when 4 then concat('всего ', {_GROUPED}, ' руб.') else '' end""")).alias("described"),
    )
    return part.select(
        "p_partkey",
        p.page_price(F.col("html"), F.col("structured"), F.col("described")).alias("price_rub"),
    )


@query("snippet_fields", """select p_partkey, round(p_size / 10.0, 1)::double as rating,
  case when p_size % 2 = 0 then p_partkey + 1000 else p_partkey end as reviews,
  case when p_size % 3 = 0 then p_partkey * 2 end as bought from part""")
def snippet_fields(spark, sf_dir):
    text = F.concat(
        F.format_string("%d,%d", F.floor(F.col("p_size") / 10), F.col("p_size") % 10),
        F.when(
            F.col("p_size") % 2 == 0, F.concat(F.lit("("), F.col("p_partkey") + 1000, F.lit(")"))
        ).otherwise(F.concat(F.lit(" · "), F.col("p_partkey"), F.lit(" отзывов"))),
        F.when(
            F.col("p_size") % 3 == 0, F.concat(F.lit(" · "), F.col("p_partkey") * 2, F.lit(" купили"))
        ).otherwise(""),
    )
    texts = table(spark, sf_dir, "part").select("p_partkey", text.alias("snippet"))
    c = F.col("snippet")
    return texts.select(
        "p_partkey",
        o.parse_rating(c).alias("rating"),
        o.parse_reviews(c).alias("reviews"),
        o.parse_bought(c).alias("bought"),
    )


@query("clean_titles", """select p_partkey, p_name || ' & Чехол «' || p_type || '»' as title,
  case when p_size % 7 = 0 then null when p_size % 7 = 1 then null else p_name end as kept,
  p_name || ' чехол ' || lower(p_type) as title_key from part""")
def clean_titles(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    raw = F.concat(F.col("p_name"), F.lit("&nbsp; &amp;Чехол   &laquo;"), F.col("p_type"), F.lit("&raquo;"))
    badge = F.when(F.col("p_size") % 7 == 0, F.lit("ab")).when(
        F.col("p_size") % 7 == 1, F.concat(F.lit("Распродажа "), F.col("p_name"))
    ).otherwise(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \n ")), F.lit(" ")))
    cleaned = part.select(
        "p_partkey", t.clean_title(raw).alias("title"), o.reject_badge_title(badge).alias("kept")
    )
    return cleaned.withColumn("title_key", t.title_key(F.col("title")))


@query("title_characteristics", """select p_partkey,
  'color=' || case p_size % 3 when 0 then 'черный' when 1 then 'синий' else 'none' end
  || '|memory=' || cast(p_size * 8 as varchar) || ' ГБ|variant='
  || case p_size % 3 when 0 then 'черный, ' when 1 then 'синий, ' else '' end
  || cast(p_size * 8 as varchar) || ' ГБ' as chars from part""")
def title_characteristics(spark, sf_dir):
    colour = F.when(F.col("p_size") % 3 == 0, ", черный").when(
        F.col("p_size") % 3 == 1, ", синий"
    ).otherwise("")
    titles = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat("p_name", colour, F.lit(", "), F.col("p_size") * 8, F.lit(" ГБ")).alias("title"),
    )
    chars = titles.select("p_partkey", o.title_characteristics(F.col("title")).alias("m"))
    part = [
        F.concat(F.lit(f"{k}="), F.coalesce(F.try_element_at("m", F.lit(k)), F.lit("none")))
        for k in ("color", "memory", "variant")
    ]
    return chars.select("p_partkey", F.concat_ws("|", *part).alias("chars"))


_ANSWER = """case when (p_partkey // 84) % 2 = 0 then p_partkey // 7
    else 1000000000 + p_partkey // 3 end"""


# Search-API answers rebuilt from part: nested lists of three products count as throttled.
def _payload_rows(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    product = F.struct(
        (F.col("p_partkey") * 1000 + 7).alias("id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("brand"),
        F.col("p_type").alias("supplier"),
        F.array(F.lit("красный"), F.lit(" синий ")).alias("colors"),
        (F.col("p_size") % 9).alias("totalQuantity"),
        (F.col("p_size") / 10).alias("reviewRating"),
        F.col("p_size").alias("nmFeedbacks"),
        F.when(F.col("p_size") % 3 == 0, F.col("_k")).alias("salePriceU"),
        F.when(
            F.col("p_size") % 3 != 0,
            F.array(F.struct(F.struct(F.lit(0).alias("product"), F.col("_k").alias("basic")).alias("price"))),
        ).alias("sizes"),
    )
    # answers of seven or of three products
    return (
        part.withColumn("_k", F.round(F.col("p_retailprice") * 100).cast("bigint"))
        .groupBy(F.expr(_ANSWER.replace("//", "div")).alias("search_id"))
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("p_partkey", product.alias("p")))),
                lambda x: x["p"],
            ).alias("ps"),
        )
        .select(
            "search_id",
            F.when(F.col("search_id") % 4 == 0, F.to_json(F.struct(F.struct(F.col("ps").alias("products")).alias("data"))))
            .otherwise(F.to_json(F.struct(F.col("ps").alias("products"))))
            .alias("body"),
        )
    )


_PAYLOAD_SQL = f"""a as (
    select {_ANSWER} as search_id, part.*,
      row_number() over (partition by {_ANSWER} order by p_partkey) - 1 as pos,
      count(*) over (partition by {_ANSWER}) as n from part),
kept as (select * from a where pos < 15 and (search_id % 4 <> 0 or n >= 5))"""


@query("payload_products", f"""with {_PAYLOAD_SQL}
select search_id, cast(pos as integer) as position, p_partkey * 1000 + 7 as article,
  cast(round(p_retailprice * 100) as bigint) as price from kept""")
def payload_products(spark, sf_dir):
    products = payloads.read_payload_products(_payload_rows(spark, sf_dir))
    return products.select(
        "search_id", "position", F.col("product.id").alias("article"),
        p.payload_price(F.col("product")).alias("price"),
    )


@query("payload_offers", f"""with {_PAYLOAD_SQL}
select search_id, pos as position, p_name as title, cast(round(p_retailprice * 100) as bigint) as price,
  'https://www.wildberries.ru/catalog/' || cast(p_partkey * 1000 + 7 as varchar) || '/detail.aspx' as product_url,
  'Характеристики:' || chr(10) || case when p_size % 2 = 0 then '• Бренд: ' || p_brand || chr(10) else '' end
  || '• Продавец: ' || p_type || chr(10) || '• Цвет: красный, синий' || chr(10)
  || '• В наличии: ' || cast(p_size % 9 as varchar) || chr(10) || chr(10)
  || 'Рейтинг: ' || regexp_replace(cast((p_size / 10.0)::double as varchar), '[.]0$', '')
  || ' (' || cast(p_size as varchar) || ' отзывов)' as description
from kept""")
def payload_offers(spark, sf_dir):
    products = payloads.read_payload_products(_payload_rows(spark, sf_dir))
    return payloads.payload_offers(products).select(
        "search_id", "position", "title", "price", "product_url", "description"
    )


@query("feed_triplet", """with ids as (
  select c_custkey as search_id, unnest([c_custkey % 97, c_custkey % 89 + 1]) as id,
         unnest([0, case when c_custkey % 97 = 0 then 0 else 1 end]) as position from customer),
pr as (select l_partkey as id, cast(max_by(floor(l_extendedprice), l_orderkey * 10 + l_linenumber) as bigint)
         as price_rub from lineitem group by l_partkey)
select search_id, position, cast(ids.id as varchar) as product_id, price_rub, p_name as title,
  'описание ' || p_type as description,
  'https://www.mvideo.ru/products/' || replace(p_name, ' ', '-') || '-' || cast(ids.id as varchar)
    as product_url
from ids join pr on pr.id = ids.id join part on p_partkey = ids.id where ids.id > 0""")
def feed_triplet(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    ids = customer.select(
        F.col("c_custkey").alias("search_id"),
        F.to_json(
            F.struct(
                F.struct(
                    F.array(F.col("c_custkey") % 97, F.col("c_custkey") % 89 + 1).alias("products")
                ).alias("body")
            )
        ).alias("body"),
    )
    lines = table(spark, sf_dir, "lineitem")
    prices = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fetched_at"),
        F.to_json(
            F.struct(
                F.struct(
                    F.array(
                        F.struct(
                            F.col("l_partkey").cast("string").alias("productId"),
                            F.struct(
                                F.lit(0).alias("salePrice"),
                                F.floor("l_extendedprice").alias("basePrice"),
                            ).alias("price"),
                        )
                    ).alias("materialPrices")
                ).alias("body")
            )
        ).alias("body"),
    )
    details = table(spark, sf_dir, "part").select(
        F.lit(1).alias("fetched_at"),
        F.to_json(
            F.struct(
                F.struct(
                    F.col("p_partkey").cast("string").alias("productId"),
                    F.col("p_name").alias("name"),
                    F.concat(F.lit("<p>описание</p> <b>"), "p_type", F.lit("</b>")).alias("description"),
                    F.replace("p_name", F.lit(" "), F.lit("-")).alias("nameTranslit"),
                ).alias("body")
            )
        ).alias("body"),
    )
    return feeds.read_feed_triplet(ids, prices, details).select(
        "search_id", "position", "product_id", "price_rub", "title", "description", "product_url"
    )


@query("enrich_cards", """select p_partkey as position,
  case when p_size % 3 = 0 then 0.95 else 0.9 end::double as confidence,
  case when p_size % 3 = 0 then 'Вес' else 'variant' end as char_key,
  case when p_size % 3 = 0 then 'Проза ' || p_type || chr(10) || chr(10) || 'Характеристики:' || chr(10)
     || '• Вес: ' || cast(p_size as varchar) || chr(10) || chr(10) || 'Купили: ' || cast(p_size as varchar)
     || chr(10) || 'Доставка: завтра'
   else 'Купили: ' || cast(p_size as varchar) || chr(10) || 'Доставка: завтра' end as description
from part""")
def enrich_cards(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cards = part.select(
        F.col("p_partkey").alias("position"),
        F.concat(F.lit("https://m.ru/card/"), "p_partkey", F.lit("/?x=1")).alias("product_url"),
        F.concat(F.lit("Купили: "), "p_size", F.lit("\nДоставка: завтра")).alias("description"),
        F.create_map(F.lit("variant"), F.col("p_type")).alias("characteristics"),
        F.lit(None).cast("double").alias("rating"),
        F.lit(None).cast("bigint").alias("reviews_count"),
        F.lit(0.9).alias("confidence"),
    )
    details = part.where("p_size % 3 <> 1").select(
        F.concat(F.lit("https://m.ru/card/"), "p_partkey").alias("url_key"),
        F.when(F.col("p_size") % 3 == 0, "ok").otherwise("blocked").alias("state"),
        F.create_map(F.lit("Вес"), F.col("p_size").cast("string")).alias("specs"),
        F.concat(F.lit("Проза "), "p_type").alias("prose"),
    )
    return ops.enrich_cards(cards, details).select(
        "position", "confidence", "description",
        F.get(F.map_keys("characteristics"), 0).alias("char_key"),
    )


@query("field_issues", """with o as (
  select p_partkey, case when p_size % 10 = 0 then ' ' else p_name end as title,
    case when p_size % 4 = 0 then 0 else p_size end as price,
    case when p_size % 6 = 0 then '/p/' else 'https://a.ru/' end || cast(p_partkey as varchar) as url,
    case when p_size % 15 = 0 then '' else 'http://i.ru/1.png' end as image from part)
select p_partkey, concat_ws('; ', case when trim(title) = '' then 'other: empty title' end,
  case when price <= 0 then 'other: invalid price ' || cast(price as varchar) end,
  case when url not like 'http%' then 'other: bad url ' || url[1:40] end,
  case when image not like 'http%' then 'other: bad image ' || image[1:40] end) as issues from o""")
def field_issues(spark, sf_dir):
    size = F.col("p_size")
    offers = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(size % 10 == 0, F.lit(" ")).otherwise(F.col("p_name")).alias("title"),
        F.when(size % 4 == 0, F.lit(0)).otherwise(size).alias("price"),
        F.concat(F.when(size % 6 == 0, "/p/").otherwise("https://a.ru/"), "p_partkey").alias("url"),
        F.when(size % 15 == 0, "").otherwise("http://i.ru/1.png").alias("image"),
    )
    issues = o.field_issues(
        F.lit("other"), F.col("title"), F.col("price"), F.col("url"), F.col("image")
    )
    return offers.select("p_partkey", F.array_join(issues, "; ").alias("issues"))


@query("canonical_offers", """select p_brand as search_id, 'other' as source, p_partkey as position,
  p_name as title, cast(floor(p_retailprice) as bigint) * 100 as price, 'RUB' as currency,
  0.0::double as relevance_score, 0.65::double as confidence
from part where p_size % 4 <> 0""")
def canonical_offers(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("search_id"),
        F.col("p_partkey").alias("position"),
        F.lit("a.ru").alias("source_domain"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_size") % 4 != 0, F.floor("p_retailprice")).alias("price_rub"),
        F.concat(F.lit("https://a.ru/"), "p_partkey").alias("product_url"),
        F.lit(0.65).alias("confidence"),
    )
    offers = ops.to_offers(part, "other")
    return offers.where(
        ops.has_required(F.col("title"), F.col("price"), F.col("product_url"))
    ).select(
        "search_id", "source", "position", "title", "price", "currency", "relevance_score",
        "confidence",
    )


@query("valid_pages", """select page_id, url from pages
where case when page_id % 11 = 0 then 404 else 200 end < 400 and length(html) >= 200""")
def valid_pages_query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn(
        "status", F.when(F.col("page_id") % 11 == 0, 404).otherwise(200)
    )
    return valid_pages(pages).select("page_id", "url")


@query("page_states", """select page_id, case when contains(lower(html), 'smartcaptcha')
    or (contains(lower(html), '<title>403</title>') and length(html) < 10000) then 'blocked'
    else 'ok' end as card_state,
  case when regexp_extract(html, '<title>([^<]+)</title>', 1) = 'Доступ ограничен'
    or (length(html) < 15000 and contains(lower(html), 'antibot')) then 'blocked'
    when contains(html, '/product/') and contains(html, '₽') then 'ready' else 'pending' end
    as tile_state
from (select page_id, case page_id % 5 when 0 then replace(html, '<nav>', '<p>SmartCaptcha</p>')
    when 1 then regexp_replace(html, '<title>[^<]*</title>', '<title>Доступ ограничен</title>')
    when 2 then '<title>403</title>' || html
    when 3 then replace(html, '<footer>', '<a href="/product/1">5 ₽</a><footer>')
    else replace(html, '<nav>', 'AntiBot') end as html from pages)""")
def page_states(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        F.expr("""case page_id % 5 when 0 then replace(html, '<nav>', '<p>SmartCaptcha</p>')
          when 1 then regexp_replace(html, '<title>[^<]*</title>', '<title>Доступ ограничен</title>')
          when 2 then concat('<title>403</title>', html)
          when 3 then replace(html, '<footer>', '<a href="/product/1">5 ₽</a><footer>')
          else replace(html, '<nav>', 'AntiBot') end""").alias("html"),
    )
    return pages.select(
        "page_id",
        o.card_page_state(F.col("html")).alias("card_state"),
        o.tile_page_state(F.col("html")).alias("tile_state"),
    )


@query("price_units", """select p_partkey, case p_size % 3
  when 0 then case when cast(floor(p_retailprice) as bigint) * (p_size + 1) < 100000
      then cast(floor(p_retailprice) as bigint) * (p_size + 1) * 100
      else cast(floor(p_retailprice) as bigint) * (p_size + 1) end
  when 1 then cast(floor(p_retailprice) as bigint) * 100 else 0 end as kopecks from part""")
def price_units(spark, sf_dir):
    raw = F.expr("""case p_size % 3 when 0 then cast(floor(p_retailprice) * (p_size + 1) as string)
        when 1 then concat('"', floor(p_retailprice), ' ₽"') else '"нет"' end""")
    values = table(spark, sf_dir, "part").select("p_partkey", F.try_parse_json(raw).alias("v"))
    return values.select("p_partkey", p.scale_price(F.col("v")).alias("kopecks"))


@query("sql_functions", f"""select p_partkey, {_WHOLE} as price_rub, p_name || ' ' || lower(p_type) as title_key,
  'shop' || cast(p_size as varchar) || '.ru' as host, true as ru from part""")
def sql_functions(spark, sf_dir):
    from offerloom.functions.sql import register_functions

    register_functions(spark)
    texts = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.floor("p_retailprice"), F.when(F.col("p_size") % 2 == 0, ".50").otherwise(" ₽")).alias("price_text"),
        F.concat("p_name", F.lit(", «"), "p_type", F.lit("»")).alias("title"),
        F.concat(F.lit("https://www.shop"), "p_size", F.lit(".RU/a#b")).alias("url"),
    )
    return texts.selectExpr(
        "p_partkey", "parse_price(price_text) as price_rub", "title_key(title) as title_key",
        "url_host(url) as host", "is_ru_host(url_host(url)) as ru",
    )


@query("tile_enrichment", """with offers as (
  select p_partkey, p_brand, p_size, row_number() over (partition by p_brand, p_size order by p_partkey) as rank from part),
blocks as (select p_brand, p_size, min(rank) as block from offers where rank <= 2 and p_partkey % 7 = 0 group by p_brand, p_size),
joined as (select offers.*, rank <= 2 and p_partkey % 7 <> 0 and p_partkey % 5 <> 0
    and (block is null or rank < block) as applies
  from offers left join blocks using (p_brand, p_size))
select p_partkey, rank,
  case when applies and p_partkey % 3 = 0 then 'Проза ' || cast(p_partkey as varchar)
       when applies and p_partkey % 2 = 0 then 'features' else 'preview' end as description,
  case when applies and p_partkey % 2 = 0 then 'Вес=' || cast(p_size as varchar) else '' end as chars,
  applies and p_partkey % 6 = 0 as both_parts
from joined""")
def tile_enrichment(spark, sf_dir):
    """Stored details reach the first ranks of a search, up to its first blocked page."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    url = F.concat(F.lit("https://shop.ru/product/"), key)
    offers = part.select(
        "p_partkey",
        F.concat_ws("/", "p_brand", "p_size").alias("search_id"),
        url.alias("product_url"),
        F.lit("preview").alias("description"),
        F.create_map().cast("map<string,string>").alias("characteristics"),
    ).withColumn("rank", F.row_number().over(W.partitionBy("search_id").orderBy("p_partkey")).cast("bigint"))
    details = part.where((key % 5 != 0) | (key % 7 == 0)).select(
        url.alias("product_url"),
        F.when(key % 7 == 0, "blocked").otherwise("ok").alias("state"),
        F.when(key % 3 == 0, F.concat(F.lit("Проза "), key)).alias("description"),
        F.when(key % 2 == 0, F.create_map(F.lit("Вес"), F.col("p_size").cast("string"))).alias("characteristics"),
    )
    # The page's text comes first, then the listed characteristics.
    about, chars = F.col("description"), F.array_join(
        F.transform(F.map_entries("characteristics"), lambda e: F.concat_ws("=", e["key"], e["value"])), "|"
    )
    lines = F.split(about, "\n")
    return ops.enrich_tiles(offers, details).select(
        "p_partkey", "rank",
        F.when((chars != "") & ~about.startswith("Проза"), "features").otherwise(lines[0]).alias("description"),
        chars.alias("chars"),
        ((chars != "") & about.startswith("Проза") & (F.size(lines) > 1)).alias("both_parts"),
    )
