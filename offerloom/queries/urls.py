"""URL parts, page kinds, scores and rule lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions import url as u
from offerloom.operators import selection as sel
from offerloom.operators import setops
from offerloom.operators import urls as ops
from offerloom.queries.inputs import PART_LINKS_SQL, page_hits, part_links
from offerloom.queries.registry import query, table
from offerloom.sources.dims import cdn_ranges_dim, domain_rules_dim


def _sql_list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _alternatives(words) -> str:
    return "|".join(w.replace(".", "[.]") for w in words)


def _in_domains(domains) -> str:
    return f"regexp_matches(host, '(^|[.])({_alternatives(domains)})$')"


_NETLOC = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"
# The same rules over the parts of a URL, one step per CTE.
CLASSIFIED_SQL = f"""parts as (
    select *, regexp_replace({_NETLOC}, '^www[.]', '') as host,
           regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path,
           regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) as query_string
    from {{source}}),
segs as (
    select *, list_filter(string_split(lower(path), '/'), lambda s: s <> '') as s from parts),
flags as (
    select *, s[len(s)] as last,
      ({_in_domains(rules.REJECT_HOSTS)}
        or regexp_matches(path || query_string, '(?i){rules.REJECT_PATH}')
        or regexp_matches(url, '(?i){rules.FOREIGN_LOCALE}')) as rejected,
      case when regexp_matches(lower(path), '{rules.PRODUCT_PATH}')
             or regexp_matches(lower(path), '(?i){rules.TIRE_SIZE}') then true
           when len(s) = 0 then false
           when regexp_full_match(s[len(s)], '[0-9]+')
             then not (list_contains(s, 'catalog') and length(s[len(s)]) < 5)
           when list_contains(s, 'product') then true
           when list_contains(s, 'catalog') and len(s) = 2 then
             not (s[2] in ({_sql_list(rules.LISTING_SLUGS)})
                  or replace(s[2], '_', '-') in ({_sql_list(rules.LISTING_SLUGS)})
                  or regexp_matches(s[2], '^({_alternatives(rules.LISTING_PREFIXES)})')
                  or regexp_matches(replace(s[2], '_', '-'), '{rules.MODEL_FAMILY}'))
             and regexp_matches(s[2], '{rules.PRODUCT_SLUG}')
           else false end as product,
      (host like '%.ru' or host like '%.рф') as is_ru,
      host in ({_sql_list(rules.FETCH_BLOCKED_HOSTS)}) as fetch_blocked,
      regexp_matches(host, '{_alternatives(rules.BLACKLIST)}') as blacklisted
    from segs),
listed as (
    select *, not rejected and not product and (
        len(s) = 0 or regexp_matches(lower(path), '{rules.CATALOG_PATH}')
        or len(list_filter(s, lambda x: x in ({_sql_list(rules.LISTING_SLUGS)})
             or replace(x, '_', '-') in ({_sql_list(rules.LISTING_SLUGS)})
             or regexp_matches(x, '^({_alternatives(rules.LISTING_PREFIXES)})')
             or regexp_matches(replace(x, '_', '-'), '{rules.MODEL_FAMILY}'))) > 0) as listing
    from flags),
classified as (
    select *, (case when rejected
        or ((listing or regexp_matches(path, '(?i){rules.CATALOG_PATH}')) and not product)
        then -1.0
      else 0.2 + case when is_ru then 0.35 else 0 end + case when product then 0.4 else 0 end
        - case when length(path) - length(replace(path, '/', '')) <= 3 and not product
               then 0.15 else 0 end
        - case when fetch_blocked then 0.5 else 0 end end)::double as quality
    from listed)"""


def _classified(source: str) -> str:
    return CLASSIFIED_SQL.replace("{source}", source)


@query("url_parts", f"""select page_id, regexp_replace({_NETLOC}, '^www[.]', '') as host,
  regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path,
  regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) as query_string,
  split_part(url, '#', 1) as key1, split_part(split_part(url, '#', 1), '?', 1) as key2,
  rtrim(split_part(split_part(url, '#', 1), '?', 1), '/') as key3
from pages""")
def url_parts(spark, sf_dir):
    pages = ops.url_parts(table(spark, sf_dir, "pages").select("page_id", "url"))
    c = F.col("url")
    return pages.select(
        "page_id", "host", "path", "query_string",
        u.url_key(c, 1).alias("key1"), u.url_key(c, 2).alias("key2"), u.url_key(c, 3).alias("key3"),
    )


_FLAGS = "rejected, product, listing, is_ru, fetch_blocked, blacklisted"


@query("url_listing_flags", f"""with {PART_LINKS_SQL}, {_classified('part_links')}
select search_id, position, {_FLAGS} from classified""")
def url_listing_flags(spark, sf_dir):
    return ops.classify_urls(part_links(spark, sf_dir)).select(
        "search_id", "position", *_FLAGS.split(", ")
    )


@query("url_page_flags", f"""with {_classified('pages')}
select page_id, {_FLAGS}, cast(round(quality * 100) as bigint) as quality_pct from classified""")
def url_page_flags(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return ops.classify_urls(pages).select(
        "page_id", *_FLAGS.split(", "),
        F.round(F.col("quality") * 100).cast("bigint").alias("quality_pct"),
    )


@query("url_quality", f"""with {PART_LINKS_SQL}, {_classified('part_links')}
select search_id, position, round(quality, 4) as quality,
  (case when len(s) >= 3 then 0.12 when len(s) <= 1 then -0.08 else 0.0 end)::double as depth_bonus
from classified""")
def url_quality(spark, sf_dir):
    return ops.classify_urls(part_links(spark, sf_dir)).select(
        "search_id", "position", F.round("quality", 4).alias("quality"), "depth_bonus"
    )


_GRID = f"""grid0 as (
    select *, rtrim(lower(path), '/') as gp,
      list_filter(string_split(rtrim(lower(path), '/'), '/'), lambda x: x <> '') as gs
    from classified),
grid as (
    select *, not rejected and not product and (
        len(gs) = 0 or (list_contains(gs, 'catalog') and len(gs) <= 4)
        or len(list_filter(gs, lambda x: x in ({_sql_list(rules.GRID_SLUGS)}))) > 0
        or regexp_matches(gp, '{_alternatives(rules.GRID_PATH_TOKENS)}')
        or (len(gs) <= 2 and not regexp_full_match(gs[len(gs)], '[0-9]+'))) as is_grid,
      (case when contains(gp, '/catalog/') then 1.0 else 0 end
      + case when regexp_matches(gp, '{_alternatives(rules.GRID_PRIORITY_HINTS)}')
             then 0.6 else 0 end
      + case when len(gs) >= 3 then 0.2 else 0 end
      + case when {_in_domains(['dns-shop.ru'])} then 0.3
             when {_in_domains(['technocity.ru'])} then 1.0
             when contains(host, 'e2e4online.ru') then 1.0
             when {_in_domains(['citilink.ru'])} then 0.6
             when contains(host, 'technopark.ru') or host = 'mvideo.ru' then 0.4 else 0 end
      + case when regexp_matches(gp, '{_alternatives(rules.GRID_MOUSE_TOKENS)}')
             then 0.7 else 0 end
      - case when contains(gp, 'proizvoditel--') then 0.4 else 0 end
      - case when regexp_matches(host, 'beeline[.]ru|blizko[.]ru') then 0.6 else 0 end
      - case when gp = '' then 0.3 else 0 end)::double as grid_priority,
      case when {_in_domains(['e2e4online.ru'])} then 'e2e4online.ru' else host end
        as listing_key
    from grid0)"""


@query("url_grid", f"""with {PART_LINKS_SQL}, {_classified('part_links')}, {_GRID}
select search_id, position, is_grid, round(grid_priority, 4) as grid_priority, listing_key
from grid""")
def url_grid(spark, sf_dir):
    return ops.classify_urls(part_links(spark, sf_dir)).select(
        "search_id", "position", "is_grid", F.round("grid_priority", 4).alias("grid_priority"),
        "listing_key",
    )


@query("best_listing_per_domain", f"""with {PART_LINKS_SQL}, {_classified('part_links')}, {_GRID}
select search_id, listing_key, position, round(grid_priority, 4) as grid_priority
from grid where is_grid
qualify row_number() over (partition by search_id, listing_key
          order by round(grid_priority, 4) desc, position) = 1""")
def best_listing_per_domain(spark, sf_dir):
    classified = ops.classify_urls(part_links(spark, sf_dir)).withColumn(
        "grid_priority", F.round("grid_priority", 4)
    )
    return sel.best_listing_per_domain(classified).select(
        "search_id", "listing_key", "position", "grid_priority"
    )


_RULE_CASE = " ".join(
    f"when {_in_domains(domains)} then '{name}'" for name, domains, *_ in rules.DOMAIN_RULES
)


@query("domain_rules", f"""with {PART_LINKS_SQL}, {_classified('part_links')}
select search_id, position, case {_RULE_CASE} end as rule,
  case when {_in_domains(['e2e4online.ru'])} then 'e2e4online.ru' else host end as listing_key
from classified""")
def domain_rules(spark, sf_dir):
    links = ops.url_parts(part_links(spark, sf_dir))
    return ops.attach_domain_rules(links, domain_rules_dim(spark)).select(
        "search_id", "position", "rule", "listing_key"
    )


_POOL = """u as (
    select *, greatest(quality, 0.0) as score,
      case when quality >= 0 and is_ru then 0 when quality >= 0 then 1
           when is_ru then 2 else 3 end as tier from classified where not rejected),
pool as (select * from u qualify tier = min(tier) over (partition by search_id))"""


@query("filter_and_sort", f"""with {PART_LINKS_SQL}, {_classified('part_links')}, {_POOL}
select search_id, position, tier, round(score, 4) as score,
  row_number() over (partition by search_id order by round(score, 4) desc, position) as rank
from pool qualify rank <= 32""")
def filter_and_sort(spark, sf_dir):
    candidates = ops.classify_urls(part_links(spark, sf_dir)).withColumn(
        "quality", F.round("quality", 4)
    )
    ranked = setops.filter_and_sort(candidates, rules.RANK_POOL)
    tier = (
        F.when((F.col("quality") >= 0) & F.col("is_ru"), 0).when(F.col("quality") >= 0, 1)
        .when(F.col("is_ru"), 2).otherwise(3)
    )
    return ranked.select(
        "search_id", "position", tier.alias("tier"), F.round("_score", 4).alias("score"), "rank"
    )


@query("rank_pool", f"""with {_classified('pages')}
select split_part(host, '.', -1) as search_id, page_id as position, round(quality, 4) as quality
from classified
qualify row_number() over (partition by split_part(host, '.', -1)
          order by round(quality, 4) desc, page_id) <= 32""")
def rank_pool(spark, sf_dir):
    pages = ops.classify_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    candidates = pages.select(
        F.substring_index("host", ".", -1).alias("search_id"),
        F.col("page_id").alias("position"),
        F.round("quality", 4).alias("quality"),
    )
    return sel.rank_pool(candidates)


@query("select_candidates", f"""with {PART_LINKS_SQL}, {_classified('part_links')}, {_POOL},
both_parts as (
    select search_id, position, url, 0 as part, round(score, 4) as score from pool
    where quality >= 0
    union all select search_id, position, url, 1, 0 from classified where listing),
d as (select *, split_part(url, '#', 1) as url_key from both_parts
      qualify row_number() over (partition by search_id, split_part(url, '#', 1)
                order by part, score desc, position) = 1)
select search_id, position, url_key,
  row_number() over (partition by search_id order by part, score desc, position) as rank
from d qualify rank <= 45""")
def select_candidates(spark, sf_dir):
    candidates = ops.classify_urls(part_links(spark, sf_dir)).withColumn(
        "quality", F.round("quality", 4)
    )
    return setops.select_candidates(candidates).select(
        "search_id", "position", "url_key", "rank"
    )


@query("final_offers", f"""with {PART_LINKS_SQL}, {_classified('part_links')}
select search_id, position, title, url as product_url from classified
where not listing and not (not product and list_contains(s, 'catalog') and len(s) <= 4)
  and not (not product and coalesce(last in ('iphone-15', 'iphone-16', 'smartfony'), false))""")
def final_offers(spark, sf_dir):
    offers = part_links(spark, sf_dir).select(
        "search_id", "position", "title", F.col("url").alias("product_url")
    )
    return ops.final_offers(offers)


@query("blended_rank", f"""with {PART_LINKS_SQL}, {_classified('part_links')},
q as (select search_id, min_by(title, position) as query from part_links group by search_id),
sim as (
    select classified.*, query,
      list_filter(string_split(lower(query), ' '), lambda t: length(t) > 2) as tokens,
      lower(title || ' ' || snippet) as hay from classified join q using (search_id)),
scored as (
    select *, len(list_filter(tokens, lambda t: contains(hay, t)
          or (greatest(3, length(t) - 1) >= 4 and length(t) >= 4
              and contains(hay, t[1:greatest(3, length(t) - 1)])))) / len(tokens) as similarity
    from sim),
passed as (
    select *, round(similarity + greatest(quality, 0) * 0.15
      + case when len(s) >= 3 then 0.12 when len(s) <= 1 then -0.08 else 0.0 end, 6) as score
    from scored where similarity >= 0.45),
d as (select *, row_number() over (partition by search_id, host
        order by score desc, position) as dn from passed),
p as (select * from d where dn <= 2
      qualify row_number() over (partition by search_id order by score desc, position) <= 32),
f as (select * from d where not exists (select 1 from p where p.search_id = d.search_id
        and p.url = d.url)
      qualify row_number() over (partition by search_id, url order by score desc, position) = 1),
b as (select *, 0 as tier from p union all select *, 1 from f)
select search_id, position, host, score,
  row_number() over (partition by search_id order by tier, score desc, position) as rank
from b qualify rank <= 32""")
def blended_rank(spark, sf_dir):
    links = ops.classify_urls(part_links(spark, sf_dir))
    queries = links.groupBy("search_id").agg(F.min_by("title", "position").alias("query"))
    scored = links.join(queries, "search_id")
    ranked = sel.blended_rank(scored)
    return ranked.select("search_id", "position", "host", F.round("score", 6).alias("score"), "rank")


@query("market_products", """with l as (
  select p_partkey, case when p_size % 3 = 0 then 'https://www.ozon.ru/product/'
      || replace(p_name, ' ', '-') || '-' || cast(p_partkey as varchar) || '/'
    when p_size % 3 = 1 then 'https://ozon.ru/product/shina-' || cast(p_size as varchar)
      || '-' || cast(p_partkey as varchar)
    else 'https://shop.ru/product/' || cast(p_partkey as varchar) end as url from part)
select p_partkey, nullif(regexp_extract(url, '^https://(?:www[.])?ozon[.]ru/product/(.+)-([0-9]+)/?$', 1), '') as slug,
  nullif(regexp_extract(url, '^https://(?:www[.])?ozon[.]ru/product/(.+)-([0-9]+)/?$', 2), '') as numeric_id,
  case when regexp_matches(url, 'ozon[.]ru/product/shina-') then 'tires' end as category
from l""")
def market_products(spark, sf_dir):
    from offerloom.functions.query import classify_slug

    links = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.expr("""case when p_size % 3 = 0 then concat('https://www.ozon.ru/product/',
            replace(p_name, ' ', '-'), '-', p_partkey, '/')
          when p_size % 3 = 1 then concat('https://ozon.ru/product/shina-', p_size, '-', p_partkey)
          else concat('https://shop.ru/product/', p_partkey) end""").alias("url"),
    )
    parsed = links.select("p_partkey", u.market_product(F.col("url")).alias("m"))
    return parsed.select(
        "p_partkey", "m.slug", "m.numeric_id", classify_slug(F.col("m.slug")).alias("category")
    )


_CDN_CASE = " ".join(f"when v <= {hi} then {host}" for hi, host in rules.CDN_RANGES)


@query("cdn_images", f"""with a as (
  select p_partkey, p_partkey * 987654 + p_size as article from part),
b as (select *, article // 100000 as v from a)
select p_partkey, article, least(50, greatest(1, case {_CDN_CASE} else 51 end)) as cdn_host,
  printf('https://basket-%02d.wbbasket.ru/vol%d/part%d/%d/images/big/1.webp',
    least(50, greatest(1, case {_CDN_CASE} else 51 end)), v, article // 1000, article) as image_url
from b""")
def cdn_images(spark, sf_dir):
    articles = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_partkey") * 987654 + F.col("p_size")).alias("article")
    )
    return ops.cdn_images(articles, cdn_ranges_dim(spark))


@query("image_hosts", """with i as (
  select p_partkey, case p_size % 5
      when 0 then 'https://avatars.mds.yandex.net/get-mpic/' || cast(p_partkey as varchar) || '/img_id' || cast(p_size as varchar) || '/50x50'
      when 1 then 'https://cdn.shop' || cast(p_size as varchar) || '.ru/a.jpg'
      when 2 then 'https://basket-01.wbbasket.ru/vol1/1.webp'
      when 3 then 'https://evil.example.com/wb.ru/1.png' else '' end as image,
    'www.shop' || cast(p_size as varchar) || '.ru' as shop from part)
select p_partkey, case when p_size_is_thumb then regexp_replace(image, '/[^/]+$', '/orig')
    else image end as image,
  (image_host = replace(shop, 'www.', '') or image_host like '%.' || replace(shop, 'www.', '')
   or image_host = 'avatars.mds.yandex.net' or image_host like '%.wbbasket.ru') as allowed
from (select *, contains(image, 'get-mpic') as p_size_is_thumb,
        regexp_extract(image, '^https://([^/]*)', 1) as image_host from i)""")
def image_hosts(spark, sf_dir):
    images = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.expr("""case p_size % 5
          when 0 then concat('https://avatars.mds.yandex.net/get-mpic/', p_partkey, '/img_id', p_size, '/50x50')
          when 1 then concat('https://cdn.shop', p_size, '.ru/a.jpg')
          when 2 then 'https://basket-01.wbbasket.ru/vol1/1.webp'
          when 3 then 'https://evil.example.com/wb.ru/1.png' else '' end""").alias("image"),
        F.concat(F.lit("www.shop"), F.col("p_size"), F.lit(".ru")).alias("shop"),
    )
    return images.select(
        "p_partkey",
        u.original_image(F.col("image")).alias("image"),
        u.image_allowed(F.col("image"), F.col("shop")).alias("allowed"),
    )


@query("slug_titles", """select page_id,
  translate(regexp_extract(url, '^[a-z]+://[^/?#]*(?:/[^/?#]*)*/([^/?#]*)', 1), '-_', '  ') as title
from pages""")
def slug_titles(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", u.slug_title(u.path(F.col("url"))).alias("title"))


@query("page_hits_by_title", """select page_id, url,
  regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages""")
def page_hits_by_title(spark, sf_dir):
    return page_hits(spark, sf_dir).select(F.col("position").alias("page_id"), "url", "title")
