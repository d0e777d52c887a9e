"""Query normalisation, relevance, similarity, index and sitemap search."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions import query as q
from offerloom.functions.similarity import token_overlap
from offerloom.operators import neardup, searching
from offerloom.operators import selection as sel
from offerloom.queries.inputs import PAGE_HITS_SQL, PART_LINKS_SQL, part_links
from offerloom.queries.registry import query, spread, table

# Every part is a search of its own; brands and sizes give regions and word mixes.
_QUERY_TEXT = """case p_size % 8
    when 0 then '  ' || p_name || ' ' when 1 then 'iphone ' || cast(p_size as varchar) || ' se'
    when 2 then 'ноут ' || p_name when 3 then 'айфон ' || cast(p_size as varchar)
    when 4 then 'Шины ' || p_name || ' купить' when 5 then 'очки ' || p_name
    when 6 then 'НОУТ' else 'the ' || p_name || ' ' || cast(p_size as varchar) end"""
_REGION = """case p_size % 5 when 0 then ' SPB ' when 1 then 'kazan' when 2 then 'paris'
    when 3 then 'novosibirsk' else 'moscow' end"""
SEARCHES_SQL = f"""searches as (
    select p_partkey as search_id, {_QUERY_TEXT} as query, {_REGION} as region from part)"""


def searches(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return spread(part, "p_partkey").select(
        F.col("p_partkey").alias("search_id"),
        F.expr(_QUERY_TEXT.replace("varchar", "string")).alias("query"),
        F.expr(_REGION).alias("region"),
    )


_EXPANSIONS = " ".join(f"when '{k}' then '{v}'" for k, v in rules.QUERY_EXPANSIONS.items())
_REGION_CASE = " ".join(f"when '{r[0]}' then '{r[1]}'" for r in rules.REGIONS)
_KNOWN = ", ".join(f"'{r[0]}'" for r in rules.REGIONS)


@query("normalise_queries", f"""with {SEARCHES_SQL},
n as (select search_id, trim(query) as original,
        case when lower(trim(region)) in ({_KNOWN}) then lower(trim(region)) else 'moscow' end
          as region_id from searches)
select search_id, original, coalesce(case lower(original) {_EXPANSIONS} end, original)
         as corrected, region_id, case region_id {_REGION_CASE} end as region_name,
  'ym:search:' || region_id || ':' || lower(original) as snapshot_key,
  case when region_id <> 'moscow' then original || ' ' || case region_id {_REGION_CASE} end
       else original end as geo
from n""")
def normalise_queries(spark, sf_dir):
    done = searching.normalise_queries(searches(spark, sf_dir))
    return done.select(
        "search_id", "original", "corrected", "region_id", "region_name",
        q.snapshot_key(F.col("region_id"), F.col("original"), "ym:search").alias("snapshot_key"),
        q.geo_query(F.col("original"), F.col("region_id"), F.col("region_name")).alias("geo"),
    )


_VARIANTS = f"""v0 as (
    select search_id, trim(query) as o, lower(trim(query)) as l,
      case when regexp_matches(lower(trim(query)), 'айфон')
        then replace(replace(trim(query), 'айфон', 'iphone'), 'Айфон', 'iPhone') end as lat
    from searches),
v1 as (
    select search_id, o, [o,
      case when regexp_matches(l, '^iphone[ ]+[0-9]+[ ]+se') then
        regexp_replace(o, '(iphone)[ ]+[0-9]+[ ]+(se.*)', '\\1 \\2', 'i') end,
      lat, case when not contains(l, 'apple') then 'Apple ' || lat end,
      case when contains(l, 'айфон') or (regexp_matches(l, 'iphone[ ]+[0-9]{{1,2}}($|[^0-9a-z])')
        and not contains(l, ' se')) then o || ' купить' end,
      case when lat is not null then lat || ' купить' end,
      case when contains(l, 'очк') then o || ' купить' end,
      case when contains(l, 'очк') then 'оправы для очков' end,
      o || ' купить', o || ' цена', o || ' интернет-магазин'] as arr from v0),
v2 as (select search_id, unnest(arr) as variant, generate_subscripts(arr, 1) as i from v1),
v3 as (select * from v2 where variant is not null
       qualify row_number() over (partition by search_id, lower(variant) order by i) = 1)"""


@query("query_variants", f"""with {SEARCHES_SQL}, {_VARIANTS}
select search_id, cast(row_number() over (partition by search_id order by i) - 1 as integer)
         as variant_ord, variant from v3""")
def query_variants(spark, sf_dir):
    return searching.explode_variants(searches(spark, sf_dir))


_STOP = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)


@query("query_tokens", f"""with {SEARCHES_SQL}
select search_id, array_to_string(list_filter(string_split(lower(trim(query)), ' '),
  lambda t: length(t) >= 2 and t not in ({_STOP})), '|') as tokens,
  array_to_string(list_transform(list_filter(string_split(lower(trim(query)), ' '),
    lambda t: length(t) >= 2 and t not in ({_STOP})), lambda t:
      case when regexp_full_match(t, '[0-9]+') then t
           else t[1:greatest(3, length(t) - 1)] end), '|') as stems
from searches""")
def query_tokens(spark, sf_dir):
    tokens = q.query_tokens(F.trim("query"))
    return searches(spark, sf_dir).select(
        "search_id",
        F.array_join(tokens, "|").alias("tokens"),
        F.array_join(F.transform(tokens, q.stem), "|").alias("stems"),
    )


def _overlap_sql(query_text: str, hay: str) -> str:
    toks = f"list_filter(string_split(lower({query_text}), ' '), lambda t: length(t) > 2)"
    return f"""(case when len({toks}) = 0 then 0 else len(list_filter({toks}, lambda t:
      contains({hay}, t) or (greatest(3, length(t) - 1) >= 4
        and contains({hay}, t[1:greatest(3, length(t) - 1)]))))::double / len({toks}) end)"""


_PROTO = {k: _overlap_sql("query", f"'{v}'") for k, v in rules.CATEGORY_PROTOTYPES.items()}


@query("classify_query", f"""with {SEARCHES_SQL},
s as (select search_id, query, {_PROTO['orgtech']} as a, {_PROTO['tires']} as b,
        {_PROTO['clothes']} as c from searches)
select search_id, case when trim(query) = '' then 'unknown'
    when regexp_matches(lower(query), '{'|'.join(rules.CATEGORY_HINTS[0][1])}') then 'tires'
    when regexp_matches(lower(query), '{'|'.join(rules.CATEGORY_HINTS[1][1])}') then 'orgtech'
    when greatest(a, b, c) < 0.35 then 'unknown' when a >= b and a >= c then 'orgtech'
    when b >= c then 'tires' else 'clothes' end as category from s""")
def classify_query(spark, sf_dir):
    return searches(spark, sf_dir).select(
        "search_id", q.classify_query(F.col("query")).alias("category")
    )


@query("seed_candidates", f"""with {SEARCHES_SQL},
i as (select search_id, query, regexp_extract(lower(query), '(?:айфон|iphone)[ ]*([0-9]{{1,2}})', 1)
        as n from searches),
u as (select search_id, n, query, unnest(case when n <> '' then [
        'https://cmstore.ru/catalog/smartfony/apple_iphone/iphone_' || n || '/',
        'https://re-store.ru/smartfony/apple/iphone-' || n || '/',
        'https://shop.mts.ru/catalog/smartfony/apple/iphone-' || n || '/',
        'https://biggeek.ru/catalog/apple-iphone-' || n]
      when contains(lower(query), 'очк') then ['https://www.letu.ru/browse/optika/ochki',
        'https://www.optic-city.ru/ochki_s_dioptrijami/', 'https://ochkarik.ru/catalog/ochki/',
        'https://ochkarik.ru/catalog/solntsezashchitnye_ochki/'] else [] end) as url from i)
select search_id, url, query as title,
  regexp_replace(regexp_extract(url, '^https://([^/]*)', 1), '^www[.]', '') as domain from u""")
def seed_candidates(spark, sf_dir):
    return searching.seed_candidates(searches(spark, sf_dir)).select(
        "search_id", "url", "title", "domain"
    )


@query("attempts", f"""with {SEARCHES_SQL},
n as (select search_id, trim(query) as o,
        coalesce(case lower(trim(query)) {_EXPANSIONS} end, trim(query)) as c from searches)
select search_id, 0 as attempt, o as text from n
union all select search_id, 1, c from n where c <> o""")
def attempts(spark, sf_dir):
    return searching.explode_attempts(searching.normalise_queries(searches(spark, sf_dir)))


_BRAND_QUERY = """bq as (
    select p_brand as search_id, min_by(p_name, p_partkey) as query from part group by p_brand),
offers as (select p_brand as search_id, p_partkey as position,
             p_name || ' ' || cast(p_size as varchar) as title from part)"""


def _brand_queries(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("search_id")).agg(
        F.min_by("p_name", "p_partkey").alias("query")
    )


def _brand_offers(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("search_id"),
        F.col("p_partkey").alias("position"),
        F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("title"),
    )


_STEM = """case when regexp_full_match(t, '[0-9]+') then t
    else t[1:greatest(3, length(t) - 1)] end"""


@query("title_relevance", f"""with {_BRAND_QUERY},
n as (select search_id, list_transform(list_filter(string_split(query, ' '),
        lambda t: length(t) > 2), lambda t: {_STEM}) as words from bq)
select o.search_id, position, title from offers o join n using (search_id)
where len(words) = 0 or len(list_filter(words, lambda w: contains(lower(title), w))) > 0""")
def title_relevance(spark, sf_dir):
    return searching.relevant_offers(_brand_offers(spark, sf_dir), _brand_queries(spark, sf_dir))


@query("accessory_labels", f"""with {_BRAND_QUERY},
n as (select search_id, list_filter(string_split(query, ' '),
        lambda t: length(t) >= 2 and t not in ({_STOP})) as tokens from bq),
m as (select o.search_id, position, title, len(tokens) = 0 or len(list_filter(tokens, lambda t:
        contains(lower(title), t) or (length(t) >= 3 and contains(lower(title), t[1:3])))) > 0
          as matches from offers o join n using (search_id))
select search_id, position, title, matches, not matches as accessory from m""")
def accessory_labels(spark, sf_dir):
    return searching.label_accessories(
        _brand_offers(spark, sf_dir), _brand_queries(spark, sf_dir)
    )


@query("token_overlap_rank", f"""with {_BRAND_QUERY},
s as (select o.search_id, position, title,
        round({_overlap_sql('query', 'lower(title)')}, 6) as similarity
      from offers o join bq using (search_id))
select search_id, position, similarity,
  row_number() over (partition by search_id order by similarity desc, position) as rank
from s qualify rank <= 20""")
def token_overlap_rank(spark, sf_dir):
    from offerloom.operators.ranking import top_n

    joined = _brand_offers(spark, sf_dir).join(_brand_queries(spark, sf_dir), "search_id")
    scored = joined.withColumn(
        "similarity", F.round(token_overlap(F.col("query"), F.col("title")), 6)
    )
    return top_n(
        scored, ["search_id"], [F.desc("similarity"), F.asc("position")], 20, "rank"
    ).select("search_id", "position", "similarity", "rank")


@query("semantic_top_k", """with qv as (
  select label, min_by(embedding, vec_id) as qe from embeddings group by label),
s as (select label as search_id, vec_id as position,
        list_dot_product(embedding::double[], qe::double[]) as similarity
      from embeddings join qv using (label)),
r as (select *, count(*) over (partition by search_id) as n,
        row_number() over (partition by search_id order by similarity desc, position) as rank
      from s)
select search_id, position, case when n > 20 then round(similarity, 4) end as similarity,
  case when n > 20 then rank
       else row_number() over (partition by search_id order by position) end as rank
from r where rank <= 20""")
def semantic_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    offers = vectors.select(
        F.col("label").alias("search_id"), F.col("vec_id").alias("position"), "embedding"
    )
    queries = vectors.groupBy(F.col("label").alias("search_id")).agg(
        F.min_by("embedding", "vec_id").alias("query_embedding")
    )
    return sel.semantic_top_k(offers, queries, 20).select(
        "search_id", "position", F.round("similarity", 4).alias("similarity"), "rank"
    )


@query("index_search", """with qs as (
  select doc_id as search_id, source || ' ' || lang as query from documents),
qw as (select distinct search_id, unnest(string_split(lower(query), ' ')) as word from qs),
iw as (select distinct p_partkey as id, unnest(string_split(lower(p_name || ' src'
         || cast(p_size % 20 as varchar) || ' ' || case p_size % 4 when 0 then 'en' when 1 then 'de'
         when 2 then 'fr' else 'es' end), ' ')) as word from part),
s as (select search_id, id, count(*) as score from qw join iw using (word) group by all)
select search_id, id, score,
  row_number() over (partition by search_id order by score desc, id) as rank
from s qualify rank <= 10""")
def index_search(spark, sf_dir):
    searches_df = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("search_id"), F.concat_ws(" ", "source", "lang").alias("query")
    )
    index = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.array(
            F.concat(F.lit("src"), (F.col("p_size") % 20).cast("string")),
            F.expr("case p_size % 4 when 0 then 'en' when 1 then 'de' when 2 then 'fr' else 'es' end"),
        ).alias("keywords"),
    )
    return searching.index_search(searches_df, index, 10, ("title", "keywords"))


@query("sitemap_hits", f"""with {PART_LINKS_SQL},
sm as (select lower(regexp_replace(regexp_extract(url, '^https?://([^/]*)', 1), '^www[.]', ''))
         as domain, position, url as loc from part_links),
d as (select distinct domain, dense_rank() over (order by domain) as domain_ord from sm),
ok as (select sm.*, domain_ord, split_part(loc, '#', 1) as url_key from sm join d using (domain)
  where not regexp_matches(domain, '{'|'.join(w.replace('.', '[.]') for w in rules.BLACKLIST)}')
    and regexp_matches(loc, '(?i){rules.SITEMAP_PRODUCT}')
  qualify row_number() over (partition by split_part(loc, '#', 1)
            order by domain_ord, position) = 1),
qs as (select c_custkey as search_id, case c_nationkey % 3 when 0 then 'bolt' when 1 then 'gear shop1'
         else 'blue ring' end as query from customer),
qw as (select search_id, unnest(string_split(query, ' ')) as token from qs),
m as (select distinct search_id, domain, domain_ord, position, loc from qw
      join ok on contains(lower(loc), token)),
pd as (select * from m qualify row_number() over (partition by search_id, domain
         order by domain_ord, position) <= 20)
select search_id, loc as url, domain,
  row_number() over (partition by search_id order by domain_ord, position) as rank
from pd qualify rank <= 20""")
def sitemap_hits(spark, sf_dir):
    from offerloom.functions import url as u

    links = part_links(spark, sf_dir).select(
        u.host(F.col("url")).alias("domain"), "position", F.col("url").alias("loc")
    )
    queries = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("search_id"),
        F.expr("case c_nationkey % 3 when 0 then 'bolt' when 1 then 'gear shop1' else 'blue ring' end").alias("query"),
    )
    # shops in the order of their names
    ordered = links.withColumn("domain_ord", F.col("domain"))
    return searching.sitemap_hits(queries, ordered).drop("title")


@query("near_dup_titles", f"""with {PAGE_HITS_SQL},
t as (select search_id, position, md5(title) as title from page_hits
      qualify row_number() over (partition by search_id, title order by position) = 1)
select search_id, position, title, row_number() over (partition by search_id order by position) as rank
from t qualify rank <= 15""")
def near_dup_titles(spark, sf_dir):
    """First 15 mutually dissimilar titles per page language.

    Digests stand for the titles: equal ones are copies and others are far apart, which SQL can
    state. The ratio of similar titles is compared with brute force in the tests.
    """
    from offerloom.queries.inputs import page_hits

    digest = F.md5("title")
    hits = page_hits(spark, sf_dir).select(
        "search_id",
        "position",
        digest.alias("title"),
        F.concat(F.lit("https://a.ru/"), digest).alias("product_url"),
    )
    return neardup.near_duplicate_survivors(hits).select("search_id", "position", "title", "rank")


@query("exact_title_copies", """with t as (
  select p_brand as search_id, p_partkey as position,
         trim(regexp_replace(lower(p_name), '[^a-z0-9 ]', ' ', 'g')) as title_key from part)
select * from t
qualify row_number() over (partition by search_id, title_key order by position) = 1""")
def exact_title_copies(spark, sf_dir):
    from offerloom.functions.text import title_key
    from offerloom.operators.setops import distinct_first

    titles = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("search_id"),
        F.col("p_partkey").alias("position"),
        title_key(F.col("p_name")).alias("title_key"),
    )
    return distinct_first(titles, ["search_id", "title_key"], [F.asc("position")])


@query("expanded_hits", f"""with {SEARCHES_SQL}, {_VARIANTS},
v as (select search_id, row_number() over (partition by search_id order by i) - 1 as variant_ord,
        variant from v3),
h0 as (select p_partkey, trim({_QUERY_TEXT}) as t, p_size from part),
hits as (select distinct t as text, 'https://a.ru/' || cast(p_size as varchar) as url,
           p_size as rank from h0
         union all select distinct t || ' цена', 'https://a.ru/' || cast(p_size as varchar) || '#x',
           p_size from h0
         union all select distinct t || ' купить', 'https://b.ru/' || cast(p_size as varchar),
           p_size from h0)
select search_id, split_part(url, '#', 1) as url_key, cast(variant_ord as integer) as variant_ord,
  rank
from v join hits on hits.text = v.variant
qualify row_number() over (partition by search_id, split_part(url, '#', 1)
          order by variant_ord, rank) = 1""")
def expanded_hits(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.trim(F.expr(_QUERY_TEXT.replace("varchar", "string"))).alias("text"),
        F.col("p_size").cast("string").alias("n"),
        F.col("p_size").alias("rank"),
    )

    def hits(suffix, host, tail):
        return part.select(
            F.concat("text", F.lit(suffix)).alias("text"),
            F.concat(F.lit(f"https://{host}/"), "n", F.lit(tail)).alias("url"),
            "rank",
        ).distinct()

    stored = searching.merge_hits(
        hits("", "a.ru", ""), hits(" цена", "a.ru", "#x"), hits(" купить", "b.ru", "")
    )
    return searching.expanded_hits(searches(spark, sf_dir), stored).select(
        "search_id", "url_key", "variant_ord", "rank"
    )
