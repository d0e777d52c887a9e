"""Snapshots, index maintenance and link harvest."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.operators import harvest as hv
from offerloom.operators import offer_index, snapshots
from offerloom.operators.settling import run_folder
from offerloom.queries.registry import query, table

# Events as snapshots and lookups: purchases and views are stored answers, signups misses,
# clicks ask for their user's key.
_SNAPS = """snaps as (
    select 'u' || cast(user_id as varchar) as key, case event_type when 'signup' then 'miss' else 'hit' end
             as kind, ts as written_at, case when event_id % 2 = 0 then 21600 else 3600 end as ttl_s,
           cast(event_id as varchar) as payload
    from events where event_type in ('purchase', 'signup')),
asks as (select event_id as lookup_id, 'u' || cast(user_id as varchar) as key, ts as asked_at
         from events where event_type in ('click', 'view'))"""


def _snaps(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    stored = events.where(F.col("event_type").isin("purchase", "signup")).select(
        key.alias("key"),
        F.when(F.col("event_type") == "signup", "miss").otherwise("hit").alias("kind"),
        F.col("ts").alias("written_at"),
        F.when(F.col("event_id") % 2 == 0, 21600).otherwise(3600).cast("bigint").alias("ttl_s"),
        F.col("event_id").cast("string").alias("payload"),
    )
    asks = events.where(F.col("event_type").isin("click", "view")).select(
        F.col("event_id").alias("lookup_id"), key.alias("key"), F.col("ts").alias("at")
    )
    return asks, stored


@query("fresh_snapshots", f"""with {_SNAPS},
l as (select lookup_id, kind, payload, asked_at < written_at + ttl_s * interval 1 second as ok
      from asks join snaps using (key) where asked_at >= written_at
      qualify row_number() over (partition by lookup_id, kind order by written_at desc) = 1),
j as (select * from l where ok qualify row_number() over (partition by lookup_id order by kind) = 1)
select lookup_id, key, kind, payload from asks left join j using (lookup_id)""")
def fresh_snapshots(spark, sf_dir):
    asks, stored = _snaps(spark, sf_dir)
    return snapshots.fresh(asks, stored).select("lookup_id", "key", "kind", "payload")


@query("served_lookups", f"""with {_SNAPS},
l as (select lookup_id, payload, asked_at < written_at + ttl_s * interval 1 second as ok
      from asks join snaps using (key) where kind = 'hit' and asked_at >= written_at
      qualify row_number() over (partition by lookup_id order by written_at desc) = 1),
j as (select lookup_id, key, payload, coalesce(ok, false) as ok from asks left join l using (lookup_id))
select lookup_id, key, case when ok then 'snapshot' when lookup_id % 3 > 0 then 'live'
    when payload is not null then 'stale' else 'none' end as origin,
  case when ok then payload when lookup_id % 3 > 0 then 'live' || cast(lookup_id as varchar)
    else payload end as payload
from j""")
def served_lookups(spark, sf_dir):
    asks, stored = _snaps(spark, sf_dir)
    live = asks.select(
        "lookup_id", (F.col("lookup_id") % 3 > 0).alias("ok"),
        F.concat(F.lit("live"), F.col("lookup_id")).alias("payload"),
    )
    return snapshots.served(asks, stored, live)


@query("snapshot_rows", """with g as (
  select o_custkey as search_id, list(o_orderkey order by o_orderkey) filter (o_orderstatus = 'F') as products
  from orders group by o_custkey)
select 'wb:search:' || cast(search_id as varchar) as key, 'hit' as kind, cast(21600 as bigint) as ttl_s,
  '[' || array_to_string(products, ',') || ']' as payload, 'stored' as state
from g where len(products) > 0
union all
select 'wb:search:' || cast(search_id as varchar), 'miss', 3600, null, 'empty' from g
where products is null or len(products) = 0""")
def snapshot_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    # a customer's orders stand for one answer of a source
    results = orders.groupBy(F.col("o_custkey").alias("search_id")).agg(
        F.array_sort(
            F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))
        ).alias("products")
    )
    key = F.concat(F.lit("wb:search:"), F.col("search_id"))
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    stored = snapshots.result_snapshots(results, key, now).withColumn("state", F.lit("stored"))
    empty = snapshots.negative_snapshots(
        results.where(F.size("products") == 0), key, now
    ).withColumn("state", F.lit("empty"))
    return stored.unionByName(empty).select("key", "kind", "ttl_s", "payload", "state")


@query("meta_ttl", """select 'og:' || cast(p_partkey as varchar) as key,
  case when p_size % 5 = 0 then 300 else 3600 end as ttl_s from part""")
def meta_ttl(spark, sf_dir):
    offers = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size") % 5 == 0).alias("incomplete")
    )
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return snapshots.meta_snapshots(
        offers, F.concat(F.lit("og:"), F.col("p_partkey")), now
    ).select("key", "ttl_s")


@query("not_blocked", """with b as (
  select user_id, max(epoch(ts)) filter (event_type = 'error') as last_error from events group by user_id)
select user_id as key from b
where last_error is null or last_error + 3600 <= (select epoch(max(ts)) from events)""")
def not_blocked(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    blocked = events.where("event_type = 'error'").select(
        F.col("user_id").alias("key"), F.lit("blocked").alias("kind"),
        F.date_trunc("second", "ts").alias("written_at"), F.lit(3600).alias("ttl_s"),
    )
    end = events.agg(F.date_trunc("second", F.max("ts")).alias("end"))
    keys = events.select(F.col("user_id").alias("key")).distinct()
    now = end.first()["end"]  # one value: the time the check is made
    return snapshots.not_blocked(keys, blocked, F.lit(now))


_DOCS_SQL = """docs as (
    select cast(p_partkey as varchar) as id, p_name as title, p_size as version,
      cast(floor(p_retailprice) as bigint) as last_price from part where p_size <= 30),
changes as (
    select cast(p_partkey as varchar) as id, p_name || ' v2' as title, 20 + p_size % 20 as version,
      cast(floor(p_retailprice) as bigint) + 1 as last_price from part where p_size >= 15)"""


def _docs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))

    def at(version):
        return F.timestamp_seconds(F.unix_timestamp(start) + version).alias("updated_at")

    price = F.floor("p_retailprice")
    docs = part.where("p_size <= 30").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"),
        price.alias("last_price"), at(F.col("p_size")),
    )
    changes = part.where("p_size >= 15").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.concat("p_name", F.lit(" v2")).alias("title"),
        (price + 1).alias("last_price"), at(20 + F.col("p_size") % 20),
    )
    return docs, changes


@query("index_upsert", f"""with {_DOCS_SQL},
u as (select *, 0 as n from docs union all select *, 1 from changes)
select id, title, last_price from u
qualify row_number() over (partition by id order by version desc, n desc) = 1""")
def index_upsert(spark, sf_dir):
    docs, changes = _docs(spark, sf_dir)
    return offer_index.upsert(docs, changes).select("id", "title", "last_price")


@query("index_versions", f"""with {_DOCS_SQL},
u as (select *, 0 as n from docs union all select *, 1 from changes)
select id, title, last_price from u
where id not in (select cast(o_orderkey as varchar) from orders where o_orderstatus = 'F')
qualify row_number() over (partition by id order by version desc, n desc) = 1""")
def index_versions(spark, sf_dir):
    docs, changes = _docs(spark, sf_dir)
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").cast("string").alias("id")
    )
    index = offer_index.VersionedIndex(spark, run_folder(spark), buckets=64)
    index.apply(docs)
    index.apply(changes, gone)
    return index.documents().select("id", "title", "last_price")


@query("index_delete", """select cast(p_partkey as varchar) as id, p_name as title from part
where p_partkey not in (select o_orderkey from orders where o_orderstatus = 'F')""")
def index_delete(spark, sf_dir):
    docs = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title")
    )
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").cast("string").alias("id")
    )
    return offer_index.delete(docs, gone).select("id", "title")


# Orders as pages and their line items as links: small keys are catalogue pages.
_GRAPH = """links0 as (
    select 'p' || cast(l_orderkey as varchar) as page,
      case when l_partkey % 3 = 0 then 'p' || cast(l_suppkey * 13 + l_linenumber as varchar)
           else 'item' || cast(l_partkey as varchar) end as link,
      case when l_partkey % 3 = 0 then 'catalogue' else 'product' end as target,
      l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey % 10000 as ord, l_partkey from lineitem),
links1 as (select page, link, target, min(ord * 100000 + l_partkey) as ord from links0 group by all),
links as (select page, link, target, row_number() over (partition by page order by ord, link) as position
          from links1),
seeds as (select 'p' || cast(c_custkey as varchar) as page, c_custkey as seed_id from customer)"""


@query("link_harvest", f"""with {_GRAPH},
cat as (select page, link, position from links where target = 'catalogue'
        qualify row_number() over (partition by page order by position) <= 8),
v0 as (select seed_id, page, 0 as depth, [0::bigint] as path from seeds),
s1 as (select v0.seed_id, cat.link as page, 1 as depth, list_append(path, cat.position) as path
       from v0 join cat on cat.page = v0.page where cat.link <> v0.page
       qualify row_number() over (partition by v0.seed_id, cat.link order by list_append(path, cat.position)) = 1),
v1 as (select * from s1 qualify row_number() over (partition by seed_id order by path) <= 3),
s2 as (select v1.seed_id, cat.link as page, 2 as depth, list_append(path, cat.position) as path
       from v1 join cat on cat.page = v1.page
       where not exists (select 1 from v0 where v0.seed_id = v1.seed_id and v0.page = cat.link)
         and not exists (select 1 from v1 w where w.seed_id = v1.seed_id and w.page = cat.link)
       qualify row_number() over (partition by v1.seed_id, cat.link order by list_append(path, cat.position)) = 1),
v2 as (select * from s2 qualify row_number() over (partition by seed_id order by path) <= 3),
v as (select *, row_number() over (partition by seed_id order by depth, path) as visit
      from (select * from v0 union all select * from v1 union all select * from v2)
      qualify visit <= 3),
f as (select seed_id, visit, position, link from v join links using (page) where target = 'product'),
d as (select * from f qualify row_number() over (partition by seed_id, link order by visit, position) = 1)
select seed_id, link, row_number() over (partition by seed_id order by visit, position) as rank
from d qualify rank <= 8""")
def link_harvest(spark, sf_dir):
    from pyspark.sql import Window as W

    lines = table(spark, sf_dir, "lineitem")
    to_catalogue = F.col("l_partkey") % 3 == 0
    raw = lines.select(
        F.concat(F.lit("p"), F.col("l_orderkey")).alias("page"),
        F.when(to_catalogue, F.concat(F.lit("p"), F.col("l_suppkey") * 13 + F.col("l_linenumber")))
        .otherwise(F.concat(F.lit("item"), F.col("l_partkey"))).alias("link"),
        F.when(to_catalogue, "catalogue").otherwise("product").alias("target"),
        (
            (F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_suppkey") % 10000)
            * 100000 + F.col("l_partkey")
        ).alias("ord"),
    )
    links = raw.groupBy("page", "link", "target").agg(F.min("ord").alias("ord"))
    links = links.withColumn(
        "position", F.row_number().over(W.partitionBy("page").orderBy("ord", "link"))
    ).drop("ord")
    seeds = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("seed_id"), F.concat(F.lit("p"), "c_custkey").alias("url")
    )
    return hv.harvest(seeds, links)


@query("attach_corrections", """with l as (
  select event_id as search_id, user_id, ts, event_id % 10 as q from events where event_type in ('click', 'view')),
c as (select 'w' || cast(event_id % 10 as varchar) as k, ts, event_type, event_id from events where event_type in ('purchase', 'signup')),
j as (select search_id, c.event_type, c.event_id, l.ts < c.ts + case c.event_type when 'purchase' then 86400 else 3600 end * interval 1 second as ok
      from l join c on c.k = 'w' || cast(l.q as varchar) and l.ts >= c.ts
      qualify row_number() over (partition by search_id, c.event_type order by c.ts desc) = 1),
f as (select * from j where ok qualify row_number() over (partition by search_id order by event_type) = 1)
select search_id, 'w' || cast(q as varchar) as query_key, 'fix' || cast(event_id as varchar) as correction
from f join l using (search_id) where event_type = 'purchase' and event_id % 3 > 0""")
def attach_corrections(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    word = F.concat(F.lit("w"), F.col("event_id") % 10)
    searches = events.where(F.col("event_type").isin("click", "view")).select(
        F.col("event_id").alias("search_id"), F.concat(F.lit(" "), F.upper(word)).alias("query"),
        F.col("ts").alias("requested_at"),
    )
    hit = F.col("event_type") == "purchase"
    stored = events.where(F.col("event_type").isin("purchase", "signup")).select(
        F.concat(F.lit("query:spell:"), word).alias("key"),
        F.when(hit, "hit").otherwise("miss").alias("kind"), F.col("ts").alias("written_at"),
        F.when(hit, 86400).otherwise(3600).alias("ttl_s"),
        # every third correction equals the query and is dropped
        F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("fix"), "event_id")).otherwise(F.upper(word)).alias("payload"),
    )
    return snapshots.fresh_corrections(searches, stored)


@query("servable_from_index", """select p_partkey, p_name as title, greatest(p_size / 40.0, 1.0)::double as relevance_score, 1.0::double as confidence
from part where p_size % 4 > 0 and p_size % 6 > 0""")
def servable_from_index(spark, sf_dir):
    from offerloom.operators.searching import servable_from_index as servable

    size = F.col("p_size")
    hits = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("title"), F.when(size % 4 > 0, 100).otherwise(0).alias("last_price"),
        F.when(size % 6 > 0, "https://i.ru/1.png").otherwise("").alias("image_url"), (size / 40).alias("similarity"),
    )
    return servable(hits).select("p_partkey", "title", "relevance_score", "confidence")
