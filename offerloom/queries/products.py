"""Products over time and sources: price history, alerts, matches, offers to enrich again."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.operators import enrichment, matching, price_history
from offerloom.queries.registry import query, table

_SEEN_SQL = """seen as (
  select l_partkey as product, cast(l_shipdate as timestamp) as observed_at,
    l_orderkey * 100 + l_linenumber * 10 + (l_suppkey % 10) as seq,
    max(cast(floor(l_discount * 100) as bigint)) as price
  from lineitem group by all),
changes as (select * from (
  select *, lag(price) over (partition by product order by observed_at, seq) as previous_price from seen)
  where price is distinct from previous_price)"""


def _seen(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_partkey").alias("product"),
            F.col("l_shipdate").cast("timestamp").alias("observed_at"),
            (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10).alias("seq"),
        )
        .agg(F.max(F.floor(F.col("l_discount") * 100).cast("bigint")).alias("price"))
    )


def _shown(changes):
    return changes.withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))


@query("price_history", f"with {_SEEN_SQL} select * from changes")
def price_changes(spark, sf_dir):
    return _shown(price_history.price_changes(_seen(spark, sf_dir)))


@query("price_alerts", f"""with {_SEEN_SQL},
w as (select p_partkey * 10 + k as watch_id, p_partkey as product, case k when 0 then 2 end as target,
    case k when 1 then 50 end as drop_percent from part, (select unnest([0, 1]) as k)),
r as (select watch_id, c.*, case when price <= target and (previous_price is null or previous_price > target)
    then 'target' when (previous_price - price) * 100 >= previous_price * drop_percent then 'drop' end as reason
  from changes c join w using (product))
select * from r where reason is not null""")
def price_alerts(spark, sf_dir):
    watches = table(spark, sf_dir, "part").select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), F.col("p_partkey").alias("product")
    ).select(
        (F.col("product") * 10 + F.col("k")).alias("watch_id"), "product",
        F.when(F.col("k") == 0, F.lit(2)).alias("target"),
        F.when(F.col("k") == 1, F.lit(50)).alias("drop_percent"),
    )
    changes = price_history.price_changes(_seen(spark, sf_dir))
    return _shown(price_history.price_alerts(changes, watches))


#: Words that a shop's title adds to a product's name, one for each bit of ``p_size``.
_EXTRAS = ((1, "new"), (2, "original"), (4, "sale"))


@query("product_matches", """with recursive offers as (
  select p_partkey as offer_id, 'shop' || (p_partkey % 3) as source, (p_size // 8) % 2 as num,
    list_sort(list_distinct(string_split(lower(p_name || ' ' || p_type
      || case when p_size & 1 > 0 then ' new' else '' end || case when p_size & 2 > 0 then ' original' else '' end
      || case when p_size & 4 > 0 then ' sale' else '' end), ' '))) as ws
  from part),
classes as (select num, ws, min(offer_id) as node from offers group by all),
pairs as (select a.node as a, b.node as b from classes a join classes b using (num)
  where len(list_intersect(a.ws, b.ws)) * 100 >= len(list_distinct(list_concat(a.ws, b.ws))) * 80),
reach as (select a, b from pairs union select r.a, p.b from reach r join pairs p on r.b = p.a),
components as (select a as node, min(b) as product from reach group by a),
named as (select offer_id, source, product from offers join classes using (num, ws) join components using (node))
select offer_id, source, product, n_sources from named
join (select product, count(distinct source) as n_sources from named group by product) using (product)
where n_sources > 1""")
def product_matches(spark, sf_dir):
    size = F.col("p_size")
    extras = [F.when(size.bitwiseAND(F.lit(bit)) > 0, F.lit(word)) for bit, word in _EXTRAS]
    memory = F.when(F.floor(size / 8) % 2 > 0, F.lit("128GB")).otherwise(F.lit("64GB"))
    offers = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("offer_id"),
        F.concat(F.lit("shop"), (F.col("p_partkey") % 3).cast("string")).alias("source"),
        F.concat_ws(" ", "p_name", memory, "p_type", *extras).alias("title"),
    )
    return matching.product_matches(offers)


_TRIES, _BACKOFF = 12, 86_400


@query("enrich_queue", f"""with offers as (
  select p_partkey as id, p_size / 50.0::double as confidence,
    timestamp '1996-01-01' + to_days((p_partkey % 1500)::int) as version from part),
log as (select l_partkey as id, cast(l_shipdate as timestamp) as stamp,
  case l_returnflag when 'A' then 'failed' when 'R' then 'taken'
    else case when l_linenumber = 7 then 'done' else 'failed' end end as state from lineitem),
folded as (select o.id, any_value(confidence) as confidence, any_value(version) as version,
    count(case when state = 'taken' then 1 end) as tries, max(stamp) as last_at,
    max(case when state = 'taken' then stamp end) as taken_at, count(case when state = 'done' then 1 end) as n_done
  from offers o left join log l on o.id = l.id and stamp >= version and stamp <= timestamp '2001-06-01'
  where confidence < 0.7 group by o.id),
timed as (select *, case when tries = 0 then version else greatest(
    last_at + to_seconds({_BACKOFF} * (2 ** (tries - 1))::bigint), taken_at + to_seconds({enrichment.LEASE_S})) end as due_at
  from folded where n_done = 0 and tries < {_TRIES})
select id, confidence, tries, due_at from timed where due_at <= timestamp '2001-06-01'""")
def enrich_queue(spark, sf_dir):
    key = F.col("p_partkey")
    version = F.date_add(F.lit("1996-01-01").cast("date"), (key % 1500).cast("int")).cast("timestamp")
    offers = table(spark, sf_dir, "part").select(
        key.alias("id"), (F.col("p_size") / 50.0).alias("confidence"), version.alias("updated_at")
    )
    flag = F.col("l_returnflag")
    state = (
        F.when(flag == "R", enrichment.TAKEN)
        .when((flag == "N") & (F.col("l_linenumber") == 7), enrichment.DONE)
        .otherwise(enrichment.FAILED)
    )
    log = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id"), F.col("l_shipdate").cast("timestamp").alias("at"), state.alias("state")
    )
    now = F.lit("2001-06-01").cast("timestamp")
    found = enrichment.due(offers, log, now, max_tries=_TRIES, backoff_s=_BACKOFF)
    return found.withColumn("due_at", F.col("due_at").cast("timestamp_ntz"))
