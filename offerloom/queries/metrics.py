"""Request metrics, funnels, attempts, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom import rules
from offerloom.operators import circuits, evaluation, metrics, tasks
from offerloom.queries.inputs import REQUESTS_SQL, requests
from offerloom.queries.registry import query, table


def _pct(p: int, keys: str = "") -> str:
    return f"""round(list_sort(list(latency_ms))[least(floor(count(*) * {p} / 100), count(*) - 1)::bigint + 1], 2) as p{p}"""


_TOTALS = """count(*) as total_requests, count(*) filter (success) as successful_requests,
  round(count(*) filter (success) / count(*), 4) as success_rate,
  round(count(*) filter (cache_hit) / count(*), 4) as cache_hit_rate"""


@query("request_metrics", f"""with {REQUESTS_SQL}
select {_TOTALS}, {_pct(50)}, {_pct(95)} from requests""")
def request_metrics(spark, sf_dir):
    return metrics.request_metrics(requests(spark, sf_dir))


@query("request_metrics_by_user", f"""with {REQUESTS_SQL}
select user_id, {_TOTALS}, {_pct(50)}, {_pct(95)} from requests group by user_id""")
def request_metrics_by_user(spark, sf_dir):
    return metrics.request_metrics(requests(spark, sf_dir), ("user_id",))


@query("ref_percentile", f"""with {REQUESTS_SQL}
select endpoint, {_pct(5)}, {_pct(50)}, {_pct(99)} from requests group by endpoint""")
def ref_percentile(spark, sf_dir):
    return metrics.ref_percentile(requests(spark, sf_dir), ["endpoint"], "latency_ms", (5, 50, 99))


@query("status_histogram", f"""with {REQUESTS_SQL}
select layer, status, count(*) as count from requests group by layer, status""")
def status_histogram(spark, sf_dir):
    return metrics.histogram(requests(spark, sf_dir), "status", ("layer",))


@query("status_histogram_maps", f"""with {REQUESTS_SQL},
c as (select user_id, status, count(*) as n from requests group by user_id, status)
select user_id, string_agg(cast(status as varchar) || '=' || cast(n as varchar), ',' order by status) as counts
from c group by user_id""")
def status_histogram_maps(spark, sf_dir):
    maps = metrics.histogram_maps(requests(spark, sf_dir), "status", ("user_id",))
    pairs = F.transform(
        F.map_entries("status_counts"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))
    )
    return maps.select("user_id", F.array_join(pairs, ",").alias("counts"))


@query("layer_counters", f"""with {REQUESTS_SQL}
select user_id, count(*) as requests_total, count(*) filter (cache_hit) as cache_hits,
  count(*) filter (not cache_hit) as cache_misses, count(*) filter (not success) as errors_total,
  count(*) filter (layer = 'primary') as primary_requests,
  count(*) filter (layer = 'browser') as browser_requests
from requests group by user_id""")
def layer_counters(spark, sf_dir):
    return metrics.layer_counters(requests(spark, sf_dir), ("user_id",))


@query("windowed_metrics", f"""with {REQUESTS_SQL}
select time_bucket(interval 1 hour, ts) as window_start,
  time_bucket(interval 1 hour, ts) + interval 1 hour as window_end, {_TOTALS},
  max(latency_ms) as max_latency_ms
from requests group by time_bucket(interval 1 hour, ts)""")
def windowed_metrics(spark, sf_dir):
    windows = metrics.windowed_metrics(requests(spark, sf_dir), "1 hour")
    return windows.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    )


_STAGE = "case event_type when 'view' then 'live' when 'click' then 'ranked' when 'purchase' then 'extracted' when 'signup' then 'fetched' else 'merged' end"


def _stages(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("search_id"), F.expr(_STAGE).alias("stage"),
        (F.col("event_id") % 4).alias("n"), "event_id",
    )


@query("funnel", f"""with s as (select user_id as search_id, {_STAGE} as stage, event_id % 4 as n from events)
select search_id, """ + ", ".join(
    f"cast(coalesce(sum(n) filter (stage = '{s}'), 0) as bigint) as \"{s}\"" for s in metrics.FUNNEL_STAGES
) + " from s group by search_id")
def funnel(spark, sf_dir):
    return metrics.funnel(_stages(spark, sf_dir))


@query("page_verdicts", """select o_custkey as search_id, o_orderkey % 3 + 1 as page,
  count(*) filter (o_orderstatus = 'F') as accepted, count(*) filter (o_orderstatus = 'O') as duplicate,
  count(*) filter (o_orderstatus = 'P') as garbage from orders group by o_custkey, o_orderkey % 3 + 1""")
def page_verdicts(spark, sf_dir):
    verdict = F.when(F.col("o_orderstatus") == "F", "accepted").when(
        F.col("o_orderstatus") == "O", "duplicate"
    ).otherwise("garbage")
    verdicts = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("search_id"), (F.col("o_orderkey") % 3 + 1).alias("page"),
        verdict.alias("verdict"),
    )
    return metrics.page_verdicts(verdicts)


@query("failure_samples", """with f as (
  select user_id as search_id, ts, event_type || ' ' || cast(event_id as varchar) as message from events
  qualify row_number() over (partition by user_id order by ts, message) <= 8)
select search_id, string_agg(message, '; ' order by ts, message) as samples from f group by search_id""")
def failure_samples(spark, sf_dir):
    messages = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("search_id"), "ts",
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("message"),
    )
    return metrics.samples(messages).withColumn("samples", F.array_join("samples", "; "))


_D = rules.DIAGNOSIS


@query("diagnosis", f"""with c as (
  select user_id as search_id, count(*) filter (event_type = 'view' and event_id % 7 = 0) as live,
    count(*) filter (event_type = 'click' and event_id % 5 = 0) as fetched,
    count(*) filter (event_type = 'purchase' and event_id % 9 = 0) as extracted,
    user_id % 11 = 0 as timed_out, case when user_id % 4 = 0 then 'boom' else '' end as exception,
    count(*) filter (event_type = 'error') > 0 as any_error,
    count(*) filter (event_type = 'error' and event_id % 2 = 0) > 0 as search_block,
    count(*) filter (event_type = 'error' and event_id % 2 = 1) > 0 as transport_error
  from events group by user_id),
t as (select *, concat_ws('; ', case when search_block then '{_D["detail_blocked"]}' end,
    case when transport_error then '{_D["detail_transport"]}' end,
    case when live > 0 and fetched > 0 and extracted = 0 then '{_D["detail_cards"]}' end) as details from c)
select search_id, concat_ws(chr(10), '{_D["head"]}',
  case when timed_out then '{_D["timeout"]}' when live = 0 and search_block then '{_D["blocked"]}'
    when live = 0 and any_error then '{_D["no_hits"]}' when live > 0 and extracted = 0 then '{_D["no_cards"]}'
    when exception <> '' then '{_D["exception"]}' else '{_D["other"]}' end,
  case when details <> '' then 'Кратко: ' || details || '.' end,
  case when live = 0 then '{_D["retry"]}' end) as diagnosis from t""")
def diagnosis(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind, eid = F.col("event_type"), F.col("event_id")
    counters = events.groupBy(F.col("user_id").alias("search_id")).agg(
        F.count_if((kind == "view") & (eid % 7 == 0)).alias("live"),
        F.count_if((kind == "click") & (eid % 5 == 0)).alias("fetched"),
        F.count_if((kind == "purchase") & (eid % 9 == 0)).alias("extracted"),
    ).withColumns(
        {
            "timed_out": F.col("search_id") % 11 == 0,
            "exception": F.when(F.col("search_id") % 4 == 0, "boom").otherwise(""),
        }
    )
    errors = events.where(kind == "error").select(
        F.col("user_id").alias("search_id"),
        F.when(eid % 2 == 0, "searxng").otherwise("yahoo").alias("provider"),
        F.when(eid % 2 == 0, "Too many requests").otherwise("SSL_ERROR timeout").alias("error"),
    )
    joined = counters.join(metrics.error_flags(errors), "search_id", "left")
    return metrics.diagnosis(joined).select("search_id", "diagnosis")


@query("best_attempt", """with a as (
  select user_id as search_id, event_id as ord,
    case event_type when 'error' then 429 when 'signup' then 403 when 'click' then 500 else 200 end as status,
    case when event_type = 'purchase' and event_id % 60 = 0 then 3 else 0 end as n_products,
    case when event_type = 'purchase' and event_id % 60 = 0 then null
         when event_type = 'view' then 'пустой каталог' else event_type end as error from events),
r as (select *, n_products > 0 and error is null as ok,
    case when n_products > 0 then 0 when status in (429, 403, 498) then 3
         when error like '%пустой каталог%' then 1 else 2 end as prio from a)
select search_id, ord, status, n_products, error, case when ok then 'success' else 'failure' end as outcome from r
qualify row_number() over (partition by search_id order by ok desc,
  case when not ok then prio end desc, case when not ok then status end desc, ord) = 1""")
def best_attempt(spark, sf_dir):
    kind, eid = F.col("event_type"), F.col("event_id")
    won = (kind == "purchase") & (eid % 60 == 0)
    attempts = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("search_id"), eid.alias("ord"),
        F.when(kind == "error", 429).when(kind == "signup", 403).when(kind == "click", 500).otherwise(200).alias("status"),
        F.when(won, 3).otherwise(0).alias("n_products"),
        F.when(won, None).when(kind == "view", "пустой каталог").otherwise(kind).alias("error"),
    )
    return metrics.best_attempt(attempts)


@query("provider_counts", """with h as (
  select l_orderkey as search_id, case l_linenumber % 3 when 0 then 'yahoo' when 1 then 'searxng' else 'ddg' end as provider,
    l_linenumber % 3 as provider_ord from lineitem),
c as (select search_id, provider, provider_ord, count(*) as n from h group by all)
select search_id, cast(sum(n) as bigint) as hits, string_agg(provider, '+' order by provider_ord) as providers
from c group by search_id""")
def provider_counts(spark, sf_dir):
    number = F.col("l_linenumber") % 3
    hits = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("search_id"),
        F.when(number == 0, "yahoo").when(number == 1, "searxng").otherwise("ddg").alias("provider"),
        number.alias("provider_ord"),
    )
    return metrics.provider_counts(hits)


@query("spacing_audit", f"""with {REQUESTS_SQL},
g as (select request_id, user_id,
    (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, request_id))) / 1000000 as gap_s from requests)
select request_id, user_id, round(gap_s, 3) as gap_s, coalesce(gap_s < 3600, false) as too_close from g""")
def spacing_audit(spark, sf_dir):
    audit = metrics.spacing_audit(requests(spark, sf_dir), "user_id", 3600.0)
    return audit.select("request_id", "user_id", F.round("gap_s", 3).alias("gap_s"), "too_close")


@query("circuit_state", f"""with recursive {REQUESTS_SQL},
b as (select distinct ts from requests where status in (429, 403)),
chain(ts) as (
  select min(ts) from b
  union all select (select min(b.ts) from b where b.ts >= chain.ts + interval 900 second) from chain where chain.ts is not null),
t as (select ts from chain where ts is not null),
s as (select r.*, t.ts as trip_at from requests r left join t on r.ts >= t.ts and r.ts < t.ts + interval 900 second)
select request_id, case when trip_at is null then 'passes'
  when ts = trip_at and status in (429, 403)
    and request_id = min(request_id) filter (ts = trip_at and status in (429, 403)) over (partition by trip_at)
  then 'trips' else 'refused' end as state from s""")
def circuit_state(spark, sf_dir):
    log = requests(spark, sf_dir).withColumn("circuit", F.lit("all"))
    return circuits.circuit_state(
        log, "circuit", F.col("status").isin(429, 403)
    ).select("request_id", "state")


@query("circuit_state_by_user", f"""with recursive {REQUESTS_SQL},
b as (select distinct user_id, ts from requests where status = 429),
chain(user_id, ts) as (
  select user_id, min(ts) from b group by user_id
  union all select user_id, (select min(b.ts) from b where b.user_id = chain.user_id and b.ts >= chain.ts + interval 900 second)
  from chain where chain.ts is not null),
t as (select * from chain where ts is not null),
s as (select r.*, t.ts as trip_at from requests r left join t
      on r.user_id = t.user_id and r.ts >= t.ts and r.ts < t.ts + interval 900 second)
select request_id, case when trip_at is null then 'passes'
  when ts = trip_at and status = 429 then 'trips' else 'refused' end as state from s""")
def circuit_state_by_user(spark, sf_dir):
    return circuits.circuit_state(requests(spark, sf_dir)).select("request_id", "state")


@query("deadlines", """select l_orderkey as search_id, l_linenumber, l_partkey,
  l_discount * 1000 > 50 or l_returnflag = 'R' as timed_out,
  case when l_discount * 1000 > 50 or l_returnflag = 'R' then 0 else cast(l_quantity as bigint) end as count,
  case when l_discount * 1000 > 50 or l_returnflag = 'R' then 'error'
       when cast(l_quantity as bigint) > 0 then 'complete' else 'empty' end as status
from lineitem""")
def deadlines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("ts", F.col("l_shipdate").cast("timestamp"))
    delay = F.round(F.col("l_discount") * 1000).cast("bigint")
    results = lines.select(
        F.col("l_orderkey").alias("search_id"), "l_linenumber", "l_partkey",
        F.col("ts").alias("requested_at"),
        F.when(
            F.col("l_returnflag") != "R",
            F.timestamp_micros(F.unix_micros("ts") + delay * 1_000_000),
        ).alias("arrived_at"),
        F.lit(50).alias("budget_s"),
        F.col("l_quantity").cast("bigint").alias("count"),
    )
    return metrics.deadlines(results).select(
        "search_id", "l_linenumber", "l_partkey", "timed_out", "count", "status"
    )


@query("task_status", """with e as (
  select user_id as task_id, ts, event_id, case event_type when 'signup' then 'pending' when 'view' then 'running'
      when 'click' then 'running' when 'purchase' then 'completed' else 'failed' end as status,
    case when event_type = 'click' then 'шаг ' || cast(event_id as varchar) end as message,
    case when event_type = 'error' then 'сбой ' || cast(event_id as varchar) end as error from events),
c as (select task_id, min(event_id) filter (status = 'pending') as cid from e group by task_id),
x as (select e.*, case status when 'completed' then 'Готово' when 'failed' then error else message end as said
      from e join c using (task_id) where event_id >= cid)
select task_id, min(ts) as created_at, arg_max(status, event_id) as status,
  arg_max(said, event_id) filter (said is not null) as message,
  nullif(arg_max(coalesce(error, ''), event_id) filter (status in ('completed', 'failed')), '') as error
from x group by task_id""")
def task_status(spark, sf_dir):
    status = F.expr("case event_type when 'signup' then 'pending' when 'view' then 'running' when 'click' then 'running' when 'purchase' then 'completed' else 'failed' end")
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"), "ts", F.col("event_id").alias("seq"), status.alias("status"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("шаг "), "event_id")).alias("message"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("сбой "), "event_id")).alias("error"),
    )
    return tasks.task_status(events)


@query("fast_first", """with f as (
  select o_custkey as search_id, o_orderdate as arrived_at, o_orderkey as seq, o_totalprice as score from orders
  qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) <= 5)
select search_id, max(arrived_at) as published_at, count(*) as n,
  string_agg(cast(seq as varchar), ',' order by score desc, seq) as offers from f group by search_id""")
def fast_first(spark, sf_dir):
    arrivals = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("search_id"), F.col("o_orderdate").alias("arrived_at"),
        F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("offer"),
        F.col("o_totalprice").alias("relevance_score"),
    )
    return tasks.fast_first(arrivals).withColumn("offers", F.array_join("offers", ","))


@query("progress", """select user_id as search_id, event_type as source, count,
  case when event_id % 3 = 0 then 'loading_more' else 'complete' end as status
from (select *, event_id % 16 as count from events
      qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1)""")
def progress(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("search_id"), F.col("event_type").alias("source"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 3 == 0, "loading_more").otherwise("complete").alias("status"),
        (F.col("event_id") % 16).alias("count"),
    )
    return tasks.progress(events)


@query("page_distinct", """select l_orderkey as page, count(distinct l_returnflag || '|' || cast(l_suppkey % 4 as varchar)) as products
from lineitem group by l_orderkey""")
def page_distinct(spark, sf_dir):
    products = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("title"),
        (F.col("l_suppkey") % 4).cast("string").alias("price_raw"),
    )
    return metrics.page_distinct(products)


_CASE_SQL = """cases as (
    select c_custkey as case_id, c_custkey * 7 % 300 as took_ms, 240 as max_took_ms, c_nationkey % 4 as min_sources_ok,
      c_custkey % 12 as min_total, c_custkey % 3 > 0 as allow_antibot, c_custkey % 5 as need from customer),
g as (
    select o_custkey as case_id, case substr(o_orderpriority, 1, 1) when '1' then 'wildberries' when '2' then 'yandex_market'
        when '3' then 'other' else 'ozon' end as source,
      count(*) filter (o_orderstatus = 'F') as count,
      case when min(o_orderkey) % 3 = 0 then 'HTTP 429 блок' when min(o_orderkey) % 3 = 1 then 'сеть недоступна' end as error
    from orders group by 1, 2),
gn as (select *, case source when 'wildberries' then 0 when 'yandex_market' then 1 when 'other' then 2 else 3 end as ord from g),
agg as (
    select cases.*, coalesce(sum(count), 0)::bigint as total, count(*) filter (count > 0) as sources_ok,
      count(*) filter (count = 0 and not (allow_antibot and coalesce(contains(error, '429'), false))) as unexcused,
      coalesce(sum(count) filter (source = 'wildberries'), 0)::bigint as wb,
      string_agg(case when count = 0 and error is not null then source || case when allow_antibot and contains(error, '429')
        then ': antibot (' || error || ')' else ': ' || error end end, '; ' order by ord) as gnotes
    from cases left join gn using (case_id) group by all)"""


@query("evaluate_cases", f"""with {_CASE_SQL}
select case_id, sources_ok, total, took_ms <= 240 and (sources_ok >= min_sources_ok or (total >= min_total and unexcused = 0))
    and total >= min_total and wb >= need as passed,
  concat_ws('; ', nullif(gnotes, ''), case when took_ms > 240 then 'timeout: ' || took_ms || 'ms > 240ms' end,
    case when sources_ok < min_sources_ok then case when total >= min_total and unexcused = 0
      then 'soft pass: ' || sources_ok || ' active sources, others antibot/unavailable'
      else 'sources ok ' || sources_ok || ' < ' || min_sources_ok end end,
    case when total < min_total then 'products ' || total || ' < ' || min_total end,
    case when wb < need then 'wildberries: ' || wb || ' < ' || need end) as notes
from agg""")
def evaluate_cases(spark, sf_dir):
    key = F.col("c_custkey")
    cases = table(spark, sf_dir, "customer").select(
        key.alias("case_id"), (key * 7 % 300).alias("took_ms"), F.lit(240).alias("max_took_ms"),
        (F.col("c_nationkey") % 4).alias("min_sources_ok"), (key % 12).alias("min_total"),
        (key % 3 > 0).alias("allow_antibot"),
        F.create_map(F.lit("wildberries"), (key % 5).cast("int")).alias("required"),
    )
    source = F.expr("""case substr(o_orderpriority, 1, 1) when '1' then 'wildberries' when '2' then 'yandex_market'
        when '3' then 'other' else 'ozon' end""")
    first = F.min("o_orderkey")
    groups = table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("case_id"), source.alias("source")
    ).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("count"),
        F.when(first % 3 == 0, "HTTP 429 блок").when(first % 3 == 1, "сеть недоступна").alias("error"),
    )
    result = evaluation.evaluate_cases(cases, groups)
    return result.withColumn("notes", F.array_join("notes", "; "))


@query("offer_issues", """with o as (
  select p_brand as case_id, p_partkey, case when p_size % 4 = 0 then 'other: invalid price 0' end as a,
    case when p_size % 6 = 0 then 'other: bad url /p/' || cast(p_partkey as varchar) end as b from part),
i as (select case_id, p_partkey, 1 as nth, a as issue from o where a is not null
      union all select case_id, p_partkey, 2, b from o where b is not null),
n as (select *, row_number() over (partition by case_id order by p_partkey, nth) as rn,
        count(*) over (partition by case_id) as n_issues from i)
select case_id, n_issues, string_agg(issue, '; ' order by rn) as issues from n where rn <= 5 group by all""")
def offer_issues(spark, sf_dir):
    size = F.col("p_size")
    offers = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("case_id"), F.lit("other").alias("source"),
        F.col("p_partkey").alias("position"), F.col("p_name").alias("title"),
        F.when(size % 4 == 0, 0).otherwise(size).alias("price"),
        F.concat(F.when(size % 6 == 0, "/p/").otherwise("https://a.ru/"), "p_partkey").alias("product_url"),
        F.lit("https://i.ru/1.png").alias("image_url"),
    )
    return evaluation.offer_issues(offers).withColumn("issues", F.array_join("issues", "; "))


@query("stress_report", f"""with {REQUESTS_SQL}
select user_id as variant, count(*) as total, count(*) filter (success) as successes,
  count(*) filter (not success) as failures, round(count(*) filter (success) / count(*), 4) as success_rate,
  round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000, 2) as elapsed_sec from requests group by user_id""")
def stress_report(spark, sf_dir):
    return evaluation.stress_report(
        requests(spark, sf_dir).withColumnRenamed("user_id", "variant")
    )


@query("ab_gate", f"""with {REQUESTS_SQL},
r as (select user_id, round(count(*) filter (success and request_id % 2 = 0) / nullif(count(*) filter (request_id % 2 = 0), 0), 4) as rate_with,
        round(count(*) filter (success and request_id % 2 = 1) / nullif(count(*) filter (request_id % 2 = 1), 0), 4) as rate_without
      from requests group by user_id)
select user_id, rate_with, rate_without, coalesce(rate_with >= 0.65 and rate_without < 0.6, false) as pass from r""")
def ab_gate(spark, sf_dir):
    log = requests(spark, sf_dir).withColumn(
        "variant", F.when(F.col("request_id") % 2 == 0, "with").otherwise("without")
    )
    return evaluation.ab_gate(log, 0.65, 0.6, ("user_id",))


@query("source_status", """with g as (
  select o_custkey as search_id, case substr(o_orderpriority, 1, 1) when '1' then 'wildberries' when '2' then 'yandex_market'
        when '3' then 'other' else 'ozon' end as source,
    count(*) filter (o_orderstatus = 'F') as count,
    case when min(o_orderkey) % 5 = 0 then 'сбой' end as error,
    case when min(o_orderkey) % 7 = 0 then 'blocked_by_waf' end as status
  from orders group by 1, 2)
select search_id, source, case when source = 'other' and count = 0 and error is null and search_id % 2 = 0 then 'empty_with_diagnostics'
    when status is not null then status when count > 0 then 'complete' when error is not null then 'error' else 'empty' end as status,
  case when source = 'other' and count = 0 and error is null and search_id % 2 = 0 then 'нет' else error end as error from g""")
def source_status(spark, sf_dir):
    from offerloom.operators.summaries import final_status, with_diagnostics

    source = F.expr("""case substr(o_orderpriority, 1, 1) when '1' then 'wildberries' when '2' then 'yandex_market'
        when '3' then 'other' else 'ozon' end""")
    first = F.min("o_orderkey")
    groups = table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("search_id"), source.alias("source")
    ).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("count"),
        F.when(first % 5 == 0, "сбой").alias("error"),
        F.when(first % 7 == 0, "blocked_by_waf").alias("status"),
    )
    diagnoses = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("search_id"), F.lit("нет").alias("diagnosis")
    )
    labelled = with_diagnostics(groups, diagnoses)
    return labelled.select(
        "search_id", "source",
        final_status(F.col("status"), F.col("count"), F.col("error")).alias("status"), "error",
    )
