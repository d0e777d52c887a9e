"""Streams over the given tables: these arrive in slices, the twins are those of the whole tables."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from offerloom.operators.ranking import first_by
from offerloom.operators.settling import run_folder
from offerloom.queries.inputs import REQUESTS_SQL
from offerloom.queries.metrics import _TOTALS, _pct
from offerloom.queries.registry import ORACLES, query, table
from offerloom.streaming import jobs, state

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLICES = 3


@contextmanager
def _rocks(spark):
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(conf, before)


def _drained(spark, stream, mode="append"):
    """Rows of a finished run, read back from the shared folder."""
    root = run_folder(spark)
    with _rocks(spark):
        run = jobs.drain_to(stream, f"{root}/rows", f"{root}/progress", mode)
        jobs.run_to_idle(run)
    return spark.read.parquet(f"{root}/rows")


def _in_slices(spark, rows, time, build, mode="append", forgotten=False):
    """Rows of a stream that takes in ``rows`` slice by slice in order of ``time``.

    Each slice lands in the stream's folder when the one before has been worked off, so that state
    is carried over at least as many micro-batches. Returns the folder's rows as well.
    """
    root = run_folder(spark)
    timed = rows.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")))
    cuts = timed.approxQuantile("_t", [k / SLICES for k in range(1, SLICES)], 0.01)
    part = F.lit(0)
    for cut in cuts:
        part = part + (F.col("_t") > int(cut)).cast("int")
    rows.limit(0).write.parquet(f"{root}/in/none")
    source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true")
    stream = build(source.parquet(f"{root}/in"))
    with _rocks(spark):
        for k in range(SLICES):
            timed.where(part == k).drop("_t").write.parquet(f"{root}/in/slice{k}")
            run = jobs.drain_to(stream, f"{root}/rows", f"{root}/progress", mode)
            jobs.run_to_idle(run, forgotten=forgotten and k == SLICES - 1)
    landed = spark.read.schema(rows.schema).option("recursiveFileLookup", "true")
    return spark.read.parquet(f"{root}/rows"), landed.parquet(f"{root}/in")


def _events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = jobs.read_table_stream(spark, sf_dir, "events", schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _requests(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("user_id"),
        F.when(kind == "error", 429).when(kind == "signup", 403).otherwise(200).alias("status"),
        F.col("value").alias("latency_ms"),
        (~kind.isin("error", "signup")).alias("success"),
        (kind == "view").alias("cache_hit"),
    )


@query("stream_metrics", f"""with {REQUESTS_SQL},
w as (select time_bucket(interval 1 hour, ts) as window_start, {_TOTALS},
    max(latency_ms) as max_latency_ms, {_pct(50)}, {_pct(95)}
  from requests group by time_bucket(interval 1 hour, ts)),
c as (select time_bucket(interval 1 hour, ts) as window_start, status, count(*) as n
  from requests group by all),
h as (select window_start, string_agg(cast(status as varchar) || '=' || cast(n as varchar), ','
    order by status) as status_counts from c group by window_start)
select *, window_start + interval 1 hour as window_end from w join h using (window_start)""")
def stream_metrics(spark, sf_dir):
    """Windows from the stream's counts and sketches; all have closed when the log has ended, so
    their percentiles are repaired from the rows that the stream has taken in."""
    states, landed = _in_slices(
        spark, _requests(spark, sf_dir), "ts", lambda s: jobs.metrics_stream(s, "1 hour"), "update"
    )
    newest = first_by(states, ["window_start", "status"], [F.desc("batch")]).drop("batch")
    windows = jobs.closed_windows(
        jobs.open_windows(newest), landed, F.lit("9999-01-01").cast("timestamp"), "1 hour"
    )
    pairs = F.transform(
        F.map_entries("status_counts"),
        lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")),
    )
    return windows.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
        | {"status_counts": F.array_join(pairs, ",")}
    )


@query("stream_dedupe", """select distinct user_id as search_id,
  'https://a.ru/' || event_type as url_key from events""")
def stream_dedupe(spark, sf_dir):
    hits = _events(spark, sf_dir).select(
        "ts", F.col("user_id").alias("search_id"),
        F.concat(F.lit("https://a.ru/"), "event_type", F.lit("#"), "event_id").alias("url"),
    )
    rows = _drained(spark, jobs.dedupe_stream(hits, "3650 days"))
    return rows.select("search_id", "url_key")


@query("stream_progress", ORACLES["progress"])
def stream_progress(spark, sf_dir):
    events = _events(spark, sf_dir).select(
        F.col("user_id").alias("search_id"), F.col("event_type").alias("source"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 3 == 0, "loading_more").otherwise("complete").alias("status"),
        (F.col("event_id") % 16).alias("count"),
    )
    rows = _drained(spark, jobs.progress_stream(events), "update")
    return first_by(rows, ["search_id", "source"], [F.desc("batch")]).drop("batch")


@query("stream_circuit", ORACLES["circuit_state_by_user"])
def stream_circuit(spark, sf_dir):
    rows, _ = _in_slices(spark, _requests(spark, sf_dir), "ts", state.circuit_state_stream)
    return rows.select("request_id", "state")


#: Tasks of the stream live so long, in seconds: many are over and made anew within the log.
TASK_LIFE = 20 * 86_400


@query("stream_task_status", f"""with recursive e as (
  select user_id as task_id, ts, event_id, case event_type when 'signup' then 'pending' when 'view' then 'running'
      when 'click' then 'running' when 'purchase' then 'completed' else 'failed' end as status,
    case when event_type = 'click' then 'шаг ' || cast(event_id as varchar) end as message,
    case when event_type = 'error' then 'сбой ' || cast(event_id as varchar) end as error from events),
p as (select task_id, ts, event_id from e where status = 'pending'),
chain(task_id, made_at, id) as (
  select task_id, min(ts), arg_min(event_id, (ts, event_id)) from p group by task_id
  union all
  select c.task_id, min(p.ts), arg_min(p.event_id, (p.ts, p.event_id)) from chain c join p
    on p.task_id = c.task_id and p.ts > c.made_at + interval {TASK_LIFE} second group by c.task_id, c.made_at),
made as (select *, lead(made_at) over (partition by task_id order by made_at) as next_at from chain),
newest as (select * from made where next_at is null),
x as (select e.*, n.made_at, case e.status when 'completed' then 'Готово' when 'failed' then e.error
        else e.message end as said
      from e join newest n on e.task_id = n.task_id and (e.ts, e.event_id) >= (n.made_at, n.id)
        and e.ts <= n.made_at + interval {TASK_LIFE} second)
select task_id, min(made_at) as created_at, arg_max(status, (ts, event_id)) as status,
  arg_max(said, (ts, event_id)) filter (said is not null) as message,
  nullif(arg_max(coalesce(error, ''), (ts, event_id)) filter (status in ('completed', 'failed')), '') as error
from x group by task_id""")
def stream_task_status(spark, sf_dir):
    """Newest life of each task; tasks end within the log and are made anew."""
    status = F.expr(
        "case event_type when 'signup' then 'pending' when 'view' then 'running' "
        "when 'click' then 'running' when 'purchase' then 'completed' else 'failed' end"
    )
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"), status.alias("status"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("шаг "), "event_id")).alias("message"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("сбой "), "event_id")).alias("error"),
    )
    rows, _ = _in_slices(
        spark, events, "ts", lambda s: state.task_status_stream(s, TASK_LIFE), "update"
    )
    newest = first_by(rows, ["task_id"], [F.desc("batch")])
    return newest.select(
        "task_id", F.timestamp_micros("created_micros").cast("timestamp_ntz").alias("created_at"),
        "status", "message", "error",
    )


@query("stream_fast_first", ORACLES["fast_first"])
def stream_fast_first(spark, sf_dir):
    """Offers in order of their dates; searches with fewer than five are published by an end marker
    that comes after all of them."""
    orders = table(spark, sf_dir, "orders")
    arrivals = orders.select(
        F.col("o_custkey").alias("search_id"),
        F.col("o_orderdate").cast("timestamp").alias("arrived_at"),
        F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("offer"),
        F.col("o_totalprice").alias("relevance_score"), F.lit(False).alias("ended"),
    )
    ends = arrivals.groupBy("search_id").agg(F.max("seq").alias("seq")).select(
        "search_id", F.lit("9999-01-01").cast("timestamp").alias("arrived_at"), "seq",
        F.lit(None).cast("string").alias("offer"), F.lit(None).cast("double").alias("relevance_score"),
        F.lit(True).alias("ended"),
    )
    rows, _ = _in_slices(spark, arrivals.unionByName(ends), "arrived_at", state.fast_first_stream)
    return rows.select(
        "search_id", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "n",
        F.array_join("offers", ",").alias("offers"),
    )


@query("stream_deadlines", """select o_custkey as search_id, cast(o_orderkey as varchar) as source,
  o_orderkey % 100 > 50 or o_orderstatus = 'F' as timed_out,
  case when o_orderkey % 100 > 50 or o_orderstatus = 'F' then 0 else o_orderkey % 7 end as count,
  case when o_orderkey % 100 > 50 or o_orderstatus = 'F' then 'error'
       when o_orderkey % 7 > 0 then 'complete' else 'empty' end as status
from orders""")
def stream_deadlines(spark, sf_dir):
    """Each order is a source that its customer's search asks. Those of status F never answer,
    others up to 100 s after they were asked. The clock of the replay reports silent ones after a
    second."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("search_id"), F.col("o_orderkey").alias("source"),
        F.col("o_orderdate").cast("timestamp").alias("requested_at"),
        (F.col("o_orderkey") % 100).alias("delay"),
        (F.col("o_orderstatus") == "F").alias("silent"),
        (F.col("o_orderkey") % 7).alias("count"),
    )

    def build(log):
        at = F.unix_micros("requested_at") + F.col("delay") * 1_000_000
        return state.deadline_stream(
            log.withColumn("budget_s", F.lit(50)),
            log.where(~F.col("silent")).withColumn("arrived_at", F.timestamp_micros(at)),
            wait_s=1,
            idle_s=5,
        )

    rows, _ = _in_slices(spark, orders, "requested_at", build, forgotten=True)
    return rows.select("search_id", "source", "timed_out", "count", "status")


@query("stream_index", """select cast(p_partkey as varchar) as id, p_name as title,
  cast(floor(p_retailprice) as bigint) as last_price from part""")
def stream_index(spark, sf_dir):
    part = jobs.read_table_stream(spark, sf_dir, "part", table(spark, sf_dir, "part").schema)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("version"))
    changes = part.select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias("version"), "p_partkey", "p_name", "p_retailprice"
    ).select(
        F.col("p_partkey").cast("string").alias("id"),
        F.when(F.col("version") == 1, F.col("p_name")).otherwise("old").alias("title"),
        F.floor("p_retailprice").alias("last_price"), at.alias("updated_at"),
    )
    root = run_folder(spark)
    jobs.index_stream(changes, root, f"{root}/progress").awaitTermination()
    stored = spark.read.parquet(f"{root}/changes")
    base = stored.drop("batch", "bucket").limit(0)
    return jobs.read_index(base, stored).select("id", "title", "last_price")
