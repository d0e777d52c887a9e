"""Request metrics, funnels, diagnoses and attempt outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions.text import contains_any
from offerloom.operators.ranking import exact_ranks, first_by, nearest_index, top_n
from offerloom.operators.timelines import with_previous

FUNNEL_STAGES = (
    "live", "index", "merged", "ranked", "fetched", "fetch_failed", "extracted",
    "extract_failed",
)


def ref_percentile(
    df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int]
) -> DataFrame:
    """``sorted[min(floor(n*p/100), n-1)]`` per key as p50, p95, ..., two decimals."""
    wanted = {f"p{p}": (p / 100, nearest_index(p)) for p in percents}
    ranks = exact_ranks(df, keys, value, wanted)
    return ranks.select(*keys, *[F.round(name, 2).alias(name) for name in wanted])


def approx_percentile(
    df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int]
) -> DataFrame:
    """One-pass variant: within one ten-thousandth of the rank."""
    return df.groupBy(*keys).agg(
        *[F.percentile_approx(value, p / 100, 10_000).alias(f"p{p}") for p in percents]
    )


def request_metrics(requests: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals, success and cache-hit rates (four decimals), exact p50 and p95 latency."""
    grouped, keys = _keyed(requests, keys)
    total = F.count("*")
    totals = grouped.groupBy(*keys).agg(
        total.alias("total_requests"),
        F.count_if("success").alias("successful_requests"),
        F.round(F.count_if("success") / total, 4).alias("success_rate"),
        F.round(F.count_if("cache_hit") / total, 4).alias("cache_hit_rate"),
    )
    latencies = ref_percentile(grouped, keys, "latency_ms", (50, 95))
    return totals.join(latencies, keys, "left").drop("_all")


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Overall figures are figures of one constant key."""
    return (df, list(keys)) if keys else (df.withColumn("_all", F.lit(1)), ["_all"])


def histogram(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Row count per value: status codes, fallback layers."""
    return df.groupBy(*keys, column).agg(F.count("*").alias("count"))


def histogram_maps(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """The histogram as one map per key, values in order; a map holds few distinct codes."""
    counts, keys = _keyed(histogram(df, column, keys), keys)
    entry = F.struct(F.col(column), F.col("count"))
    return counts.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(f"{column}_counts")
    ).drop("_all")


def layer_counters(requests: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cache hits and misses, primary and browser requests, errors."""
    grouped, keys = _keyed(requests, keys)
    return grouped.groupBy(*keys).agg(
        F.count("*").alias("requests_total"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.count_if(~F.col("cache_hit")).alias("cache_misses"),
        F.count_if(~F.col("success")).alias("errors_total"),
        F.count_if(F.col("layer") == "primary").alias("primary_requests"),
        F.count_if(F.col("layer") == "browser").alias("browser_requests"),
    ).drop("_all")


def windowed_metrics(requests: DataFrame, width: str = "1 minute") -> DataFrame:
    """Rolling request metrics per time window; the same plan serves tables and streams."""
    total = F.count("*")
    return requests.groupBy(F.window("ts", width).alias("w")).agg(
        total.alias("total_requests"),
        F.count_if("success").alias("successful_requests"),
        F.round(F.count_if("success") / total, 4).alias("success_rate"),
        F.round(F.count_if("cache_hit") / total, 4).alias("cache_hit_rate"),
        F.max("latency_ms").alias("max_latency_ms"),
    ).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "total_requests", "successful_requests", "success_rate", "cache_hit_rate",
        "max_latency_ms",
    )


def funnel(stage_events: DataFrame, stages: Sequence[str] = FUNNEL_STAGES) -> DataFrame:
    """Counters per search from (search_id, stage, n): one column per stage, zero filled."""
    return stage_events.groupBy("search_id").agg(
        *[
            F.sum(F.when(F.col("stage") == s, F.col("n")).otherwise(0)).alias(s)
            for s in stages
        ]
    )


def page_verdicts(verdicts: DataFrame) -> DataFrame:
    """Accepted, duplicate and garbage counts per (search, page)."""
    return verdicts.groupBy("search_id", "page").agg(
        *[
            F.count_if(F.col("verdict") == v).alias(v)
            for v in ("accepted", "duplicate", "garbage")
        ]
    )


def samples(messages: DataFrame, n: int = 8, order: str = "ts") -> DataFrame:
    """First ``n`` messages per search as an array (never more than ``n`` are gathered)."""
    first = top_n(messages, ["search_id"], [F.asc(order), F.asc("message")], n)
    return first.groupBy("search_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(order, "message"))), lambda x: x["message"]
        ).alias("samples")
    )


def error_flags(errors: DataFrame) -> DataFrame:
    """Per search: any provider error, a search block, a transport error.

    ``errors``: search_id, provider, error.
    """
    text = F.lower("error")
    blocked = (F.col("provider") == "searxng") & contains_any(text, rules.SEARCH_BLOCK_MARKERS)
    transport = (F.col("provider") != "searxng") & contains_any(text, rules.TRANSPORT_MARKERS)
    return errors.groupBy("search_id").agg(
        F.lit(True).alias("any_error"),
        F.bool_or(blocked).alias("search_block"),
        F.bool_or(transport).alias("transport_error"),
    )


def diagnosis(counters: DataFrame) -> DataFrame:
    """User message for searches without offers from their counters.

    Needs live, fetched, extracted, timed_out, exception, any_error, search_block,
    transport_error; missing flags count as false.
    """
    text = rules.DIAGNOSIS

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    live, extracted = F.col("live"), F.col("extracted")
    reason = (
        F.when(flag("timed_out"), text["timeout"])
        .when((live == 0) & flag("search_block"), text["blocked"])
        .when((live == 0) & flag("any_error"), text["no_hits"])
        .when((live > 0) & (extracted == 0), text["no_cards"])
        .when(F.coalesce("exception", F.lit("")) != "", text["exception"])
        .otherwise(text["other"])
    )
    details = F.concat_ws(
        "; ",
        F.when(flag("search_block"), text["detail_blocked"]),
        F.when(flag("transport_error"), text["detail_transport"]),
        F.when((live > 0) & (F.col("fetched") > 0) & (extracted == 0), text["detail_cards"]),
    )
    return counters.withColumn(
        "diagnosis",
        F.concat_ws(
            "\n",
            F.lit(text["head"]),
            reason,
            F.when(details != "", F.concat(F.lit("Кратко: "), details, F.lit("."))),
            F.when(live == 0, text["retry"]),
        ),
    )


def best_attempt(attempts: DataFrame) -> DataFrame:
    """First success of each search, else its worst failure (earliest on ties).

    ``attempts``: search_id, ord, status, n_products, error.
    """
    products = F.coalesce("n_products", F.lit(0)) > 0
    success = products & F.col("error").isNull()
    status = F.coalesce("status", F.lit(0))
    priority = (
        F.when(products, 0)
        .when(status.isin(429, 403, 498), 3)
        .when(F.coalesce("error", F.lit("")).contains("пустой каталог"), 1)
        .otherwise(2)
    )
    ranked = attempts.withColumns(
        {
            "_success": success,
            "_priority": priority,
            "_status": F.when(products, 0).otherwise(status),
        }
    ).where(F.col("_success") | F.col("error").isNotNull())
    failed = F.when(~F.col("_success"), F.struct("_priority", "_status"))
    best = first_by(
        ranked, ["search_id"], [F.desc("_success"), failed.desc_nulls_last(), F.asc("ord")]
    )
    return best.withColumn(
        "outcome", F.when(F.col("_success"), "success").otherwise("failure")
    ).drop("_success", "_priority", "_status")


def provider_counts(hits: DataFrame) -> DataFrame:
    """Hits per search and provider, and the providers with hits joined in their order."""
    per_provider = hits.groupBy("search_id", "provider", "provider_ord").agg(
        F.count("*").alias("hits")
    )
    names = F.transform(
        F.array_sort(F.collect_list(F.struct("provider_ord", "provider"))),
        lambda x: x["provider"],
    )
    return per_provider.groupBy("search_id").agg(
        F.sum("hits").alias("hits"), F.array_join(names, "+").alias("providers")
    )


def spacing_audit(
    requests: DataFrame, key: str = "user_id", minimum_s: float = rules.REQUEST_SPACING
) -> DataFrame:
    """Gap to the previous request of the session and whether it is below the minimum."""
    gap = (F.unix_micros("ts") - F.unix_micros("previous_ts")) / 1_000_000
    return (
        with_previous(requests, key, "ts", "request_id")
        .withColumn("gap_s", gap)
        .withColumn("too_close", F.coalesce(F.col("gap_s") < minimum_s, F.lit(False)))
        .drop("previous_ts")
    )


def deadlines(results: DataFrame) -> DataFrame:
    """Results after their source's time budget count as timed out and empty.

    Needs requested_at, arrived_at (NULL when nothing arrived), budget_s, count.
    """
    late = F.col("arrived_at").isNull() | (
        F.unix_micros("arrived_at")
        > F.unix_micros("requested_at") + F.col("budget_s") * 1_000_000
    )
    return results.withColumns(
        {
            "timed_out": late,
            "count": F.when(late, F.lit(0)).otherwise(F.col("count")),
            "status": F.when(late, "error")
            .when(F.col("count") > 0, "complete")
            .otherwise("empty"),
        }
    )


def page_distinct(products: DataFrame) -> DataFrame:
    """Distinct (title, price) products per page."""
    return products.groupBy("page").agg(
        F.count_distinct(
            F.concat_ws(
                "|", F.coalesce("title", F.lit("")), F.coalesce("price_raw", F.lit(""))
            )
        ).alias("products")
    )
