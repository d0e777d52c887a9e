"""Windowed metrics, progress, dedupe and index upkeep over streams."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from offerloom.functions.url import url_key
from offerloom.operators import metrics, tasks
from offerloom.operators.offer_index import bucketed, upsert
from offerloom.operators.ranking import first_by


def read_table_stream(
    spark: SparkSession,
    folder: str,
    name: str,
    schema,
    per_trigger: int = 64,
    bytes_per_trigger: str | None = None,
) -> DataFrame:
    """Parquet files of one table in a folder as a stream with a bounded batch.

    A batch is bounded by files, or by their size if ``bytes_per_trigger`` is given.
    """
    bound = (
        ("maxBytesPerTrigger", bytes_per_trigger)
        if bytes_per_trigger
        else ("maxFilesPerTrigger", per_trigger)
    )
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{name}*.parquet")
        .option(*bound)
        .parquet(folder)
    )


def metrics_stream(
    requests: DataFrame, width: str = "1 minute", delay: str = "10 minutes"
) -> DataFrame:
    """Request metrics per time window and status; late requests up to ``delay`` still count.

    The state of a window and status is its counts and a mergeable sketch of its latencies;
    ``open_windows`` merges the statuses of a window. States go with the watermark.
    """
    return (
        requests.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "status")
        .agg(
            F.count("*").alias("total"),
            F.count_if("success").alias("successful"),
            F.count_if("cache_hit").alias("hits"),
            F.max("latency_ms").alias("max_latency_ms"),
            F.kll_sketch_agg_double(F.col("latency_ms").cast("double")).alias("sketch"),
        )
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "status",
            "total", "successful", "hits", "max_latency_ms", "sketch",
        )
    )


def open_windows(states: DataFrame) -> DataFrame:
    """Windows from the newest states of ``metrics_stream``, percentiles as their sketches say.

    Requests without a status are in no entry of ``status_counts``.
    """
    entry = F.when(F.col("status").isNotNull(), F.struct("status", "total"))
    merged = states.groupBy("window_start", "window_end").agg(
        F.sum("total").alias("total_requests"),
        F.sum("successful").alias("successful_requests"),
        F.round(F.sum("successful") / F.sum("total"), 4).alias("success_rate"),
        F.round(F.sum("hits") / F.sum("total"), 4).alias("cache_hit_rate"),
        F.max("max_latency_ms").alias("max_latency_ms"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("status_counts"),
        F.kll_merge_agg_double("sketch").alias("_all"),
    )
    ranks = {
        f"p{p}": F.round(F.kll_sketch_get_quantile_double("_all", F.lit(p / 100)), 2)
        for p in (50, 95)
    }
    return merged.withColumns(ranks).drop("_all")


def closed_windows(
    open_rows: DataFrame, requests: DataFrame, closed_before, width: str = "1 minute"
) -> DataFrame:
    """Windows that ended by ``closed_before`` with exact percentiles from the stored requests.

    ``requests`` are the stream's stored rows; only those of closed windows are read. Windows
    still open keep the sketches' figures.
    """
    over = F.col("window_end") <= closed_before
    stored = requests.withColumn("_w", F.window("ts", width)).where(
        F.col("_w.end") <= closed_before
    )
    exact = metrics.ref_percentile(
        stored.select(F.col("_w.start").alias("window_start"), "latency_ms"),
        ["window_start"], "latency_ms", (50, 95),
    )
    repaired = open_rows.where(over).drop("p50", "p95").join(exact, "window_start", "left")
    return repaired.unionByName(open_rows.where(~over))


def progress_stream(group_events: DataFrame) -> DataFrame:
    """Current group per source (update mode)."""
    return tasks.progress(group_events)


def dedupe_stream(hits: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First hit of each URL per search among hits at most ``delay`` apart."""
    return (
        hits.withColumn("url_key", url_key(F.col("url")))
        .withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["search_id", "url_key"])
    )


def drain_to(
    stream: DataFrame, target: str, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Start a run over what is there now; rows land in ``target`` by batch.

    Each batch overwrites only its own folder, so a retried batch leaves no duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def run_to_idle(
    query: StreamingQuery, forgotten: bool = False, timeout_s: float = 3_600.0
) -> StreamingQuery:
    """Let a query by the clock take in all there is, then stop it.

    Clocks never stop a query by themselves: it is stopped after a batch without input, with
    ``forgotten`` after one that leaves no state behind. The first batch of a run may be the one that
    the run before was stopped in, and says nothing. Other queries end on their own.
    """
    until = time.monotonic() + timeout_s
    while query.isActive:
        last = query.lastProgress
        if len(query.recentProgress) > 1 and last.numInputRows == 0:
            held = sum(s.numRowsTotal for s in last.stateOperators)
            if not (forgotten and held):
                query.stop()
                break
        if time.monotonic() > until:
            query.stop()
            raise TimeoutError(f"the stream was not idle after {timeout_s} s")
        query.awaitTermination(0.2)
    failed = query.exception()
    if failed is not None:
        raise failed
    return query


def latest_by_batch(spark: SparkSession, target: str, keys: list[str], schema: str) -> DataFrame:
    """Rows written by ``drain_to`` in update mode: the newest batch wins per key."""
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(target)
    return first_by(rows, keys, [F.desc("batch")]).drop("batch")


def index_stream(changes: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Take index changes in as they come: a batch appends its newest version per id.

    Readers see base and changes through ``read_index``; ``compact_index`` folds the changes
    into a new base now and then, so a batch never rewrites the index.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = first_by(batch, ["id"], [F.desc("updated_at")])
        bucketed(newest).write.mode("overwrite").parquet(f"{root}/changes/batch={batch_id}")

    return (
        changes.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def read_index(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Index with its not yet compacted changes."""
    extra = [c for c in ("batch", "bucket") if c in changes.columns]
    return upsert(base, first_by(changes, ["id"], [F.desc("updated_at")]).drop(*extra))


def compact_index(base: DataFrame, changes: DataFrame, target: str) -> None:
    """Write a new base to a new folder."""
    bucketed(read_index(base, changes)).write.mode("errorifexists").partitionBy(
        "bucket"
    ).parquet(target)
