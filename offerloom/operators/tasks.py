"""Search tasks over their event log: state, expiry, early results, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.operators.ranking import top_n


def task_status(events: DataFrame) -> DataFrame:
    """Latest state of every created task.

    ``events``: task_id, ts, seq, status, message, error. A task exists from its first
    ``pending`` event on; earlier events and unknown tasks are ignored. The message is the
    last one given, where completion says so and a failure gives its error; the error stays
    until the task completes.
    """
    when = F.struct("ts", "seq")
    done, failed = F.col("status") == "completed", F.col("status") == "failed"
    message = (
        F.when(done, "Готово")
        .when(failed, F.col("error"))
        .otherwise(F.nullif(F.col("message"), F.lit("")))
    )
    error = F.when(failed, F.col("error"))
    latest = events.groupBy("task_id").agg(
        F.min(F.when(F.col("status") == "pending", when)).alias("_created"),
        F.max_by("status", when).alias("status"),
        F.max(F.when(message.isNotNull(), F.struct(when.alias("at"), message.alias("v")))).alias("_m"),
        F.max(F.when(done | failed, F.struct(when.alias("at"), error.alias("v")))).alias("_e"),
    )

    def since_creation(entry: str):
        return F.when(F.col(f"{entry}.at") >= F.col("_created"), F.col(f"{entry}.v"))

    return latest.where(F.col("_created").isNotNull()).select(
        "task_id",
        F.col("_created.ts").alias("created_at"),
        "status",
        since_creation("_m").alias("message"),
        since_creation("_e").alias("error"),
    )


def drop_expired(tasks: DataFrame, now: Column, ttl: int = rules.TASK_TTL) -> DataFrame:
    """Tasks not older than their time to live."""
    age = F.unix_micros(now) - F.unix_micros("created_at")
    return tasks.where(age <= ttl * 1_000_000)


def fast_first(arrivals: DataFrame, n: int = rules.FAST_LIMIT) -> DataFrame:
    """Early answer of each search: its first ``n`` offers, best first.

    Published when the n-th offer arrives, or at the end with what there is. ``arrivals``:
    search_id, arrived_at, seq, offer, relevance_score.
    """
    first = top_n(arrivals, ["search_id"], [F.asc("arrived_at"), F.asc("seq")], n)
    by_score = F.transform(
        F.array_sort(
            F.collect_list(F.struct((-F.col("relevance_score")).alias("s"), "seq", "offer"))
        ),
        lambda x: x["offer"],
    )
    return first.groupBy("search_id").agg(
        F.max("arrived_at").alias("published_at"),
        F.count("*").alias("n"),
        by_score.alias("offers"),
    )


def progress(group_events: DataFrame) -> DataFrame:
    """Current group of every source of a search: the newest event replaces the others.

    ``group_events``: search_id, source, seq, status, count.
    """
    latest = F.max(F.struct("seq", "status", "count"))
    return (
        group_events.groupBy("search_id", "source")
        .agg(latest.alias("_l"))
        .select("search_id", "source", "_l.status", "_l.count")
    )
