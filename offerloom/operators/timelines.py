"""Neighbours in time per key, laid out on time slices so that no key is one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def slice_of(ts: str | Column, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(ts) / seconds)


def with_previous(
    df: DataFrame, key: str, ts: str, tie: str, slice_seconds: int = 3_600
) -> DataFrame:
    """Add ``previous_ts``: the row before in time of the same key (``tie`` orders equals).

    Inside a slice it is a plain lag; a slice's first row gets the last time of the nearest
    earlier slice from a table of one row per key and slice.
    """
    sliced = df.withColumn("_slice", slice_of(ts, slice_seconds))
    lasts = sliced.groupBy(key, "_slice").agg(F.max(ts).alias("_last"))
    carried = lasts.select(
        F.col(key).alias("_k"),
        F.col("_slice").alias("_s"),
        F.lag("_last").over(W.partitionBy(key).orderBy("_slice")).alias("_carried"),
    )
    inside = F.lag(ts).over(W.partitionBy(key, "_slice").orderBy(ts, tie))
    return (
        sliced.withColumn("_inside", inside)
        .join(carried, (F.col(key) == F.col("_k")) & (F.col("_slice") == F.col("_s")))
        .withColumn("previous_ts", F.coalesce("_inside", "_carried"))
        .drop("_slice", "_inside", "_k", "_s", "_carried")
    )


def next_at_or_after(
    points: DataFrame, key: str, at: str, delay_s: int, slice_seconds: int = 3_600
) -> DataFrame:
    """For each distinct (key, at) the first point of the key at or after ``at + delay``.

    Returns key, at, ``next_at`` (NULL when there is none).
    """
    targets = points.select(key, F.col(at).alias("_t"))
    asks = points.select(
        key, F.col(at).alias("_from"), (F.col(at) + F.expr(f"interval {delay_s} seconds")).alias("_t")
    )
    marked = targets.withColumn("_from", F.lit(None).cast("timestamp")).unionByName(asks)
    marked = marked.withColumn("_slice", slice_of("_t", slice_seconds))
    is_target = F.col("_from").isNull()
    firsts = marked.groupBy(key, "_slice").agg(
        F.min(F.when(is_target, F.col("_t"))).alias("_first")
    )
    later = firsts.select(
        F.col(key).alias("_k"),
        F.col("_slice").alias("_s"),
        F.first("_first", ignorenulls=True)
        .over(W.partitionBy(key).orderBy("_slice").rowsBetween(1, W.unboundedFollowing))
        .alias("_later"),
    )
    # targets sort before asks of the same time, so "at" counts
    seen = F.last(F.when(is_target, F.col("_t")), ignorenulls=True).over(
        W.partitionBy(key, "_slice")
        .orderBy(F.desc("_t"), is_target.desc())
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        marked.withColumn("_seen", seen)
        .where(F.col("_from").isNotNull())
        .join(later, (F.col(key) == F.col("_k")) & (F.col("_slice") == F.col("_s")))
        .select(
            key, F.col("_from").alias(at), F.coalesce("_seen", "_later").alias("next_at")
        )
    )
