"""Price history of products and alerts on it.

The history is a change log: an observation is stored only when its price differs from the one before
it. Products are laid out on time slices with one carried price per slice, so that no product's
observations are one task's work. The same log comes from a table of observations or, slice by
slice, from what arrives after a log that is there already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.operators.ranking import join_per_key
from offerloom.operators.timelines import slice_of

SLICE_S = 7 * 86_400


def price_changes(
    observations: DataFrame, known: DataFrame | None = None, slice_seconds: int = SLICE_S
) -> DataFrame:
    """``product, observed_at, seq, price, previous_price`` of every change of a product's price.

    ``observations``: product, observed_at, seq, price; ``seq`` orders equal times. A first price is
    a change from NULL; observations without a product, time or price are none. ``known`` holds each
    product's last price (``product, price``) before all of these observations, see ``last_prices``.
    """
    sound = observations.where(
        F.col("product").isNotNull() & F.col("observed_at").isNotNull() & F.col("price").isNotNull()
    ).select("product", "observed_at", "seq", "price")
    sliced = sound.withColumn("_slice", slice_of("observed_at", slice_seconds))
    when = F.struct("observed_at", "seq")
    lasts = sliced.groupBy("product", "_slice").agg(F.max_by("price", when).alias("_last"))
    carried = lasts.select(
        F.col("product").alias("_p"),
        F.col("_slice").alias("_s"),
        F.lag("_last").over(W.partitionBy("product").orderBy("_slice")).alias("_carried"),
    )
    if known is not None:
        before = known.select(F.col("product").alias("_known"), F.col("price").alias("_before"))
        carried = carried.join(before, F.col("_p") == F.col("_known"), "left").select(
            "_p", "_s", F.coalesce("_carried", "_before").alias("_carried")
        )
    inside = F.lag("price").over(W.partitionBy("product", "_slice").orderBy("observed_at", "seq"))
    return (
        sliced.withColumn("_inside", inside)
        .join(carried, (F.col("product") == F.col("_p")) & (F.col("_slice") == F.col("_s")))
        .withColumn("previous_price", F.coalesce("_inside", "_carried"))
        .where(~F.col("price").eqNullSafe(F.col("previous_price")))
        .select("product", "observed_at", "seq", "price", "previous_price")
    )


def last_prices(changes: DataFrame) -> DataFrame:
    """``product, price`` after all changes of a log: what the next slice goes on from."""
    when = F.struct("observed_at", "seq")
    return changes.groupBy("product").agg(F.max_by("price", when).alias("price"))


def prices_at(changes: DataFrame, asks: DataFrame, slice_seconds: int = SLICE_S) -> DataFrame:
    """Adds ``price``, the product's price at each ask's ``at``; NULL before its first change.

    ``asks``: product, at and more. A change counts from its own time on.
    """
    point = F.struct(F.col("observed_at").alias("t"), F.col("seq").alias("s"))
    logged = changes.select(
        "product", point.alias("_when"), F.col("price").alias("_price"),
        slice_of("observed_at", slice_seconds).alias("_slice"),
    )
    lasts = logged.groupBy("product", "_slice").agg(F.max_by("_price", "_when").alias("_last"))
    rows = asks.select(F.struct(*[F.col(f"`{c}`") for c in asks.columns]).alias("_ask")).select(
        "_ask",
        F.col("_ask.product").alias("product"),
        F.col("_ask.at").alias("_at"),
        slice_of(F.col("_ask.at"), slice_seconds).alias("_slice"),
    )
    # Slices asked for, with the last price of an earlier slice that has one.
    slices = lasts.unionByName(
        rows.select("product", "_slice").distinct().withColumn("_last", F.lit(None).cast("bigint"))
    ).groupBy("product", "_slice").agg(F.max("_last").alias("_last"))
    earlier = W.partitionBy("product").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = slices.select(
        "product", "_slice", F.last("_last", ignorenulls=True).over(earlier).alias("_carried")
    )
    none = F.lit(None)
    marked = logged.select(
        "product", "_slice", F.col("_when.t").alias("_at"), F.lit(0).alias("_kind"),
        F.col("_when.s").alias("_seq"), "_price", none.cast(rows.schema["_ask"].dataType).alias("_ask"),
    ).unionByName(
        rows.select(
            "product", "_slice", "_at", F.lit(1).alias("_kind"),
            none.cast(changes.schema["seq"].dataType).alias("_seq"),
            none.cast(changes.schema["price"].dataType).alias("_price"), "_ask",
        )
    )
    upto = (
        W.partitionBy("product", "_slice")
        .orderBy("_at", "_kind", "_seq")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        marked.withColumn("_seen", F.last("_price", ignorenulls=True).over(upto))
        .where(F.col("_kind") == 1)
        .join(carried, ["product", "_slice"], "left")
        .select("_ask.*", F.coalesce("_seen", "_carried").alias("price"))
    )


def price_alerts(changes: DataFrame, watches: DataFrame) -> DataFrame:
    """``watch_id, product, observed_at, seq, price, previous_price, reason`` of changes to report.

    ``watches``: watch_id, product, target (a price, or NULL), drop_percent (or NULL). A watch
    reports a change to its target or below from above it, ``target``, and a fall by its
    share of the price before, ``drop``; both at once as ``target``. A first price below the target
    is reported too. Products with very many changes are cut into parts that each meet the product's
    watches.
    """
    per_product = changes.groupBy("product").agg(F.count("*").alias("_n"))
    of_product = (
        watches.where(F.col("product").isNotNull())
        .groupBy("product")
        .agg(F.collect_set(F.struct("watch_id", "target", "drop_percent")).alias("_watches"))
        .join(per_product, "product")
    )
    price, before = F.col("price"), F.col("previous_price")
    reached = (price <= F.col("_w.target")) & (before.isNull() | (before > F.col("_w.target")))
    fell = (before - price) * 100 >= before * F.col("_w.drop_percent")
    reason: Column = F.when(reached, "target").when(fell, "drop")
    return (
        join_per_key(changes, of_product, ["product"], "_n")
        .withColumn("_w", F.explode("_watches"))
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select(
            F.col("_w.watch_id").alias("watch_id"), "product", "observed_at", "seq", "price",
            "previous_price", "reason",
        )
    )
