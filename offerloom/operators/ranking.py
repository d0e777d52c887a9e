"""First-wins, top-n and exact rank selection that hold up on hot keys.

``row_number() <= n`` is planned as a WindowGroupLimit before the shuffle, so each
task sends at most ``n`` rows per key and a key holding a third of the rows costs no
more than any other. Exact medians and percentiles never gather a group: a mergeable
sketch brackets the wanted rank, and only the values inside the bracket are ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_SKETCH_ACCURACY = 10_000
_MARGIN = 0.002  # twenty times the sketch's guaranteed rank error
_STRIPS = 1_024


def top_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank_col: str | None = None,
) -> DataFrame:
    """First ``n`` rows per key in the given order."""
    name = rank_col or "_rank"
    ranked = df.withColumn(
        name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    ).where(F.col(name) <= n)
    return ranked if rank_col else ranked.drop(name)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key: order-aware, unlike ``dropDuplicates``."""
    return top_n(df, keys, order, 1)


HOT_ROWS = 1_000_000


def join_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    size: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner join of many rows with one row per key that knows its key's row count.

    Keys with more than ``hot_rows`` rows are cut into parts of about that many and their single
    row copied to each; all others join as they are. The list of hot keys has at most total rows /
    ``hot_rows`` entries, which bounds what is broadcast.
    """
    keys = list(keys)
    is_hot = F.col(size) > hot_rows
    n_parts = F.ceil(F.col(size) / hot_rows).cast("int")
    hot = per_key.where(is_hot).select(*keys, n_parts.alias("_hot"))
    hashable = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    part = F.pmod(F.xxhash64(*hashable), F.col("_hot")).cast("int")
    spread = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.when(F.col("_hot").isNotNull(), part).otherwise(F.lit(0)))
        .drop("_hot")
    )
    parts = F.when(is_hot, F.sequence(F.lit(0), n_parts - 1)).otherwise(F.array(F.lit(0)))
    copies = per_key.withColumn("_salt", F.explode(parts))
    return spread.join(copies, [*keys, "_salt"]).drop("_salt")


def best_tier(
    df: DataFrame, keys: Sequence[str], tier: Column, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rows of each key's lowest tier. The minimum is combined map-side and joined back."""
    tiered = df.withColumn("_tier", tier)
    lowest = tiered.groupBy(*keys).agg(
        F.min("_tier").alias("_lowest"), F.count("*").alias("_size")
    )
    return (
        join_per_key(tiered, lowest, keys, "_size", hot_rows)
        .where(F.col("_tier") == F.col("_lowest"))
        .drop("_tier", "_lowest", "_size")
    )


Rank = tuple[float, Callable[[Column], Column]]


def exact_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: dict[str, Rank],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Exact order statistics per key.

    ``wanted`` maps an output name to ``(fraction, rank)``: ``rank`` gets the group size
    and returns the 1-based position, ``fraction`` says roughly where that is. Output is
    the keys, ``n`` and one column per name.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    kind = rows.schema["_v"].dataType
    fractions = sorted({p for p, _ in wanted.values()})
    edges = [
        edge
        for p in fractions
        for edge in (max(0.0, p - _MARGIN), min(1.0, p + _MARGIN))
    ]
    brackets = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.percentile_approx("_v", edges, _SKETCH_ACCURACY).alias("_edges"),
    )
    zones = F.array(
        *[
            F.struct(
                F.lit(i).alias("zone"),
                F.col("_edges")[2 * i].alias("lo"),
                F.col("_edges")[2 * i + 1].alias("hi"),
            )
            for i in range(len(fractions))
        ]
    )
    # Below the bracket only the count matters: those rows collapse to one NULL per zone
    # in the map-side combine. The bracket is cut into strips of equal width.
    strip = F.least(
        F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * _STRIPS),
        F.lit(_STRIPS - 1),
    )
    place = [*keys, "n", "_zone", "_strip"]
    placed = (
        join_per_key(rows, brackets, keys, "n", hot_rows)
        .select(*keys, "n", "_v", F.explode(zones).alias("_z"))
        .where(F.col("_v") <= F.col("_z.hi"))
        .select(
            *keys,
            "n",
            F.col("_z.zone").alias("_zone"),
            F.col("_z.lo").alias("lo"),
            F.col("_z.hi").alias("hi"),
            F.when(F.col("_v") >= F.col("_z.lo"), F.col("_v")).alias("_v"),
        )
        .withColumn(
            "_strip",
            F.when(F.col("_v").isNull(), -1)
            .when(F.col("hi") > F.col("lo"), strip)
            .otherwise(0)
            .cast("int"),
        )
        .groupBy(*place, "_v")
        .agg(F.count("*").alias("_c"))
    )
    # Only the strips that a wanted rank falls into are ordered, each by itself.
    up_to_strip = (
        W.partitionBy(*keys, "_zone").orderBy("_strip").rowsBetween(W.unboundedPreceding, -1)
    )
    strips = (
        placed.groupBy(*place)
        .agg(F.sum("_c").alias("_w"))
        .withColumn("_before", F.coalesce(F.sum("_w").over(up_to_strip), F.lit(0)))
    )

    def falls(name: str, before: Column, count: Column) -> Column:
        p, rank = wanted[name]
        position = rank(F.col("n"))
        return (
            (F.col("_zone") == fractions.index(p))
            & (position > before)
            & (position <= before + count)
        )

    met = reduce(or_, [falls(name, F.col("_before"), F.col("_w")) for name in wanted])
    upto = F.col("_before") + F.sum("_c").over(
        W.partitionBy(*keys, "_zone", "_strip")
        .orderBy("_v")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    counted = placed.join(strips.where(met).select(*place, "_before"), place).withColumn(
        "_upto", upto
    )
    picks = []
    for name in wanted:
        hit = falls(name, F.col("_upto") - F.col("_c"), F.col("_c"))
        value = F.max(F.when(hit, F.col("_v")))
        # The sketch's error bound keeps every rank inside its bracket; never give NULL instead.
        missing = F.raise_error(F.lit(f"{name}: rank outside its bracket")).cast(kind)
        picks.append(F.when(value.isNull(), missing).otherwise(value).alias(name))
    return counted.groupBy(*keys, "n").agg(*picks)


def lower_middle(n: Column) -> Column:
    return F.floor((n + 1) / 2)


def upper_middle(n: Column) -> Column:
    return F.floor(n / 2) + 1


def nearest_index(percent: float) -> Callable[[Column], Column]:
    """Rank of ``sorted[min(floor(n * percent / 100), n - 1)]``."""
    return lambda n: F.least(F.floor(n * percent / 100), n - 1) + 1
