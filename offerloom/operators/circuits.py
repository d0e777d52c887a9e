"""Circuit state over a request log: a block answer opens it for a fixed time.

A request inside the open time is refused, so it cannot open the circuit again: the trips
of a key are a chain where each trip is the first block answer at or after the end of the
one before. Block answers with a quiet gap before them start a chain for certain. The rest
of each chain is found by pointer doubling, so even years of unbroken blocking on one key
take some twenty joins and never a sequential walk over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.operators.settling import settle
from offerloom.operators.timelines import next_at_or_after, slice_of, with_previous


def trips(requests: DataFrame, trip: Column, key: str, open_s: int = rules.CIRCUIT_OPEN) -> DataFrame:
    """(key, trip_at) of every opening."""
    points = requests.where(trip).select(key, F.col("ts").alias("at")).distinct()
    linked = next_at_or_after(points, key, "at", open_s)
    quiet = with_previous(points, key, "at", "at")
    gap = F.unix_micros("at") - F.unix_micros("previous_ts")
    heads = settle(
        quiet.where(F.col("previous_ts").isNull() | (gap >= open_s * 1_000_000)).select(key, "at")
    )
    # A pointer to a head leads into another chain, which is found from its own head.
    other_chain = heads.select(F.col(key).alias("_k"), F.col("at").alias("_h"))
    pointers = settle(
        linked.where(F.col("next_at").isNotNull()).join(
            other_chain,
            (F.col(key) == F.col("_k")) & (F.col("next_at") == F.col("_h")),
            "left_anti",
        )
    )
    reached = heads
    while not pointers.isEmpty():
        step = reached.join(pointers, [key, "at"]).select(key, F.col("next_at").alias("at"))
        reached = settle(reached.unionByName(step).distinct())
        onward = pointers.select(
            F.col(key).alias("_k"), F.col("at").alias("_a"), F.col("next_at").alias("_n")
        )
        pointers = settle(
            pointers.join(onward, (F.col(key) == F.col("_k")) & (F.col("next_at") == F.col("_a")))
            .select(key, "at", F.col("_n").alias("next_at"))
        )
    return reached.select(key, F.col("at").alias("trip_at"))


def circuit_state(
    requests: DataFrame,
    key: str = "user_id",
    trip: Column | None = None,
    open_s: int = rules.CIRCUIT_OPEN,
) -> DataFrame:
    """Requests with ``state``: ``trips`` (opens the circuit), ``refused`` or ``passes``.

    Only statuses 429 and 498 open it unless ``trip`` says otherwise. Openings are at least
    ``open_s`` apart, so a slice of that width holds at most one and a request meets at most
    two of them.
    """
    opens = trip if trip is not None else F.col("status").isin(*rules.TRIP_STATUSES)
    # The request that opens is the first of its instant; only block answers are searched for it.
    opened = trips(requests, opens, key, open_s)
    blocks = requests.where(opens).select(F.col(key).alias("_k"), F.col("ts").alias("_ts"), "request_id")
    openers = (
        opened.join(blocks, (F.col(key) == F.col("_k")) & (F.col("trip_at") == F.col("_ts")))
        .groupBy("_k", "trip_at")
        .agg(F.min("request_id").alias("_opener"))
    )
    first = slice_of("trip_at", open_s)
    spread = openers.withColumn("_s", F.explode(F.array(first, first + 1)))
    # The log is dealt out once; a request meets at most one opening that covers it.
    age = F.unix_micros("ts") - F.unix_micros("trip_at")
    joined = requests.withColumn("_slice", slice_of("ts", open_s)).join(
        spread,
        (F.col(key) == F.col("_k"))
        & (F.col("_slice") == F.col("_s"))
        & (age >= 0)
        & (age < open_s * 1_000_000),
        "left",
    )
    state = (
        F.when(F.col("request_id") == F.col("_opener"), "trips")
        # another request of the opening instant is in order of arrival behind the opener
        .when(F.col("trip_at").isNotNull(), "refused")
        .otherwise("passes")
    )
    return joined.withColumn("state", state).select(*requests.columns, "state")
