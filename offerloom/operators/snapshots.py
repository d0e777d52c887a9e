"""Result snapshots with time to live, negative entries, and lookups against them.

A snapshot row is (key, kind, written_at, ttl_s, payload, day); ``day`` partitions the
table, so writing appends and reading touches only the days that can still be fresh.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.schemas import SNAPSHOTS

HIT, MISS, BLOCKED = "hit", "miss", "blocked"


def _rows(df: DataFrame, key: Column, kind: str, ttl: Column, payload: Column, now: Column):
    return df.select(
        key.alias("key"),
        F.lit(kind).alias("kind"),
        now.alias("written_at"),
        ttl.cast("bigint").alias("ttl_s"),
        payload.alias("payload"),
        F.to_date(now).alias("day"),
    )


def result_snapshots(
    results: DataFrame, key: Column, now: Column, ttl: int = rules.SNAPSHOT_TTL
) -> DataFrame:
    """Snapshots of results (``products`` array); empty results are never stored."""
    full = results.where(F.size("products") > 0)
    return _rows(full, key, HIT, F.lit(ttl), F.to_json("products"), now)


def meta_snapshots(offers: DataFrame, key: Column, now: Column) -> DataFrame:
    """Page offers; incomplete ones (no price) live for a shorter time."""
    ttl = F.when(F.col("incomplete"), rules.META_INCOMPLETE_TTL).otherwise(rules.META_TTL)
    payload = F.to_json(F.struct(*[c for c in offers.columns]))
    return _rows(offers, key, HIT, ttl, payload, now)


def negative_snapshots(
    keys: DataFrame, key: Column, now: Column, kind: str = MISS, ttl: int = rules.MISS_TTL
) -> DataFrame:
    """Keys known to give nothing (``miss``) or to be refused (``blocked``)."""
    return _rows(keys, key, kind, F.lit(ttl), F.lit(None).cast("string"), now)


def write_snapshots(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("day").parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOTS).parquet(path)


def fresh(
    lookups: DataFrame,
    snapshots: DataFrame,
    kinds: tuple[str, ...] = (HIT, MISS),
    slice_seconds: int = 3_600,
) -> DataFrame:
    """Snapshot valid at each lookup's time; earlier kinds in ``kinds`` come first.

    ``lookups``: lookup_id, key, at. Adds kind, payload, written_at (NULL on a miss). A write
    replaces the key's previous entry of its kind, so per kind the latest entry before the
    lookup counts, if it has not expired.

    Both tables are laid out on (key, time slice) and walked once, no lookup is paired with
    more than one entry per kind. The latest entry before a slice is carried in from the
    slices' last entries, one small row per key and slice. A key holding a third of all rows
    is spread over its slices.
    """
    entry_type = "struct<micros:bigint,ttl_s:bigint,payload:string,written_at:timestamp>"

    def slice_of(ts: str) -> Column:
        return F.floor(F.unix_timestamp(ts) / slice_seconds)

    entry = F.struct(
        F.unix_micros("written_at").alias("micros"),
        F.col("ttl_s").cast("bigint").alias("ttl_s"),
        "payload",
        "written_at",
    )
    stored = snapshots.where(F.col("kind").isin(*kinds)).select(
        "key", slice_of("written_at").alias("slice"), "kind", entry.alias("entry")
    )
    asked = lookups.select("lookup_id", "key", slice_of("at").alias("slice"), "at")

    def per_kind(aggregate) -> list[Column]:
        return [
            aggregate(F.when(F.col("kind") == k, F.col("entry"))).alias(f"_{k}") for k in kinds
        ]

    lasts = stored.groupBy("key", "slice").agg(*per_kind(F.max))
    needed = asked.select("key", "slice").distinct()
    before = (
        W.partitionBy("key").orderBy("slice").rangeBetween(W.unboundedPreceding, -1)
    )
    carried = (
        lasts.withColumn("_ask", F.lit(False))
        .unionByName(needed.withColumn("_ask", F.lit(True)), allowMissingColumns=True)
        .select(
            "key", "slice", "_ask",
            *[F.last(f"_{k}", ignorenulls=True).over(before).alias(f"_{k}") for k in kinds],
        )
        .where("_ask")
    )
    no_entry = F.lit(None).cast(entry_type)
    start = F.lit(-1).cast("bigint")  # sorts before everything inside the slice

    def row(df: DataFrame, micros: Column, order: int, entries: dict[str, Column]) -> DataFrame:
        has_lookup = "lookup_id" in df.columns
        return df.select(
            "key", "slice", micros.alias("_at"), F.lit(order).alias("_order"),
            *[entries.get(k, no_entry).cast(entry_type).alias(f"_{k}") for k in kinds],
            (F.col("lookup_id") if has_lookup else F.lit(None)).alias("lookup_id"),
            (F.col("at") if has_lookup else F.lit(None).cast("timestamp")).alias("at"),
        )

    lane = row(
        stored, F.col("entry.micros"), 0,
        {k: F.when(F.col("kind") == k, F.col("entry")) for k in kinds},
    )
    lane = lane.unionByName(row(carried, start, 0, {k: F.col(f"_{k}") for k in kinds}))
    lane = lane.unionByName(row(asked, F.unix_micros("at"), 1, {}))
    upto = (
        W.partitionBy("key", "slice")
        .orderBy("_at", "_order", *[f"_{k}" for k in kinds])
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    walked = lane.select(
        "lookup_id", "key", "at",
        *[F.last(f"_{k}", ignorenulls=True).over(upto).alias(f"_{k}") for k in kinds],
    ).where(F.col("lookup_id").isNotNull())

    def valid(kind: str) -> Column:
        e = F.col(f"_{kind}")
        age = F.unix_micros("at") - e["micros"]
        return F.when(
            age < e["ttl_s"] * 1_000_000,
            F.struct(F.lit(kind).alias("kind"), e["payload"].alias("payload"),
                     e["written_at"].alias("written_at")),
        )

    answered = walked.select(
        "lookup_id", "key", "at", F.coalesce(*[valid(k) for k in kinds]).alias("_e")
    ).select("lookup_id", "key", "at", "_e.*")
    extra = [c for c in lookups.columns if c not in ("key", "at")]
    return answered if extra == ["lookup_id"] else answered.join(
        lookups.select(*extra), "lookup_id"
    )


_FOR_EVER = 2**31 - 1  # seconds


def served(lookups: DataFrame, snapshots: DataFrame, live: DataFrame) -> DataFrame:
    """What each lookup is answered with: fresh snapshot, else live result, else, when the
    live call failed, the stored answer again (``origin`` says which).

    ``live``: lookup_id, ok, payload.
    """
    known = fresh(lookups, snapshots, (HIT,)).withColumnRenamed("payload", "_stored")
    # What was stored last, expired or not.
    kept = snapshots.where(F.col("kind") == HIT).withColumn("ttl_s", F.lit(_FOR_EVER))
    stale = fresh(lookups, kept, (HIT,)).select("lookup_id", F.col("payload").alias("_stale"))
    joined = known.join(
        live.select("lookup_id", "ok", F.col("payload").alias("_live")), "lookup_id", "left"
    ).join(stale, "lookup_id", "left")
    origin = (
        F.when(F.col("_stored").isNotNull(), "snapshot")
        .when(F.coalesce("ok", F.lit(False)), "live")
        .when(F.col("_stale").isNotNull(), "stale")
        .otherwise("none")
    )
    return joined.select(
        "lookup_id",
        "key",
        origin.alias("origin"),
        F.when(origin == "snapshot", F.col("_stored"))
        .when(origin == "live", F.col("_live"))
        .when(origin == "stale", F.col("_stale"))
        .alias("payload"),
    )


def fresh_corrections(searches: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(query_key, correction) valid at each search's time; fresh misses suppress nothing but
    the lookup, equal texts give no correction.

    ``searches``: search_id, query, requested_at.
    """
    key = F.lower(F.regexp_replace("query", r"(?U)^\s+|\s+$", ""))
    lookups = searches.select(
        F.col("search_id").alias("lookup_id"),
        F.concat(F.lit("query:spell:"), key).alias("key"),
        F.col("requested_at").alias("at"),
        key.alias("query_key"),
    )
    found = fresh(lookups, snapshots)
    return found.where(
        (F.col("kind") == HIT) & (F.lower("payload") != F.col("query_key"))
    ).select(F.col("lookup_id").alias("search_id"), "query_key", F.col("payload").alias("correction"))


def not_blocked(keys: DataFrame, snapshots: DataFrame, at: Column) -> DataFrame:
    """Keys without a valid ``blocked`` entry at the given time."""
    blocked = (
        snapshots.where(F.col("kind") == BLOCKED)
        .groupBy("key")
        .agg(
            F.max(F.unix_timestamp("written_at") + F.col("ttl_s")).alias("_until"),
            F.min(F.unix_timestamp("written_at")).alias("_since"),
        )
    )
    now = F.unix_timestamp(at)
    live = blocked.where((F.col("_until") > now) & (F.col("_since") <= now)).select("key")
    return keys.join(live, "key", "left_anti")
