"""Queue of offers to be enriched again: weak offers, attempts, back-off, taken batch by batch.

The queue is an append-only log of what happened to offers; nothing is rewritten. What is due follows
from the offers and the log alone, so a lost batch is taken again by the same rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.operators.settling import finished, settle

CONFIDENT = 0.7
MAX_TRIES, BACKOFF_S, LEASE_S = 5, 3600, 900
TAKEN, DONE, FAILED = "taken", "done", "failed"
LOG_SCHEMA = "id string, at timestamp, state string, batch string"


def _after(at: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(at) + seconds.cast("bigint") * 1_000_000)


def due(
    offers: DataFrame,
    log: DataFrame,
    now: Column,
    threshold: float = CONFIDENT,
    max_tries: int = MAX_TRIES,
    backoff_s: int = BACKOFF_S,
    lease_s: int = LEASE_S,
) -> DataFrame:
    """``id, confidence, tries, due_at`` of every offer that is to be enriched at ``now``.

    ``offers``: id, confidence, updated_at; of rows with one id the newest counts, of equally new ones
    the weakest. ``log``: id, at, state. An offer is weak below ``threshold``, a NULL confidence is 0.
    Only entries from the offer's ``updated_at`` on count: a new version begins anew. An offer that is
    done or has been taken ``max_tries`` times is not due; one that was taken is due when its lease has
    run out and ``backoff_s * 2 ** (tries - 1)`` seconds lie behind its last entry. NULL ids and times
    take no part.
    """
    sound = offers.where(F.col("id").isNotNull() & F.col("updated_at").isNotNull())
    confidence = F.coalesce(F.col("confidence"), F.lit(0.0))
    weak = (
        sound.groupBy("id")
        .agg(F.max(F.struct("updated_at", (-confidence).alias("_lack"))).alias("_newest"))
        .select("id", "_newest.updated_at", (-F.col("_newest._lack")).alias("confidence"))
        .where(F.col("confidence") < threshold)
    )
    # An id with very many entries is split by the skew join, its counts are combined map-side.
    entries = log.where(F.col("at").isNotNull()).select(F.col("id").alias("_id"), "at", "state")
    counted = (F.col("at") >= F.col("updated_at")) & (F.col("at") <= now)
    taken = F.col("state") == TAKEN
    tried = (
        weak.join(entries, (F.col("id") == F.col("_id")) & counted, "left")
        .groupBy("id", "confidence", "updated_at")
        .agg(
            F.count(F.when(taken, 1)).alias("tries"),
            F.max("at").alias("_last"),
            F.max(F.when(taken, F.col("at"))).alias("_taken"),
            F.count(F.when(F.col("state") == DONE, 1)).alias("_done"),
        )
    )
    wait = F.lit(backoff_s) * F.pow(F.lit(2), F.col("tries") - 1)
    due_at = F.when(F.col("tries") == 0, F.col("updated_at")).otherwise(
        F.greatest(_after(F.col("_last"), wait), _after(F.col("_taken"), F.lit(lease_s)))
    )
    return (
        tried.where((F.col("_done") == 0) & (F.col("tries") < max_tries))
        .select("id", "confidence", "tries", due_at.alias("due_at"))
        .where(F.col("due_at") <= now)
    )


class EnrichmentQueue:
    """The log in a folder that all executors reach: one sub-folder for each batch and its results.

    A folder counts once it is complete. A batch whose name is already there is returned as it was, so
    a driver that starts again neither takes offers twice nor loses those it had taken.
    """

    def __init__(self, spark, path: str, **rules) -> None:
        self.spark, self.path, self.rules = spark, path.rstrip("/"), rules

    def log(self) -> DataFrame:
        """``id, at, state, batch`` of everything that has happened."""
        folders = [f"{self.path}/{name}" for name in finished(self.spark, self.path)]
        read = self.spark.read.schema(LOG_SCHEMA)
        return read.parquet(*folders) if folders else self.spark.createDataFrame([], LOG_SCHEMA)

    def take(self, offers: DataFrame, now: Column, batch: str, limit: int | None = None) -> DataFrame:
        """``id, at, state, batch`` of the offers this batch takes, the weakest ``limit`` first."""
        name = f"taken-{batch}"
        if name not in finished(self.spark, self.path):
            found = due(offers, self.log(), now, **self.rules)
            if limit is not None:
                found = found.orderBy("confidence", "id").limit(limit)
            self._append(found.select("id"), now, F.lit(TAKEN), name, batch)
        return self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.path}/{name}")

    def report(self, results: DataFrame, now: Column, batch: str) -> None:
        """Log how a batch went; ``results``: id, ok. An id that has failed may be taken again."""
        name = f"result-{batch}"
        if name not in finished(self.spark, self.path):
            state = F.when(F.coalesce("ok", F.lit(False)), DONE).otherwise(FAILED)
            self._append(settle(results.select("id", "ok")), now, state, name, batch)

    def _append(self, rows: DataFrame, now: Column, state: Column, name: str, batch: str) -> None:
        rows.select(
            F.col("id").cast("string").alias("id"),
            now.cast("timestamp").alias("at"),
            state.alias("state"),
            F.lit(batch).alias("batch"),
        ).write.mode("overwrite").parquet(f"{self.path}/{name}")
