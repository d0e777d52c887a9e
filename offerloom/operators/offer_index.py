"""The offer index: one document per id, latest version wins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from offerloom.operators.ranking import first_by
from offerloom.operators.settling import finished, settle


def document_id(domain: Column, url: Column) -> Column:
    """Stable id: the shop and a 64-bit hash of the URL."""
    return F.concat_ws("_", domain, F.lower(F.hex(F.xxhash64(url))))


def upsert(index: DataFrame, changes: DataFrame) -> DataFrame:
    """Index after taking in changed documents: the newest version of each id.

    Equal times go to the change. Applying the same changes twice changes nothing.
    """
    both = index.withColumn("_new", F.lit(0)).unionByName(
        changes.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    return first_by(both, ["id"], [F.desc("updated_at"), F.desc("_new")]).drop("_new")


def delete(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Index without the documents of vanished pages."""
    return index.join(ids.select("id"), "id", "left_anti")


def offers_to_documents(offers: DataFrame, updated_at: Column) -> DataFrame:
    """Index documents of collected offers (prices in kopecks)."""
    return offers.select(
        document_id(F.col("source_domain"), F.col("product_url")).alias("id"),
        F.col("product_url").alias("url"),
        F.col("source_domain").alias("domain"),
        "title",
        F.col("category") if "category" in offers.columns else F.lit("unknown").alias("category"),
        "image_url",
        F.col("price").alias("last_price"),
        F.array().cast("array<string>").alias("keywords"),
        "confidence",
        updated_at.alias("updated_at"),
    )


_BUCKET = "bucket"


def bucketed(documents: DataFrame, buckets: int = 512) -> DataFrame:
    """Add the storage bucket: a change rewrites only the buckets it falls into."""
    return documents.withColumn(
        _BUCKET, F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    )


def write_upsert(
    spark, path: str, changes: DataFrame, target: str, buckets: int = 512
) -> None:
    """Write the next version of the index at ``path`` to ``target``.

    A new folder is written and nothing is overwritten in place, so a lost executor or a
    retry never leaves a half-written index behind.
    """
    index = spark.read.parquet(path).drop(_BUCKET)
    merged = upsert(index, changes)
    bucketed(merged, buckets).write.mode("errorifexists").partitionBy(_BUCKET).parquet(target)


class VersionedIndex:
    """The index in a folder where a change rewrites only the buckets it falls into.

    ``data/<version>/bucket=<n>`` holds a bucket as a version left it, ``versions/<nth>`` says for every
    bucket which version wrote it last. A version is seen once its list is complete: readers and
    a lost driver find the one before. One writer at a time. ``buckets`` is fixed by the first version;
    a bucket should hold what one executor merges at a time.
    """

    def __init__(self, spark, path: str, buckets: int = 512) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _latest(self) -> tuple[int, int, dict[int, str], StructType | None]:
        """Number of the newest version, buckets, folder of each bucket (at most ``buckets``), schema."""
        names = finished(self.spark, f"{self.path}/versions")
        if not names:
            return 0, self.buckets, {}, None
        listed = self.spark.read.parquet(f"{self.path}/versions/{names[-1]}").collect()
        head = next(r for r in listed if r["bucket"] < 0)
        places = {r["bucket"]: r["folder"] for r in listed if r["bucket"] >= 0}
        return int(names[-1]), -head["bucket"], places, StructType.fromDDL(head["folder"])

    def _read(self, folders: list[str], schema: StructType) -> DataFrame:
        read = self.spark.read.schema(schema)
        paths = [f"{self.path}/{folder}" for folder in folders]
        return read.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def documents(self) -> DataFrame | None:
        """All documents of the newest version, None before the first one."""
        _, _, places, schema = self._latest()
        return None if schema is None else self._read(list(places.values()), schema)

    def apply(self, changes: DataFrame, vanished: DataFrame | None = None) -> list[int]:
        """Take in changed documents, then drop the ids of ``vanished``; returns the buckets rewritten.

        Applying the same changes twice changes no document. Rows without an id are left out.
        """
        nth, buckets, places, schema = self._latest()
        changes = settle(changes.where(F.col("id").isNotNull()))
        touching = changes.select("id")
        if vanished is not None:
            vanished = settle(vanished.select("id").where(F.col("id").isNotNull()))
            touching = touching.union(vanished)
        rows = bucketed(touching, buckets).select(_BUCKET).distinct().collect()
        touched = sorted(r[_BUCKET] for r in rows)
        if schema is None:
            schema = changes.schema
        before = self._read([places[b] for b in touched if b in places], schema)
        merged = upsert(before, changes)
        if vanished is not None:
            merged = delete(merged, vanished)
        folder = f"data/{uuid.uuid4().hex}"
        # Rows of a bucket come together, large buckets in several files.
        together = bucketed(merged, buckets).hint("rebalance", _BUCKET)
        together.write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(f"id string, {_BUCKET} int").parquet(f"{self.path}/{folder}")
        left = [r[_BUCKET] for r in written.select(_BUCKET).distinct().collect()]
        places = {b: place for b, place in places.items() if b not in set(touched)}
        places |= {b: f"{folder}/{_BUCKET}={b}" for b in left}
        listed = [(-buckets, merged.schema.toDDL()), *sorted(places.items())]
        self.spark.createDataFrame(listed, f"{_BUCKET} int, folder string").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{self.path}/versions/{nth + 1:012d}")
        return touched
