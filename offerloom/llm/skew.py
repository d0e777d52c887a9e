"""Joins of many rows with one row per key where a key may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of all rows, so that at most as many keys are.
HOT_SHARE = 10_000
#: No key with fewer rows is worth splitting.
LEAST_HOT = 1_000


def spread_join(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    size: str,
    salt: Column,
    how: str = "inner",
) -> DataFrame:
    """Join ``rows`` with ``per_key``, which has one row per key and the key's row count ``size``.

    Keys above ``total / HOT_SHARE`` rows are cut into parts of that many rows and their single row
    is copied to each part. At most ``HOT_SHARE`` keys can be so large, whatever the input, which
    bounds the broadcast list of them. ``salt`` is a hash that spreads the rows of one key.
    """
    keys = list(keys)
    total = per_key.agg(F.sum(size)).first()[0] or 0
    part_rows = max(LEAST_HOT, total // HOT_SHARE)
    parts = F.ceil(F.col(size) / F.lit(part_rows)).cast("int")
    hot = per_key.where(F.col(size) > part_rows).select(*keys, parts.alias("_parts"))
    salted = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.pmod(salt, F.coalesce("_parts", F.lit(1))).cast("int"))
        .drop("_parts")
    )
    copied = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    if how == "left_semi":
        copied = copied.select(*keys, "_salt")
    return salted.join(copied, [*keys, "_salt"], how).drop("_salt")
