"""Chat formatting of logged conversations without their earlier snapshots.

A log that writes a conversation again after each exchange holds every prefix of it. Each turn is
hashed with its place, and the running combination of these hashes names each prefix. A conversation
whose whole is a proper prefix of another is removed by an anti-join with all proper prefixes; of
equal conversations the smallest ``conv_id`` stays. Only what stays is rendered.

Nulls: turns without ``conv_id`` belong to no conversation and are left out; a null role or text is
empty. Turns are ordered by ``turn``, nulls first, then role and text; equal rows count once. An
empty table gives an empty result; further columns are ignored. A rendered conversation is one
string, so one conversation is one group; copies and common beginnings, however many, are combined
before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.llm.text import hash_pair

TURN = "<|{role}|>\n{text}<|end|>\n"


def _clean(turns: DataFrame) -> DataFrame:
    return turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, place, n_turns, _h1, _h2``: a name for the first ``place`` turns of each."""
    # Order by the text itself needs no text: equal rows are merged, others differ in their hashes.
    rows = (
        _clean(turns)
        .select("conv_id", "turn", "role", "text")
        .groupBy("conv_id", "turn", "role", F.xxhash64("text").alias("_text"))
        .agg(F.min("text").alias("text"))
    )
    in_order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.withColumn("place", F.row_number().over(in_order))
    own = hash_pair(F.col("place"), F.col("role"), F.col("text"))
    hashed = placed.select("conv_id", "place", own[0].alias("_t1"), own[1].alias("_t2"))
    upto = (
        W.partitionBy("conv_id").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return hashed.select(
        "conv_id",
        "place",
        F.count("*").over(W.partitionBy("conv_id")).alias("n_turns"),
        F.bit_xor("_t1").over(upto).alias("_h1"),
        F.bit_xor("_t2").over(upto).alias("_h2"),
    )


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns`` of the conversations that are a prefix of no other."""
    named = prefixes(turns)
    whole = (
        named.where("place = n_turns")
        .groupBy("n_turns", "_h1", "_h2")
        .agg(F.min("conv_id").alias("conv_id"))
    )
    shorter = (
        named.where("place < n_turns").select(F.col("place").alias("n_turns"), "_h1", "_h2").distinct()
    )
    return whole.join(shorter, ["n_turns", "_h1", "_h2"], "left_anti").select("conv_id", "n_turns")


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, chat``: every maximal conversation as one marked-up string."""
    kept = maximal(turns)
    turn = F.concat(
        F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>\n")
    )
    own = F.struct("turn", "role", "text", turn.alias("rendered"))
    return (
        _clean(turns)
        .join(kept, "conv_id")
        .groupBy("conv_id", "n_turns")
        .agg(F.array_sort(F.collect_set(own)).alias("turns"))
        .select(
            "conv_id",
            F.col("n_turns").cast("long").alias("n_turns"),
            F.array_join(F.col("turns.rendered"), "").alias("chat"),
        )
    )
