"""Merkle fixity audit of web archive replicas.

Records are hashed, and the records of each archive file are the leaves of a tree over ordered
offset ranges: a node of the lowest level covers ``leaf_bytes`` of the file's offsets, one of a
higher level ``fanout`` nodes below it. An audit compares the roots of two replicas and descends
only where nodes differ, down to the records in the ranges that differ.

Both replicas are read at the offsets of the archive's index, so a record of another length or a
missing one is found where it stands, and those after it still agree. Records that only the replica
has stand behind the file's end.

Nulls: a null key is a key, ordered first; null content is empty. Every row is a record: those with
one file and key stand in order of their hashes and are audited one by one, equal contents against
each other first. An empty table has no tree and no faults; files that only one replica has are
reported record by record. A file is bounded, as archive files are (rows without a key have to be
given files as well); a range of offsets holds few records, so no node's children grow with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.llm.store import Workspace

LEAF_BYTES, FANOUT = 64 * 1024, 16


def response_record(page_id: Column, url: Column, html: Column) -> Column:
    """A response record as text: header, blank line, HTTP message and the closing blank lines."""
    body = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"),
        F.coalesce(html, F.lit("")),
    )
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def digests(records: DataFrame) -> DataFrame:
    """``file, key, copy, length, sha256`` of ``records(file, key, record)``.

    ``copy`` numbers the rows of one file, key and content from 1.
    """
    content = F.coalesce("record", F.lit(""))
    return (
        records.groupBy(
            "file",
            "key",
            F.octet_length(content).cast("long").alias("length"),
            F.sha2(content, 256).alias("sha256"),
        )
        .agg(F.count("*").alias("_n"))
        .select(
            "file", "key", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("copy"),
            "length", "sha256",
        )
    )


_IN_ORDER = ["key", "sha256", "copy"]


def index(hashed: DataFrame) -> DataFrame:
    """Adds ``offset``: where each record of a file begins, in order of its key."""
    before = W.partitionBy("file").orderBy(*_IN_ORDER).rowsBetween(W.unboundedPreceding, -1)
    return hashed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def held(hashed: DataFrame, archive_index: DataFrame) -> DataFrame:
    """A replica's records at the offsets of the archive's index.

    Equal contents of one file and key meet first, the others in order of their hashes. What is
    left over on the replica's side is foreign and follows the file's end, its ``copy`` negative.
    """
    own = ["file", "key", "sha256", "copy", "length"]
    at = archive_index.select(*[F.col(c).alias(f"_{c}") for c in (*own, "offset")])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own])
    here, there = F.col("sha256").isNotNull(), F.col("_sha256").isNotNull()
    both = hashed.select(*own).join(at, same, "full").select(
        *[F.when(here, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in own],
        (here.cast("int") + there.cast("int") * 2).alias("_side"),
        F.when(there, F.struct("_offset", "_copy")).alias("_place"),
        (F.col("_offset") + F.col("_length")).alias("_after"),
    )
    nth = F.row_number().over(W.partitionBy("file", "key", "_side").orderBy("sha256", "copy"))
    met = W.partitionBy("file", "key", F.col("_side") == 3, "_nth")
    placed = both.withColumn("_nth", nth).withColumn(
        "_place", F.when(F.col("_side") == 3, F.col("_place")).otherwise(F.max("_place").over(met))
    )
    foreign = F.col("_place").isNull()
    earlier = (
        W.partitionBy("file", foreign).orderBy(*_IN_ORDER).rowsBetween(W.unboundedPreceding, -1)
    )
    end = F.coalesce(F.max("_after").over(W.partitionBy("file")), F.lit(0))
    behind = end + F.coalesce(F.sum("length").over(earlier), F.lit(0))
    return (
        placed.withColumn("offset", F.coalesce("_place._offset", behind))
        .withColumn("copy", F.coalesce("_place._copy", -F.col("copy")))
        .where(F.col("_side") != 2)
        .select("file", "key", "copy", "length", "sha256", "offset")
    )


class Tree:
    """The levels of a replica's trees, written to the shared folder."""

    def __init__(self, leaves: DataFrame, levels: int, space: Workspace, name: str) -> None:
        self.leaves = leaves
        child = F.struct("offset", "length", "sha256")
        ranged = leaves.withColumn("range", F.floor(F.col("offset") / LEAF_BYTES))
        nodes = self._hashed(ranged, child, "concat_ws(':', x.offset, x.length, x.sha256)")
        self.levels = [space.keep(nodes, f"{name}-0")]
        for level in range(1, levels):
            above = self.levels[-1].withColumn("child", F.col("range")).withColumn(
                "range", F.floor(F.col("range") / FANOUT)
            )
            nodes = self._hashed(
                above, F.struct("child", "hash"), "concat_ws(':', x.child, x.hash)"
            )
            self.levels.append(space.keep(nodes, f"{name}-{level}"))

    @staticmethod
    def _hashed(rows: DataFrame, child: Column, text: str) -> DataFrame:
        return (
            rows.groupBy("file", "range")
            .agg(F.array_sort(F.collect_list(child)).alias("children"))
            .select(
                "file",
                "range",
                F.sha2(F.array_join(F.expr(f"transform(children, x -> {text})"), "\n"), 256).alias(
                    "hash"
                ),
            )
        )


def _n_levels(*replicas: DataFrame) -> int:
    """Levels until every file has one root."""
    ends = [r.agg(F.max("offset")).first()[0] or 0 for r in replicas]
    ranges, levels = max(ends) // LEAF_BYTES, 1
    while ranges:
        ranges //= FANOUT
        levels += 1
    return levels


def _differing(ours: DataFrame, theirs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys on which two tables disagree, or that only one of them has."""
    other = theirs.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col(value).alias("_value"))
    same_key = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    )
    present = F.col(value).isNotNull()
    return (
        ours.select(*keys, value)
        .join(other, same_key, "full")
        .where(~F.col(value).eqNullSafe(F.col("_value")))
        .select(*[F.when(present, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in keys])
    )


def _below(rows: DataFrame, parents: DataFrame, wide: int) -> DataFrame:
    """Rows whose range lies in one of the parents' ranges."""
    up = parents.select(F.col("file").alias("_file"), F.col("range").alias("_range"))
    return rows.join(
        up,
        F.col("file").eqNullSafe(F.col("_file"))
        & (F.floor(F.col("range") / wide) == F.col("_range")),
        "left_semi",
    )


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Records of two indexed replicas that differ: ``file, offset, key, length, found, state``.

    ``length`` is what the first replica has, ``found`` what the second has; ``state`` is
    ``changed``, ``resized``, ``missing`` or ``extra``.
    """
    space = Workspace(ours.sparkSession, "fixity")
    ours, theirs = space.keep(ours, "ours"), space.keep(theirs, "theirs")
    levels = _n_levels(ours, theirs)
    a, b = Tree(ours, levels, space, "a"), Tree(theirs, levels, space, "b")
    keys = ["file", "range"]
    wrong = space.keep(_differing(a.levels[-1], b.levels[-1], keys, "hash"), "wrong-roots")
    for level in range(levels - 2, -1, -1):
        mine, other = (_below(t.levels[level], wrong, FANOUT) for t in (a, b))
        wrong = space.keep(_differing(mine, other, keys, "hash"), f"wrong-{level}")
    leaves = [
        _below(t.leaves.withColumn("range", F.floor(F.col("offset") / LEAF_BYTES)), wrong, 1)
        for t in (a, b)
    ]
    columns = ["file", "offset", "key", "copy", "length", "sha256"]
    mine = leaves[0].select(*columns)
    other = leaves[1].select(*[F.col(c).alias(f"_{c}") for c in columns])
    state = (
        F.when(F.col("_sha256").isNull(), "missing")
        .when(F.col("sha256").isNull(), "extra")
        .when(F.col("length") != F.col("_length"), "resized")
        .otherwise("changed")
    )
    has = F.col("sha256").isNotNull()
    return (
        mine.join(
            other,
            F.col("file").eqNullSafe(F.col("_file"))
            & (F.col("offset") == F.col("_offset"))
            & F.col("key").eqNullSafe(F.col("_key"))
            & (F.col("copy") == F.col("_copy")),
            "full",
        )
        .where(~F.col("sha256").eqNullSafe(F.col("_sha256")))
        .select(
            *[
                F.when(has, F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
                for c in ("file", "offset", "key")
            ],
            "length",
            F.col("_length").alias("found"),
            state.alias("state"),
        )
    )
