"""Mixing sources to target weights by Pareto order sampling.

Every source's target is a number of words. The whole multiples of the source's size within it are
certain: each document is taken that often. For the rest each document has an inclusion
probability, the remaining share, and is ranked by its random odds divided by its inclusion odds;
the documents first in that order are taken until the target's words are used up. The last gap, less
than one document, goes to the untaken document whose size is nearest to it.

The order is never sorted as a whole: sums per interval of the rank variable find the interval in
which the target is met, and only that interval's documents are ordered.

Nulls: a null text has size 0; a null source is a source of its own, last in order. Rows with equal
``doc_id`` are told apart by their text; identical rows are ranked side by side. An empty table
gives an empty result. Random numbers are a function of ``seed`` and ``doc_id``: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.llm.store import Workspace
from offerloom.llm.text import boxed, unboxed, words

#: Documents that an interval holds on average, and the most intervals of one source.
INTERVAL_DOCS, MOST_INTERVALS = 2_000, 1_000_000


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], most_copies: int) -> DataFrame:
    """Each source's target: shares of all words by weight, capped, the excess reshared.

    Sources in order of the ratio of cap to weight are capped first, so the capped ones are a
    prefix of that order, and one pass over the table of sources finds it. That table, a row per
    source, is the only thing ordered as a whole.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]),
        (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"),
    ).cast("long")
    ranked = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most_copies)
    )
    everything = W.partitionBy()
    order = everything.orderBy(
        F.col("cap").cast("double") / F.col("weight"), F.col("source").asc_nulls_last()
    )
    used = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    # What a unit of weight gets if this source and all after it are not capped. The first source
    # that is not capped has the largest such level of those that are not.
    level = (F.col("total") - used).cast("double") / open_weight.cast("double")
    is_capped = F.col("cap").cast("double") < F.col("level") * F.col("weight")
    return (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", level)
        .withColumn("capped", is_capped)
        .withColumn("shared", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
        .select(
            "source",
            "source_size",
            "n_docs",
            F.when(F.col("capped"), F.col("cap").cast("double"))
            .otherwise(F.col("shared") * F.col("weight"))
            .alias("target"),
        )
    )


def uniform(seed: int, key: Column) -> Column:
    """A number strictly between 0 and 1, fixed by ``seed`` and ``key``."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _with_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Join on the source, null with null."""
    other = per_source.withColumnRenamed("source", "_source")
    return rows.join(other, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most_copies: int = 3,
    seed: int = 7,
) -> DataFrame:
    """``doc_id, row_key, size, source, source_size, target, copies`` per row of ``docs``.

    ``copies`` says how often the mix takes the document, ``row_key`` is a hash of its text.
    """
    space = Workspace(docs.sparkSession, "mix")
    sizes = space.keep(
        docs.select(
            "doc_id",
            F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row_key"),
            F.monotonically_increasing_id().alias("row"),
            "source",
            word_count(F.col("text")).alias("size"),
        ),
        "sizes",
    )
    # A row per source, written: the planner knows its size and broadcasts it only if it is small.
    source_size = F.greatest(F.col("source_size"), F.lit(1))
    sources = space.keep(
        targets(sizes, weights, most_copies)
        .withColumn("certain", F.floor(F.col("target") / source_size).cast("long"))
        .withColumn("wanted", F.col("target") - F.col("certain") * F.col("source_size"))
        .withColumn("p", F.col("wanted") / source_size)
        .withColumn(
            "intervals",
            F.least(F.ceil(F.col("n_docs") / INTERVAL_DOCS).cast("long"), F.lit(MOST_INTERVALS)),
        ),
        "sources",
    )
    u = uniform(seed, F.col("doc_id"))
    odds = F.col("p") / F.greatest(1 - F.col("p"), F.lit(1e-15))
    q = F.when(F.col("p") > 0, u / (1 - u) / odds)
    share = F.coalesce(F.col("q") / (1 + F.col("q")), F.lit(1.0))
    placed = space.keep(
        _with_source(sizes, sources.select("source", "p", "intervals"))
        .withColumn("q", q)
        .withColumn("interval", F.floor(share * F.col("intervals")))
        .drop("p", "intervals"),
        "placed",
    )
    earlier = W.partitionBy("source").orderBy("interval").rowsBetween(W.unboundedPreceding, -1)
    sums = (
        placed.groupBy("source", "interval")
        .agg(F.sum("size").alias("words"))
        .withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    )
    met = space.keep(
        _with_source(sums, sources.select("source", "wanted"))
        .where(F.col("before") <= F.col("wanted"))
        .groupBy("source")
        .agg(F.max("interval").alias("met"), F.max("before").alias("before")),
        "met",
    )
    # The interval in which the wanted words are met, ordered.
    rank = F.struct(*rank_columns())
    upto = F.sum("size").over(
        W.partitionBy("source")
        .orderBy("q", "doc_id", "row_key", "row")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    inside = _with_source(
        _with_source(placed, met)
        .where((F.col("interval") == F.col("met")) & F.col("q").isNotNull())
        .withColumn("upto", F.col("before") + upto),
        sources.select("source", "wanted"),
    ).where(F.col("upto") <= F.col("wanted"))
    cuts = _with_source(
        met, inside.groupBy("source").agg(F.max(rank).alias("last"), F.max("upto").alias("upto"))
    )
    state = space.keep(
        _with_source(sources.drop("intervals", "n_docs"), cuts).withColumn(
            "gap", F.col("wanted") - F.coalesce("upto", "before", F.lit(0))
        ),
        "state",
    )
    in_order = F.col("q").isNotNull() & (
        (F.col("interval") < F.col("met"))
        | F.coalesce((F.col("interval") == F.col("met")) & (rank <= F.col("last")), F.lit(False))
    )
    marked = _with_source(placed, state).withColumn("in_order", in_order)
    miss = F.abs(F.col("size") - F.col("gap"))
    closing = space.keep(
        marked.where(~F.col("in_order") & F.col("q").isNotNull() & (miss < F.col("gap")))
        .groupBy("source")
        .agg(F.min(F.struct(miss.alias("miss"), *rank_columns())).alias("closing")),
        "closing",
    )
    closes = F.coalesce(F.col("closing.row") == F.col("row"), F.lit(False))
    return _with_source(marked, closing).select(
        "doc_id",
        "row_key",
        "size",
        "source",
        "source_size",
        "target",
        (F.col("certain") + (F.col("in_order") | closes).cast("long")).alias("copies"),
    )


def rank_columns() -> list[Column]:
    return [F.col(c) for c in ("q", "doc_id", "row_key", "row")]


def mixed_rows(docs: DataFrame, **settings: object) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the same columns."""
    taken = (
        mix(docs, **settings)
        .where(F.col("copies") > 0)
        .groupBy("doc_id", "row_key")
        .agg(F.sum("copies").alias("_copies"))
        .select(F.col("doc_id").alias("_doc_id"), F.col("row_key").alias("_row_key"), "_copies")
    )
    rows, box = boxed(docs)
    key = F.xxhash64(F.coalesce(F.col(f"{box}.text"), F.lit("")))
    return (
        rows.withColumns({"_id": F.col(f"{box}.doc_id"), "_key": key})
        .dropDuplicates(["_id", "_key"])
        .join(
            taken,
            F.col("_id").eqNullSafe(F.col("_doc_id")) & (F.col("_key") == F.col("_row_key")),
        )
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
        .select(*unboxed(box, docs.columns))
    )
