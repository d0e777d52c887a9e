"""Document fingerprints by winnowing.

Every run of ``k`` bytes of the UTF-8 text is hashed. In each window of ``w`` consecutive hashes the
smallest is chosen, the rightmost of equals, and kept with its position. Two texts that share
``w + k - 1`` bytes or more share a chosen hash, and no hash of fewer than ``k`` is ever compared.

A hash is the complement of ``xxhash64`` of the bytes. A window's numbers are the complements of the
hashes with the position in place of the low bits, so that their largest is the smallest hash
furthest right. The text is handled in stretches of ``STRETCH`` bytes that overlap by ``w + k - 2``:
a long text needs no long arrays but the one of its chosen hashes, each a number of 32 bits of hash
above 31 bits of position.

Null and empty texts have no hashes. A text with fewer than ``k`` bytes has the hash of its whole;
one with fewer than ``w`` hashes has the smallest of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.llm.text import hash_pair, whole

K, WINDOW = 12, 8
STRETCH = 256
#: Bits of a number that hold the position within a stretch and what overlaps it.
_PLACE_BITS = 9
_PLACE = (1 << _PLACE_BITS) - 1
_EMPTY = "array<bigint>"
#: Ranges of ids that the search for a document's neighbour is split into: rows each, and the most.
SLICE_ROWS, MOST_SLICES = 500, 65_536


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _none() -> Column:
    return F.array().cast(_EMPTY)


def _numbers(stretch: Column, k: int) -> Column:
    """A number for each ``k``-gram of a short binary, counted from 1."""
    return F.transform(
        F.sequence(F.lit(1), F.octet_length(stretch) - (k - 1)),
        lambda i: F.xxhash64(F.substring(stretch, i, F.lit(k)))
        .bitwiseAND(F.lit(~_PLACE))
        .bitwiseOR(i),
    )


def _placed(numbers: Column, first: Column) -> Column:
    """Chosen numbers with 32 bits of hash and the position in the whole text."""

    def number(x: Column) -> Column:
        high = F.shiftrightunsigned(F.bitwise_not(x), 32)
        return F.shiftleft(high, 31) + (x.bitwiseAND(F.lit(_PLACE)) + (first - 1))

    return F.transform(numbers, number)


def _pairs(numbers: Column, step: int) -> Column:
    """The larger of each number and the one ``step`` further."""

    def pairs(x: Column) -> Column:
        n = F.size(x) - step
        return F.zip_with(F.slice(x, 1, n), F.slice(x, 1 + step, n), lambda a, b: F.greatest(a, b))

    return _let(numbers, pairs)


def _chosen(numbers: Column, w: int) -> Column:
    """The largest number of every window of ``w``, doubling the window as long as it fits."""
    width = 1
    while width < w:
        step = min(width, w - width)
        numbers = _pairs(numbers, step)
        width += step
    return numbers


def winnow(data: Column, k: int = K, w: int = WINDOW) -> Column:
    """The chosen numbers of a binary that is not null, in the order of their positions."""
    reach = w + k - 2
    if not 1 < w or not 1 < k or STRETCH + reach > _PLACE:
        raise ValueError(f"w and k are at least 2, and together at most {_PLACE - STRETCH + 2}")
    n = F.octet_length(data)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(STRETCH))
    stretches = F.transform(
        starts, lambda i: F.substring(data, i + 1, F.lit(STRETCH + reach))
    )
    chosen = F.transform(
        stretches,
        lambda s, j: F.when(
            F.octet_length(s) > reach,
            _placed(F.array_distinct(_chosen(_numbers(s, k), w)), j.cast("long") * STRETCH),
        ).otherwise(_none()),
    )
    zero = F.lit(0).cast("long")
    whole_text = F.array(F.xxhash64(data).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(F.lit(1)))
    short = F.when(n >= k, F.array(F.array_max(_numbers(data, k)))).otherwise(whole_text)
    return (
        F.when(n == 0, _none())
        .when(n <= reach, _placed(short, zero))
        .otherwise(F.array_distinct(F.flatten(chosen)))
    )


def position(number: Column) -> Column:
    return number.bitwiseAND(F.lit((1 << 31) - 1))


def hashes(numbers: Column) -> Column:
    """The set of hashes without their positions."""
    return F.array_distinct(F.transform(numbers, lambda x: F.shiftright(x, 31)))


def digest(numbers: Column) -> Column:
    """One string for the chosen hashes and their positions; empty for none."""
    both = [F.lpad(F.hex(h), 16, "0") for h in hash_pair(numbers)]
    return F.when(F.size(numbers) == 0, "").otherwise(F.lower(F.concat(*both)))


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two sets of hashes: 1 for equal ones, two empty ones included."""
    union = F.size(a) + F.size(b) - F.size(F.array_intersect(a, b))
    return F.when(union == 0, 1.0).otherwise(
        F.size(F.array_intersect(a, b)).cast("double") / union
    )


def _slice_of(id_: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``id_``, by halving."""
    if not cuts:
        return F.lit(0)
    values = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = [1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(cuts))
            & (F.get(values, F.least(at + step, F.lit(len(cuts))) - 1) <= id_),
            at + step,
        ).otherwise(at),
    )


def with_next(docs: DataFrame, prepare: Callable[[DataFrame], DataFrame], carried: list[str]) -> DataFrame:
    """Each document beside the next by descending ``doc_id``; the last one's next is the first.

    Ids are cut into ranges of about ``SLICE_ROWS`` rows, each ordered by itself, and each range's
    first document is added once more at the end of the range before it. ``prepare`` adds columns
    after rows are dealt out, so that they are not shuffled; ``carried`` are the columns taken from
    the next document, as a struct ``_next``. Null ids come last; equal ids are ordered by text.
    """
    keyed = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    n = keyed.count()
    parts = max(1, min(MOST_SLICES, n // SLICE_ROWS))
    cuts: list[int] = []
    if parts > 1:
        points = [i / parts for i in range(1, parts)]
        found = keyed.agg(F.percentile_approx("_id", points, 10 * MOST_SLICES)).first()[0]
        cuts = sorted(set(found))
    keyed = keyed.withColumn("_slice", _slice_of(F.col("_id"), cuts))
    by_slice = W.orderBy("_slice")
    # At most MOST_SLICES rows.
    tops = (
        keyed.groupBy("_slice")
        .agg(F.max("_id").alias("_top"))
        .select(
            "_top",
            F.coalesce(
                F.lead("_slice").over(by_slice), F.min("_slice").over(W.partitionBy())
            ).alias("_before"),
        )
    )
    own = F.struct(F.col("_slice").alias("at"), F.lit(False).alias("again"))
    again = F.struct(F.col("_before").alias("at"), F.lit(True).alias("again"))
    places = F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, again))
    dealt = (
        keyed.join(F.broadcast(tops), F.col("_id") == F.col("_top"), "left")
        .withColumn("_place", F.explode(places))
        .withColumns({"_at": F.col("_place.at"), "_again": F.col("_place.again")})
        .drop("_top", "_before", "_place", "_slice")
        .repartition("_at")
    )
    order = W.partitionBy("_at").orderBy(
        "_again", F.col("_id").desc(), F.xxhash64("text")
    )
    return (
        prepare(dealt)
        .withColumn("_next", F.lead(F.struct(*carried)).over(order))
        .where(~F.col("_again"))
        .drop("_at", "_again", "_id")
    )


def compare_with_edit(docs: DataFrame, k: int = K, w: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they and the next are.

    The edited text has its last third, rounded down, replaced by as many first code points of the
    next document. Hashes before the edit are those of the text itself; only windows that the edit
    can reach are computed again.
    """
    def prepare(rows: DataFrame) -> DataFrame:
        text = whole(F.col("text"))
        return (
            rows.select("doc_id", "_id", "_at", "_again", text.alias("text"))
            .withColumn("chosen", winnow(F.col("text").cast("binary"), k, w))
            .withColumn("hashes", hashes(F.col("chosen")))
        )

    n = F.length("text")
    same = F.left("text", n - F.floor(n / 3).cast("int"))
    # The first hash that a changed window can choose, and where the part to compute again begins.
    changed = F.greatest(F.octet_length("same") - (k + w - 2), F.lit(0))
    again = F.greatest(F.col("changed") - (w - 1), F.lit(0))
    tail = F.substring(F.col("edited").cast("binary"), F.col("again") + 1, F.octet_length("edited"))
    rows = (
        with_next(docs.select("doc_id", "text"), prepare, ["text", "hashes"])
        .withColumn("same", same)
        .withColumn("changed", changed)
        .withColumn("again", again)
        .withColumn(
            "edited",
            F.concat("same", F.left(F.col("_next.text"), (n - F.length("same")).cast("int"))),
        )
        .withColumn("tail", winnow(tail, k, w))
    )
    before = F.filter("chosen", lambda x: position(x) < F.col("changed"))
    after = F.filter(
        F.transform("tail", lambda x: x + F.col("again")),
        lambda x: position(x) >= F.col("changed"),
    )
    return (
        rows.withColumn("edited_chosen", F.concat(before, after))
        .withColumn("edited_hashes", hashes(F.col("edited_chosen")))
        .select(
            "doc_id",
            n.cast("long").alias("n_chars"),
            "edited",
            "chosen",
            "edited_chosen",
            likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
            likeness(F.col("hashes"), F.col("_next.hashes")).alias("near_next"),
        )
    )
