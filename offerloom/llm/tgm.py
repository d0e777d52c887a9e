"""Exact Jaccard self-join of word shingle sets through a token-group matrix.

Documents with equal sets are one class. Classes are partitioned into groups of similar ones: each
joins the group of a class it is verified to be linked with. The matrix holds each group's union of
tokens as a bitmap of hash columns. A class is compared with a group only if they share a token
among those that any link must show, the bitmaps allow an overlap as large as a link needs, and the
two are not yet in one component; only such a group is opened and its members compared exactly.

Tokens that a link must show: of a set of ``n`` tokens in an order common to all sets, the first
``n - ceil(t n) + 1``. The order puts rare tokens first, by a sketch of ``SKETCH`` counters; any
order is exact, this one keeps tokens that very many sets share out of the comparison. No bucket,
group or list of candidates is cut.

Nulls: a null or empty text, or one without words, has no set, is linked with nothing and is its own
component. A null ``doc_id`` takes part, but never names a component unless all its ids are null.
Rows of one ``doc_id`` are compared by their texts. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.components import components
from offerloom.llm.shingles import bitmap, fold, most_shared, overlap, shingle_set
from offerloom.llm.skew import spread_join
from offerloom.llm.store import Workspace, modest_batches
from offerloom.llm.text import boxed, unboxed

#: Counters of the token sketch, and the parts it is summed in. Its size does not grow.
SKETCH, SKETCH_PARTS = 1 << 20, 64
#: Places of the filter that says which texts are read again to be compared.
FILTER_LOG = 24
FILTER_BITS = 1 << FILTER_LOG
#: A group's bitmap is made of the members of one part, so many on average.
GROUP_PART = 256
#: Tables that nothing reads once all links are known.
_PASSING = (
    *("shared", "posts", "live", "grouped", "sizes", "members", "placed", "mixed", "rows"),
    *("pairs", "matrix"),
    *(f"{step}-{name}" for step in ("stars", "opened") for name in ("possible", "wanted", "sets")),
)
_MASK = np.uint64(SKETCH - 1)
_NO_ID = 2**63 - 1


def _least_overlap(n: int, percent: int) -> int:
    """The smallest overlap that a set of ``n`` needs for a link."""
    return -(-percent * n // 100)


def _sketch(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, dtype=np.uint32)
        waiting, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                waiting.append(shingle_set(text.as_py(), k) & _MASK)
                size += len(waiting[-1])
                if size >= SKETCH:
                    counts += _counted(waiting)
                    waiting, size = [], 0
        if waiting:
            counts += _counted(waiting)
        parts = counts.reshape(SKETCH_PARTS, -1)
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array(range(SKETCH_PARTS), pa.int32()),
                "counts": pa.array([p.tobytes() for p in parts], pa.binary()),
            }
        )

    return run


def _counted(sets: list[np.ndarray]) -> np.ndarray:
    return np.bincount(np.concatenate(sets).astype(np.int64), minlength=SKETCH).astype(np.uint32)


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums what one task reads: at most one row for each part goes on."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(counts.as_py(), dtype=np.uint32)
            sums[part] = sums[part] + own if part in sums else own
    yield pa.RecordBatch.from_pydict(
        {
            "part": pa.array(list(sums), pa.int32()),
            "counts": pa.array([s.tobytes() for s in sums.values()], pa.binary()),
        }
    )


def token_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How many sets hold a token of each counter, summed over all documents."""
    schema = "part int, counts binary"
    rows = (
        docs.select("text")
        .mapInArrow(_sketch(k), schema)
        .repartition(SKETCH_PARTS, "part")
        .mapInArrow(_sum_parts, schema)
        .collect()
    )
    out = np.zeros((SKETCH_PARTS, SKETCH // SKETCH_PARTS), dtype=np.uint32)
    for row in rows:
        out[row["part"]] += np.frombuffer(row["counts"], dtype=np.uint32)
    return out.reshape(-1)


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS, dtype=bool)
    for batch in batches:
        bits[_places(batch.column(0))] = True
    parts = np.packbits(bits).reshape(SKETCH_PARTS, -1)
    used = [k for k in range(SKETCH_PARTS) if parts[k].any()]
    yield pa.RecordBatch.from_pydict(
        {
            "part": pa.array(used, pa.int32()),
            "bits": pa.array([parts[k].tobytes() for k in used], pa.binary()),
        }
    )


def _or_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins what one task reads: at most one row for each part goes on."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, bits in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(bits.as_py(), dtype=np.uint8)
            found[part] = found[part] | own if part in found else own
    yield pa.RecordBatch.from_pydict(
        {
            "part": pa.array(list(found), pa.int32()),
            "bits": pa.array([b.tobytes() for b in found.values()], pa.binary()),
        }
    )


def _places(ids: pa.Array) -> np.ndarray:
    """Places of ids in the filter; null as the id that stands for none."""
    values = ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.uint64)
    return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_LOG)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """Which places the ids of a one-column table take. Its size does not grow; a place can stand
    for more than one id, so what passes is a superset."""
    schema = "part int, bits binary"
    rows = (
        ids.mapInArrow(_bits_of, schema)
        .repartition(SKETCH_PARTS, "part")
        .mapInArrow(_or_parts, schema)
        .collect()
    )
    out = np.zeros((SKETCH_PARTS, FILTER_BITS // SKETCH_PARTS // 8), dtype=np.uint8)
    for row in rows:
        out[row["part"]] |= np.frombuffer(row["bits"], dtype=np.uint8)
    return np.unpackbits(out.reshape(-1)).astype(bool)


_MARKS = (
    "doc_id long, text_hash long, n int, digest binary, shown array<long>, bits binary"
)


def _marks(k: int, percent: int, sketch: np.ndarray) -> Callable:
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("text_hash", pa.int64()),
            ("n", pa.int32()),
            ("digest", pa.binary()),
            ("shown", pa.list_(pa.int64())),
            ("bits", pa.binary()),
        ]
    )

    def row(doc_id: int | None, text: str | None, text_hash: int) -> tuple:
        tokens = shingle_set(text, k)
        n = len(tokens)
        if not n:
            return doc_id, text_hash, 0, None, [], None
        common = sketch[(tokens & _MASK).astype(np.int64)]
        first = np.lexsort((tokens, common))[: n - _least_overlap(n, percent) + 1]
        digest = hashlib.md5(tokens.tobytes(), usedforsecurity=False).digest()
        return doc_id, text_hash, n, digest, tokens[first].astype(np.int64), bitmap(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [
                    row(d, t.as_py(), h)
                    for d, t, h in zip(
                        part.column(0).to_pylist(),
                        part.column(1),
                        part.column(2).to_pylist(),
                        strict=True,
                    )
                ]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
                    schema=schema,
                )

    return run


def _sets(k: int, packed: bytes) -> Callable:
    """Sets of the documents whose id passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(packed, dtype=np.uint8)).astype(bool)
        for batch in batches:
            chosen = batch.filter(pa.array(wanted[_places(batch.column(0))]))
            for at in range(0, chosen.num_rows, 1024):
                sets = [shingle_set(t.as_py(), k) for t in chosen.column(1).slice(at, 1024)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "digest": pa.array(
                            [hashlib.md5(s.tobytes(), usedforsecurity=False).digest() for s in sets],
                            pa.binary(),
                        ),
                        "tokens": pa.array([s.tobytes() for s in sets], pa.binary()),
                    }
                )

    return run


def _kept(batch: pa.RecordBatch, keep: list[bool], n_columns: int) -> pa.RecordBatch:
    return batch.filter(pa.array(keep, pa.bool_())).select(range(n_columns))


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps rows ``a, b, a_n, need, a_bits, b_bits`` in which ``b`` may hold enough of ``a``."""
    for batch in batches:
        n, need = (batch.column(i).to_pylist() for i in (2, 3))
        bits = zip(batch.column(4), batch.column(5), strict=True)
        keep = [
            most_shared(x, a.as_py(), b.as_py()) >= y
            for x, y, (a, b) in zip(n, need, bits, strict=True)
        ]
        yield _kept(batch, keep, 2)


def _linked(percent: int) -> Callable:
    """Keeps rows ``a, b, a_tokens, b_tokens`` whose sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a = np.frombuffer(x.as_py(), dtype=np.uint64)
                b = np.frombuffer(y.as_py(), dtype=np.uint64)
                shared = overlap(a, b)
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield _kept(batch, keep, 2)

    return run


def _union_bits(key: tuple, table: pa.Table) -> pa.Table:
    """One matrix row: the columns that any member of a group's part has."""
    bits = [b.as_py() for b in table.column("bits")]
    size = max(map(len, bits))
    union = np.zeros(size, dtype=np.uint8)
    for b in bits:
        own = fold(b, size)
        # A smaller member's columns stand for several wider ones.
        union |= np.tile(own, size // len(own))
    return pa.table(
        {
            "group": [key[0].as_py()],
            "part": pa.array([key[1].as_py()], pa.int32()),
            "low": pa.array([min(table.column("n").to_pylist())], pa.int32()),
            "bits": pa.array([union.tobytes()], pa.binary()),
        }
    )


class _Join:
    def __init__(self, docs: DataFrame, k: int, percent: int) -> None:
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.k, self.percent = k, percent
        modest_batches(docs.sparkSession)
        self.space = Workspace(docs.sparkSession, "tgm")

    def _similar_size(self, a: str, b: str) -> Column:
        return (F.col(a) * 100 >= F.col(b) * self.percent) & (
            F.col(b) * 100 >= F.col(a) * self.percent
        )

    def _reach(self, n: str, at: str, other: str, other_at: str) -> Column:
        """Whether sets that first meet at these places of theirs can share enough."""
        left = F.least(F.col(n) - F.col(at), F.col(other) - F.col(other_at))
        return left * (100 + self.percent) >= (F.col(n) + F.col(other)) * self.percent

    def _need(self, n: str, other: str) -> Column:
        """What sets of these sizes share at least if they are linked."""
        together = (F.col(n) + F.col(other)).cast("long")
        whole = 100 + self.percent
        return F.floor((together * self.percent + whole - 1) / whole).cast("int").alias("need")

    def _sides(self, pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
        """``pairs(a, b)`` with the columns of both nodes, as ``a_...`` and ``b_...``."""
        for side in ("a", "b"):
            own = table.select(
                F.col("node").alias(f"_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in columns]
            )
            pairs = pairs.join(own, F.col(side) == F.col(f"_{side}")).drop(f"_{side}")
        return pairs

    def verified(self, pairs: DataFrame, classes: DataFrame, name: str) -> DataFrame:
        """The linked ones of ``pairs(a, b)``: by size, by bitmap, then exactly."""
        sized = self._sides(pairs, classes, ["n", "bits"]).where(self._similar_size("a_n", "b_n"))
        possible = self.space.keep(
            sized.select(
                "a", "b", "a_n", self._need("a_n", "b_n"), "a_bits", "b_bits"
            ).mapInArrow(_may_link, "a long, b long"),
            f"{name}-possible",
        )
        nodes = possible.select(F.col("a").alias("node")).union(possible.select("b")).distinct()
        wanted = self.space.keep(
            classes.select("node", "digest", "label").join(nodes, "node", "left_semi"),
            f"{name}-wanted",
        )
        packed = np.packbits(id_filter(wanted.select("label"))).tobytes()
        sets = self.space.keep(
            self.docs.mapInArrow(_sets(self.k, packed), "digest binary, tokens binary")
            .join(wanted.select("node", "digest"), "digest")
            .select("node", "tokens"),
            f"{name}-sets",
        )
        return self.space.keep(
            self._sides(possible, sets, ["tokens"])
            .select("a", "b", "a_tokens", "b_tokens")
            .mapInArrow(_linked(self.percent), "a long, b long"),
            f"{name}-links",
        )

    def run(self) -> tuple[DataFrame, DataFrame]:
        """All rows ``doc_id, text_hash, n, digest``, and ``digest, component, component_id`` of
        each set. Rows without words have no set."""
        sketch = token_sketch(self.docs, self.k)
        marks = self.space.keep(
            self.docs.withColumn("_h", _text_hash(F.col("text"))).mapInArrow(
                _marks(self.k, self.percent, sketch), _MARKS
            ),
            "marks",
        )
        label = F.min(F.coalesce("doc_id", F.lit(_NO_ID)))
        classes = self.space.keep(
            marks.where("n > 0")
            .groupBy("digest")
            .agg(
                label.alias("label"),
                F.first("n").alias("n"),
                F.first("shown").alias("shown"),
                F.first("bits").alias("bits"),
            )
            .withColumn("node", F.monotonically_increasing_id()),
            "classes",
        )
        posted = classes.select("node", "n", F.posexplode("shown").alias("at", "token"))
        # A token's leader has the fewest rarer tokens: of near copies, the one least changed.
        shared = self.space.keep(
            posted.groupBy("token")
            .agg(F.count("*").alias("held"), F.min(F.struct("at", "node", "n")).alias("leader"))
            .where("held > 1"),
            "shared",
        )
        posts = self.space.keep(
            spread_join(posted, shared, ["token"], "held", F.xxhash64("node")), "posts"
        )
        live = posts.select("node").distinct()
        classes_asked = self.space.keep(
            classes.select("node", "n", "bits", "digest", "label").join(live, "node"), "live"
        )
        linked = self._group_links(posts, classes_asked)
        first = components(linked, self.space, "first")
        members = self._members(classes_asked, linked, first)
        opened = self._open_groups(posts, members, classes_asked)
        final = components(linked.union(opened), self.space, "final")
        for name in _PASSING:
            self.space.drop(name)
        return marks.select("doc_id", "text_hash", "n", "digest"), self._named(classes, final)

    def _group_links(self, posts: DataFrame, classes: DataFrame) -> DataFrame:
        """Links with the leader of each shared token: what groups are made from."""
        near = posts.where("node <> leader.node").where(
            self._reach("n", "at", "leader.n", "leader.at")
        )
        pairs = near.select(F.col("node").alias("a"), F.col("leader.node").alias("b"))
        return self.verified(pairs.distinct(), classes, "stars")

    def _members(self, classes: DataFrame, linked: DataFrame, first: DataFrame) -> DataFrame:
        """Each class with its group, the group's part and its component so far."""
        chosen = linked.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("group"))
        grouped = (
            classes.select("node", "n")
            .join(chosen, "node", "left")
            .withColumn("group", F.coalesce("group", "node"))
            .join(first, "node", "left")
            .withColumn("component", F.coalesce("component", "node"))
        )
        grouped = self.space.keep(grouped, "grouped")
        sizes = self.space.keep(
            grouped.groupBy("group").agg(F.count("*").alias("size")).where("size > 1"), "sizes"
        )
        large = spread_join(
            grouped, sizes, ["group"], "size", F.xxhash64("node")
        ).withColumn(
            "part",
            F.pmod(
                F.xxhash64("node"), F.ceil(F.col("size") / GROUP_PART).cast("long")
            ).cast("int"),
        )
        single = grouped.join(large.select("node"), "node", "left_anti")
        return self.space.keep(
            large.select("node", "n", "group", "component", "part").unionByName(
                single.select("node", "n", "group", "component", F.lit(0).alias("part"))
            ),
            "members",
        )

    def _open_groups(
        self, posts: DataFrame, members: DataFrame, classes: DataFrame
    ) -> DataFrame:
        """Links between components: groups that may hold one are opened."""
        placed = self.space.keep(
            posts.select("token", "node", "at").join(members, "node"), "placed"
        )
        mixed = self.space.keep(
            placed.groupBy("token")
            .agg(
                F.min("component").alias("_low"),
                F.max("component").alias("_high"),
                F.count("*").alias("held"),
            )
            .where("_low < _high")
            .select("token", "held"),
            "mixed",
        )
        rows = self.space.keep(
            spread_join(placed, mixed, ["token"], "held", F.xxhash64("node")), "rows"
        )
        p = self.percent
        slack = (F.col("n") - F.col("at")) * (100 + p) - F.col("n") * p
        columns = (
            rows.groupBy("token", "group", "part", F.col("component").alias("of_group"))
            .agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(slack).alias("slack"))
            .withColumnRenamed("token", "_token")
        )
        pairs = (
            rows.select("token", "node", "n", "at", "component")
            .join(
                columns,
                (F.col("token") == F.col("_token"))
                & (F.col("component") > F.col("of_group"))
                & (F.col("high") * 100 >= F.col("n") * p)
                & (F.col("n") * 100 >= F.col("low") * p)
                & ((F.col("n") - F.col("at")) * (100 + p) >= (F.col("n") + F.col("low")) * p)
                & (F.col("slack") >= F.col("n") * p),
            )
            .select("node", "n", "group", "part")
            .distinct()
        )
        # Matrix rows of the groups in question; a group of one is its member's own bitmap.
        asked = self.space.keep(pairs, "pairs")
        which = asked.select("group", "part").distinct()
        matrix = self.space.keep(
            members.join(which, ["group", "part"], "left_semi")
            .join(classes.select("node", "bits"), "node")
            .groupBy("group", "part")
            .applyInArrow(_union_bits, "group long, part int, low int, bits binary"),
            "matrix",
        )
        bounded = (
            asked.join(matrix.withColumnRenamed("bits", "b_bits"), ["group", "part"])
            .join(classes.select("node", F.col("bits").alias("a_bits")), "node")
            .withColumn("to", F.struct("group", "part"))
            .select(
                "node", "to", F.col("n").alias("a_n"), self._need("n", "low"), "a_bits", "b_bits"
            )
            .mapInArrow(_may_link, "node long, to struct<group: long, part: int>")
            .select(F.col("node").alias("a"), "to.group", "to.part")
        )
        opened = bounded.join(
            members.select(F.col("node").alias("b"), "group", "part"), ["group", "part"]
        ).select("a", "b")
        return self.verified(opened.distinct(), classes, "opened")

    def _named(self, classes: DataFrame, final: DataFrame) -> DataFrame:
        labelled = self.space.keep(
            classes.select("node", "digest", "label").join(final, "node", "left"), "labelled"
        )
        linked = labelled.where("component is not null")
        of_component = self.space.keep(
            linked.groupBy("component").agg(
                F.min("label").alias("component_label"), F.count("*").alias("held")
            ),
            "component-labels",
        )
        columns = ["digest", "component", "component_label"]
        named = spread_join(linked, of_component, ["component"], "held", F.xxhash64("node"))
        alone = labelled.where("component is null").select(
            "digest", F.col("node").alias("component"), F.col("label").alias("component_label")
        )
        known = F.when(F.col("component_label") < _NO_ID, F.col("component_label"))
        return self.space.keep(
            named.select(*columns)
            .unionByName(alone)
            .select("digest", "component", known.alias("component_id")),
            "named",
        )


def _whole_id(doc_id: Column) -> Column:
    """An id that equals itself when null."""
    return F.struct(F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("none"))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Two documents are linked when their sets of ``k``-word shingles share at least ``percent`` of
    their union. ``component_id`` is the smallest ``doc_id`` reachable by links, itself included.
    """
    rows, named = _Join(docs, k, percent).run()
    n = F.col("n").cast("long").alias("n_shingles")
    without = rows.where("n = 0").select("doc_id", n, F.col("doc_id").alias("component_id"))
    return (
        rows.where("n > 0")
        .join(named, "digest")
        .select("doc_id", n, "component_id")
        .unionByName(without)
    )


def one_per_component(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` of each component: the one with the smallest id, null last.

    Of rows with one id and different texts each belongs to its own text's component. Rows without
    words are linked with nothing and stay, equal ones once.
    """
    join = _Join(docs, k, percent)
    marks, named = join.run()
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    placed = join.space.keep(
        marks.where("n > 0")
        .join(named, "digest")
        .select("component", "doc_id", "text_hash", place.alias("place")),
        "rows-of-components",
    )
    first = join.space.keep(
        placed.groupBy("component").agg(F.min("place").alias("first"), F.count("*").alias("held")),
        "first-rows",
    )
    gone = (
        spread_join(placed, first, ["component"], "held", F.xxhash64("doc_id", "text_hash"))
        .where("place <> first")
        .select("doc_id", "text_hash")
        .distinct()
        .select(
            _whole_id(F.col("doc_id")).alias("_gone_id"),
            F.col("text_hash").alias("_gone_text"),
        )
    )
    rows, box = boxed(docs)
    return (
        rows.withColumns(
            {
                "_id": _whole_id(F.col(f"{box}.doc_id").cast("long")),
                "_text": _text_hash(F.col(f"{box}.text")),
            }
        )
        .join(
            gone,
            (F.col("_id") == F.col("_gone_id")) & (F.col("_text") == F.col("_gone_text")),
            "left_anti",
        )
        .dropDuplicates(["_id", "_text"])
        .select(*unboxed(box, docs.columns))
    )
