"""Line deduplication against levelled sorted runs of line hashes.

Batches of documents arrive from the largest id to the smallest. A batch's first holders of each
line are merge-anti-joined with the runs; what no run knows is written as a new run, sorted by
hash, and every ``fanout`` runs of a level are compacted into one of the next. Each line has
thereby exactly one entry, the largest document holding it; all its other occurrences are repeats,
and a line with two repeating documents or more is found in three.

Nulls: a null text is one empty line; a null ``doc_id`` counts as the smallest id. Rows with one
``doc_id`` are one document. Keys shorter than ``min_chars`` are never dropped. An empty table
gives an empty result. Further columns stay; those named as a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.skew import spread_join
from offerloom.llm.store import Workspace
from offerloom.llm.text import SPACES, ascii_lower, boxed, hash_pair, unboxed, whole

_NO_ID = -(2**63)


def _lines(text: Column) -> Column:
    return F.split(whole(text), "\n", -1)


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))


class LineRuns:
    """Sorted runs of ``(_h1, _h2, _id)``, one entry per line, kept in levels."""

    def __init__(self, space: Workspace, fanout: int) -> None:
        self.space, self.fanout = space, fanout
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self._written = 0

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def names(self) -> list[str]:
        return [name for level in self.levels for name, _ in level]

    def admit(self, firsts: DataFrame) -> None:
        """Merge-anti-join a batch's first holders with every run and add the rest as a run."""
        self._compact()
        for run in self.runs():
            firsts = firsts.hint("merge").join(run.select("_h1", "_h2"), ["_h1", "_h2"], "left_anti")
        self._add(0, firsts)

    def _add(self, level: int, rows: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"run-{self._written}"
        self._written += 1
        run = rows.select("_h1", "_h2", "_id").sortWithinPartitions("_h1", "_h2")
        self.levels[level].append((name, self.space.keep(run, name)))

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            full = self.levels[level]
            if len(full) >= self.fanout:
                self.levels[level] = []
                merged = full[0][1]
                for _, run in full[1:]:
                    merged = merged.unionByName(run)
                self._add(level + 1, merged.repartition("_h1", "_h2"))
                for name, _ in full:
                    self.space.drop(name)
            level += 1


def repeated_lines(
    docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int, space: Workspace
) -> DataFrame:
    """``_id, _row, _pos`` of every line to drop."""
    if min_docs not in (2, 3):
        raise ValueError("min_docs is 2 or 3: repeats are told apart by their smallest and largest")
    line = F.transform(
        _lines(F.col("text")),
        lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(SPACES)).alias("key")),
    )
    long_enough = F.filter(line, lambda x: F.length(x["key"]) >= min_chars)
    hashed = F.transform(
        long_enough,
        lambda x: F.struct(
            x["pos"].alias("_pos"),
            *[
                h.alias(name)
                for name, h in zip(("_h1", "_h2"), hash_pair(ascii_lower(x["key"])), strict=True)
            ],
        ),
    )
    id_range = docs.select(_id().alias("_id"))
    cuts = id_range.agg(
        F.percentile_approx("_id", [i / batches for i in range(1, batches)], 10_000)
    ).first()[0]
    batch = F.lit(0)
    for cut in sorted(set(cuts or [])):
        batch = batch - F.when(_id() > cut, 1).otherwise(0)
    lines = space.keep(
        docs.select(
            _id().alias("_id"),
            F.xxhash64(whole(F.col("text"))).alias("_row"),
            batch.alias("_batch"),
            hashed.alias("_lines"),
        ).select("_id", "_row", "_batch", F.inline("_lines")),
        "lines",
    )
    runs = LineRuns(space, fanout)
    for at in range(-len(set(cuts or [])), 1):
        runs.admit(
            lines.where(F.col("_batch") == at).groupBy("_h1", "_h2").agg(F.max("_id").alias("_id"))
        )
    entries = runs.runs()[0]
    for run in runs.runs()[1:]:
        entries = entries.unionByName(run)
    repeats = space.keep(
        lines.drop("_batch").join(entries, ["_h1", "_h2", "_id"], "left_anti"), "repeats"
    )
    for name in ("lines", *runs.names()):
        space.drop(name)
    held = repeats.groupBy("_h1", "_h2").agg(
        F.min("_id").alias("_low"), F.max("_id").alias("_high"), F.count("*").alias("_n")
    )
    if min_docs == 3:
        held = held.where(F.col("_low") < F.col("_high"))
    held = space.keep(held.select("_h1", "_h2", "_n"), "held")
    return spread_join(
        repeats, held, ["_h1", "_h2"], "_n", F.xxhash64("_id", "_pos"), "left_semi"
    ).select("_id", "_row", "_pos")


def drop_repeated_lines(
    docs: DataFrame,
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """Each row of ``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at
    least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines
    except in the largest ``doc_id`` holding them. ``batches`` says in how many steps of ``doc_id``
    the runs are built, ``fanout`` how many runs of a level are compacted together.
    """
    space = Workspace(docs.sparkSession, "lines")
    gone = repeated_lines(
        docs.select("doc_id", "text"), min_chars, min_docs, batches, fanout, space
    )
    per_doc = gone.groupBy("_id", "_row").agg(
        F.array_sort(F.collect_set("_pos")).alias("_gone")
    )
    rows, box = boxed(docs)
    text = whole(F.col(f"{box}.text"))
    own_id = F.coalesce(F.col(f"{box}.doc_id").cast("long"), F.lit(_NO_ID))
    joined = (
        rows.withColumns({"_id": own_id, "_row": F.xxhash64(text)})
        .join(per_doc, ["_id", "_row"], "left")
    )
    lines, gone_at = _lines(text), F.col("_gone")
    # The kept stretches between dropped lines: each line is copied once, whatever the number.
    edges = F.concat(F.array(F.lit(-1)), gone_at, F.array(F.size(lines)))
    stretches = F.zip_with(
        F.slice(edges, 1, F.size(edges) - 1),
        F.slice(edges, 2, F.size(edges) - 1),
        lambda low, high: F.struct((low + 2).alias("start"), (high - low - 1).alias("n")),
    )
    kept = F.flatten(
        F.transform(
            F.filter(stretches, lambda s: s["n"] > 0),
            lambda s: F.slice(lines, s["start"], s["n"]),
        )
    )
    added = {
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.coalesce(F.size(gone_at), F.lit(0)).cast("long"),
        "kept_text": F.when(gone_at.isNull(), text).otherwise(F.array_join(kept, "\n")),
    }
    return joined.select(
        *unboxed(box, [c for c in docs.columns if c not in added]),
        *[c.alias(name) for name, c in added.items()],
    )
