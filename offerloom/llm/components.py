"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.store import Workspace


def components(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """``node, component`` for every node in ``links(a, b)``: the smallest node it is linked with.

    Each round a node takes the smallest label next to it and then the label of its label, so
    chains shorten by halves. Rounds are written to the shared folder. A node with very many links
    is combined before the shuffle where it receives labels, and split by the engine's skew join
    where it sends its own.
    """
    both = space.keep(
        links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(),
        f"{name}-links",
    )
    labels = space.keep(
        both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.col("a"), F.min("b")).alias("component")
        ),
        f"{name}-0",
    )
    at = 0
    while True:
        heard = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy(F.col("a").alias("_a"))
            .agg(F.min("component").alias("_heard"))
        )
        nearer = labels.join(heard, F.col("node") == F.col("_a")).select(
            "node",
            F.col("component").alias("_old"),
            F.least("component", "_heard").alias("component"),
        )
        # A label is a node of its own component, so its label is one too.
        of_label = labels.select(F.col("node").alias("_n"), F.col("component").alias("_further"))
        moved = nearer.join(of_label, F.col("component") == F.col("_n"), "left").select(
            "node", "_old", F.least("component", "_further").alias("component")
        )
        at += 1
        now = space.keep(moved, f"{name}-{at}")
        changed = now.where("_old <> component").limit(1).count()
        labels = now.select("node", "component")
        if not changed:
            return labels
        space.drop(f"{name}-{at - 1}")
