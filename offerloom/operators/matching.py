"""Offers of one product across sources.

Two offers match when their titles name the same numbers (sizes, memory, models) and share at least
``percent`` of their other words. Equal word lists are one class, so copies never multiply the work.
A class shows the words that any match must share with it: of its words in an order common to all,
rare ones first, the first ``n - ceil(percent n) + 1``. Classes meet where they have the same
numbers and show the same word, and are then compared exactly. Very common meeting places are cut
into parts by ``join_per_key``. Products are the connected components of matches that link sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.text import title_key, words_of
from offerloom.operators.ranking import join_per_key
from offerloom.operators.settling import settle


def title_words(title: Column) -> tuple[Column, Column]:
    """Distinct words with a digit and distinct words without, in order of the alphabet."""
    words = F.array_sort(F.array_distinct(words_of(title_key(F.coalesce(title, F.lit(""))))))
    has_digit = lambda w: w.rlike("[0-9]")
    return F.filter(words, has_digit), F.filter(words, lambda w: ~has_digit(w))


def _least(n: Column, percent: int) -> Column:
    """The smallest overlap with a set of ``n`` words that can make a match."""
    return F.ceil(n * percent / 100).cast("int")


def matching_classes(classes: DataFrame, percent: int = 80) -> DataFrame:
    """Pairs ``a < b`` of ``classes(node, numbers, words)`` that match; no class has no words."""
    rarity = classes.select(F.explode("words").alias("word")).groupBy("word").agg(
        F.count("*").alias("held")
    )
    exploded = classes.select("node", "numbers", F.size("words").alias("n"), F.explode("words").alias("word"))
    ordered = (
        join_per_key(exploded, rarity, ["word"], "held")
        .groupBy("node", "numbers", "n")
        .agg(F.array_sort(F.collect_list(F.struct("held", "word"))).alias("_o"))
        .withColumn("words", F.transform("_o", lambda x: x["word"]))
        .drop("_o")
    )
    shown = F.slice("words", F.lit(1), F.col("n") - _least(F.col("n"), percent) + 1)
    places = settle(ordered.withColumn("word", F.explode(shown)))
    sizes = places.groupBy("numbers", "word").agg(F.count("*").alias("held"))
    # A class meets its place's classes as one list each of at most all classes of that place.
    met = places.join(sizes.where(F.col("held") > 1), ["numbers", "word"])
    other = met.select(
        "numbers", "word", F.col("node").alias("b"), F.col("n").alias("_n"), F.col("words").alias("_words")
    )
    shared = F.size(F.array_intersect("words", "_words"))
    return (
        met.join(other, ["numbers", "word"])
        .where(
            (F.col("node") < F.col("b"))
            & (F.col("n") * percent <= F.col("_n") * 100)
            & (F.col("_n") * percent <= F.col("n") * 100)
        )
        .where(shared * 100 >= (F.col("n") + F.col("_n") - shared) * percent)
        .select(F.col("node").alias("a"), "b")
        .distinct()
    )


def linked_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` of all ``nodes(node)``: the smallest node reachable over ``links(a, b)``.

    A node takes the smallest label next to it, then that label's own label, so that chains shorten
    by halves each round.
    """
    both = settle(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = settle(nodes.select("node", F.col("node").alias("component")).distinct())
    while True:
        heard = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy(F.col("a").alias("_a"))
            .agg(F.min("component").alias("_heard"))
        )
        nearer = labels.join(heard, F.col("node") == F.col("_a"), "left").select(
            "node", F.col("component").alias("_old"), F.least("component", "_heard").alias("component")
        )
        further = labels.select(F.col("node").alias("_n"), F.col("component").alias("_further"))
        moved = settle(
            nearer.join(further, F.col("component") == F.col("_n"), "left").select(
                "node", "_old", F.least("component", "_further").alias("component")
            )
        )
        labels = moved.select("node", "component")
        if moved.where(F.col("_old") != F.col("component")).isEmpty():
            return labels


def product_matches(offers: DataFrame, percent: int = 80) -> DataFrame:
    """``offer_id, source, product, n_sources`` of every offer whose product several sources have.

    ``offers``: offer_id, source, title. ``product`` is the smallest ``offer_id`` of the component.
    Titles without words beside their numbers match nothing; NULL sources and ids take no part.
    """
    numbers, words = title_words(F.col("title"))
    sound = offers.where(F.col("offer_id").isNotNull() & F.col("source").isNotNull())
    read = settle(
        sound.select("offer_id", "source", numbers.alias("numbers"), words.alias("words")).where(
            F.size("words") > 0
        )
    )
    classes = settle(
        read.groupBy("numbers", "words").agg(F.min("offer_id").alias("node"), F.count("*").alias("held"))
    )
    found = linked_components(classes.select("node"), matching_classes(classes, percent))
    named = classes.join(found, "node").select("numbers", "words", "held", "component")
    rows = settle(
        join_per_key(read, named, ["numbers", "words"], "held").select("offer_id", "source", "component")
    )
    per_product = (
        rows.groupBy("component", "source")
        .agg(F.count("*").alias("n"))
        .groupBy("component")
        .agg(F.count("*").alias("n_sources"), F.sum("n").alias("_size"))
        .where(F.col("n_sources") > 1)
    )
    return join_per_key(rows, per_product, ["component"], "_size").select(
        "offer_id", "source", F.col("component").alias("product"), "n_sources"
    )
