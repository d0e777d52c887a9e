"""License scans: MinHash bands over text windows retrieve templates, containment verifies them.

Texts and templates are read as lower-case words of letters and digits and as hashes of ``SHINGLE``
words. A text is covered by windows of ``WINDOW`` shingles that overlap by half; a template is cut
into runs of half a window, each of which lies within some window wherever it occurs. Each of
``BANDS`` seeded hashes of the shingles is an order of its own, and a band holds the smallest value
of one order. A window with ``r`` of a run's shingles agrees with it in one band with probability
``r / (WINDOW + run - r)`` at least, so a template of one shingle is missed with probability
``(1 - 1 / WINDOW) ** BANDS``, 2e-4, and one that occurs with a whole run with
``(1 - run / WINDOW) ** BANDS``, 5e-20. A share of 0.8 of the template's shingles leaves a run whole
unless the differences are spread over all of them.

A band can only agree in a window that holds a shingle of some template, so bands are made of such
windows alone: the result is that of testing all windows. What is retrieved is verified exactly: the
share of the template's distinct shingles that the text holds is at least ``containment``.

Templates are ``(license, text)`` pairs or a table with these columns, of any size: their shingles
and bands are tables that are joined, and broadcast only where they have at most ``SMALL`` rows.
Rows of a license with several texts are told apart by text. Null and empty texts, and templates
without a license or with fewer than ``SHINGLE`` words, match nothing. Rows of texts are kept apart
by ``doc_id`` and text; equal rows are reported once. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.store import Workspace
from offerloom.llm.text import whole

SHINGLE, WINDOW, BANDS = 5, 8, 64
_RUN = WINDOW // 2
WORDS = r"([\p{L}\p{N}]+)"
#: A template table with more rows is shuffled instead of broadcast.
SMALL = 500_000

#: Texts of notices and headers (fixed values).
TEMPLATES = (
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("mit-notice", "Released under the MIT License."),
    (
        "gpl-3.0-notice",
        "This work is licensed under the GNU General Public License, version 3.",
    ),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    (
        "apache-2.0-header",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "mit-permission",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    (
        "isc-permission",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ),
    (
        "mpl-2.0-header",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    ),
    (
        "gpl-3.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
)


def shingle_hashes(text: Column) -> Column:
    """Hashes of all runs of ``SHINGLE`` words, in order."""
    words = F.regexp_extract_all(F.lower(whole(text)), F.lit(WORDS), 1)
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.transform(
        F.array(hashed),
        lambda h: F.when(
            F.size(h) >= SHINGLE,
            F.transform(
                F.sequence(F.lit(0), F.size(h) - SHINGLE),
                lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )[0]


def bands(hashes: Column) -> Column:
    """The smallest value of a window in each of the seeded orders."""

    def smallest(seed: int) -> Column:
        return F.array_min(F.transform(hashes, lambda x: F.xxhash64(F.lit(seed), x)))

    return F.array(*[smallest(b) for b in range(BANDS)])


def template_table(
    spark: SparkSession, templates: tuple | DataFrame = TEMPLATES
) -> DataFrame:
    """``license, template, shingles``: the distinct hashes of each text in order."""
    rows = templates
    if not isinstance(rows, DataFrame):
        rows = spark.createDataFrame(list(rows), "license string, text string")
    return (
        rows.select(
            "license",
            F.xxhash64("text").alias("template"),
            F.array_distinct(shingle_hashes(F.col("text"))).alias("shingles"),
        )
        .where(F.col("license").isNotNull() & (F.size("shingles") > 0))
        .dropDuplicates(["license", "template"])
    )


def _runs(table: DataFrame) -> DataFrame:
    """Half-window runs of each template; the last one ends where the template does."""
    n = F.size("shingles")
    starts = F.array_distinct(
        F.concat(
            F.sequence(F.lit(0), F.greatest(n - _RUN, F.lit(0)), F.lit(_RUN)),
            F.array(F.greatest(n - _RUN, F.lit(0))),
        )
    )
    return table.withColumn("_start", F.explode(starts)).select(
        "license",
        "template",
        F.slice("shingles", F.col("_start") + 1, F.lit(_RUN)).alias("run"),
    )


def _beside(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it is small."""
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def _blocks(hashes: Column) -> Column:
    """Runs of a text with the half window before and after them, where windows can lie."""
    return F.transform(
        F.sequence(F.lit(0), F.size(hashes) - 1, F.lit(_RUN)),
        lambda b: F.struct(
            F.slice(hashes, b + 1, F.lit(_RUN)).alias("own"),
            F.when(b >= _RUN, F.slice(hashes, b - _RUN + 1, F.lit(WINDOW))).alias("before"),
            F.slice(hashes, b + 1, F.lit(WINDOW)).alias("after"),
        ),
    )


def scan(
    docs: DataFrame, templates: tuple | DataFrame = TEMPLATES, containment: float = 0.8
) -> DataFrame:
    """``doc_id, license, matched, total, containment`` for every verified template of a text."""
    spark = docs.sparkSession
    work = Workspace(spark, "licenses")
    table = work.keep(template_table(spark, templates), "templates")
    key = ["doc_id", "_row"]
    held_by = table.select("license", "template", F.explode("shingles").alias("shingle"))
    known = work.keep(held_by.select("shingle").distinct(), "known")
    template_bands = work.keep(
        _runs(table)
        .select("license", "template", F.posexplode(bands(F.col("run"))).alias("band", "value"))
        .distinct(),
        "bands",
    )
    blocks = (
        docs.select(
            "doc_id",
            F.xxhash64("text").alias("_row"),
            shingle_hashes(F.col("text")).alias("_h"),
        )
        .where(F.size("_h") > 0)
        .select(*key, F.explode(_blocks(F.col("_h"))).alias("_block"))
        .select(*key, "_block.*")
    )
    found = work.keep(
        blocks.withColumn("shingle", F.explode("own"))
        .join(_beside(known), "shingle", "left_semi")
        .select(*key, "shingle", "before", "after"),
        "found",
    )
    windows = (
        found.select(*key, F.explode(F.array("before", "after")).alias("_window"))
        .where(F.col("_window").isNotNull())
        .distinct()
    )
    named = ["license", "template"]
    retrieved = (
        windows.select(*key, F.posexplode(bands(F.col("_window"))).alias("band", "value"))
        .join(_beside(template_bands), ["band", "value"])
        .select(*key, *named)
        .distinct()
    )
    matched = (
        found.select(*key, "shingle")
        .distinct()
        .join(_beside(held_by), "shingle")
        .groupBy(*key, *named)
        .agg(F.count("*").alias("matched"))
    )
    totals = table.select(*named, F.size("shingles").cast("long").alias("total"))
    verified = matched.join(_beside(totals), named).withColumn(
        "containment", F.col("matched").cast("double") / F.col("total")
    )
    # Null ids are rows like others, so they are compared as equal.
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*key, *named]]
    return (
        verified.where(F.col("containment") >= containment)
        .alias("v")
        .join(retrieved.alias("r"), same, "left_semi")
        .select("doc_id", "license", "matched", "total", "containment")
        .distinct()
    )
