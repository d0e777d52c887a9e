"""Helpers that shape the plan, not the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters must not copy into themselves.

    Catalyst pushes a filter below a projection by repeating the projected expression, which
    multiplies nested pattern tests. A one-row generator is a border it does not cross, so
    each expression is planned and evaluated once.
    """
    fields = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(fields)))
