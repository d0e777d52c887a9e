"""Expressions on text that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of the contracts, as the inside of a character class and as a set.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\f\r"
WORD = f"[^{SPACE_CLASS}]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: Column) -> Column:
    """Maximal runs without white space."""
    return F.regexp_extract_all(whole(text), F.lit(f"({WORD})"), 1)


def hash_pair(*values: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes: together an identity for any number of rows."""
    return F.xxhash64(*values), F.xxhash64(F.lit(1), *values)


def boxed(docs: DataFrame) -> tuple[DataFrame, str]:
    """All columns as one struct, and its name, which is none of theirs."""
    name = "_doc"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    fields = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.struct(*fields).alias(name)), name


def unboxed(name: str, columns: list[str]) -> list[Column]:
    """The columns of a boxed row."""
    return [F.col(f"{name}.`{c}`").alias(c) for c in columns]
