"""Token-overlap and vector similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom.functions.text import words_of


def token_overlap(query: Column, text: Column) -> Column:
    """Share of query words (over two characters) found whole or as a stem in the text."""
    tokens = F.filter(words_of(F.lower(query)), lambda t: F.length(t) > 2)
    haystack = F.lower(text)

    def found(token: Column) -> Column:
        stem = F.substring(token, F.lit(1), F.greatest(F.lit(3), F.length(token) - 1))
        return haystack.contains(token) | ((F.length(stem) >= 4) & haystack.contains(stem))

    hits = F.size(F.filter(tokens, found))
    return F.when(F.size(tokens) > 0, hits / F.size(tokens)).otherwise(F.lit(0.0))


def dot(left: Column, right: Column) -> Column:
    """Dot product of two vectors; for unit vectors this is the cosine."""
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def similarity(query: Column, text: Column, query_vec: Column, text_vec: Column) -> Column:
    """Vector similarity where both vectors are stored, else token overlap; blank gives 0."""
    blank = (F.trim(query) == "") | (F.trim(text) == "")
    return F.when(blank, F.lit(0.0)).otherwise(
        F.coalesce(dot(query_vec, text_vec), token_overlap(query, text))
    )
