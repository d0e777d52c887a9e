"""Text helpers. Java needs ``(?U)`` for Unicode classes and ``(?iU)`` for Cyrillic case."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cache
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUOTE = re.compile(r"[.\\^$|()\[\]{}*+?]")


def has(text: Column, pattern: str) -> Column:
    """Case-insensitive search for a pattern anywhere in the text."""
    return text.rlike(f"(?iU){pattern}")


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a pattern, NULL (not '') when there is none."""
    found = F.regexp_extract(text, f"(?iU){pattern}", group)
    return F.when(has(text, pattern), found)


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?iU){pattern}"), F.lit(group))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squish(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def fold(text: Column) -> Column:
    """Lower case with ё written as е."""
    return F.translate(F.lower(text), "ё", "е")


def any_of(words: Iterable[str]) -> str:
    """Alternation of literal words as a Java pattern."""
    return "|".join(_QUOTE.sub(r"\\\g<0>", word) for word in words)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """One pattern instead of a chain of ``contains``: the text is computed once."""
    return text.rlike(f"(?:{any_of(words)})")


def starts_with_any(text: Column, words: Iterable[str]) -> Column:
    return text.rlike(f"^(?:{any_of(words)})")


def text_array(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(word) for word in words]).cast("array<string>")


def words_of(text: Column) -> Column:
    """Whitespace-separated words without empties."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """What is made of a value that is computed once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def unique_ignoring_case(items: Column) -> Column:
    """Keep the first of the items that differ only in case."""
    return first_of_each(items, F.lower)


def blank_to_null(text: Column) -> Column:
    return F.when(strip(text) != "", text)


def first_of_each(items: Column, key: Callable[[Column], Column]) -> Column:
    """The first item of each key, in order; items without a key are left out.

    Items are sorted by key and place, so that each is compared with its neighbour only.
    """

    def firsts(held: Column) -> Column:
        fields = F.transform(held, lambda x, i: F.struct(key(x).alias("k"), i.alias("i")))
        ordered = F.array_sort(F.filter(fields, lambda x: x["k"].isNotNull()))
        kept = F.transform(
            F.array(ordered),
            lambda o: F.filter(
                o, lambda x, i: (i == 0) | ~x["k"].eqNullSafe(F.get(o, F.greatest(i - 1, F.lit(0)))["k"])
            ),
        )[0]
        places = F.array_sort(F.transform(kept, lambda x: x["i"]))
        return F.transform(places, lambda i: F.get(held, i))

    # The list is bound, or it would be made anew for each item that is looked up.
    return F.transform(F.array(items), firsts)[0]


def last_of_each(items: Column, key: Callable[[Column], Column]) -> Column:
    """The last item of each key, at the place of the key's first one.

    Items are sorted by key and place; a key's first and last ones are where neighbours differ.
    """

    def lasts(held: Column) -> Column:
        fields = F.transform(held, lambda x, i: F.struct(key(x).alias("k"), i.alias("i")))
        ordered = F.array_sort(F.filter(fields, lambda x: x["k"].isNotNull()))

        def edges(o: Column, step: int) -> Column:
            """Places whose neighbour on one side has another key or is not there."""
            return F.filter(
                o,
                lambda x, i: ~x["k"].eqNullSafe(
                    F.when(i + step >= 0, F.get(o, F.greatest(i + step, F.lit(0))))["k"]
                ),
            )

        ends = bound(
            ordered,
            lambda o: F.array_sort(
                F.zip_with(
                    edges(o, -1),
                    edges(o, 1),
                    lambda a, b: F.struct(a["i"].alias("first"), b["i"].alias("last")),
                )
            ),
        )
        return F.transform(ends, lambda e: F.get(held, e["last"]))

    return bound(items, lasts)


_ENTITY = r"(?s)&#?[0-9A-Za-z]+;|&|[^&]+"


#: What stands before a name and before its characters in the table of entities.
_NAME, _MEANS = "\x01", "\x02"


@cache
def _named_entities() -> str:
    """Named entities and their characters as one text, from the standard table.

    A plan holds the table for every text that it decodes, and each task reads the plan: a map of
    its entries takes a task longer than its rows.
    """
    named = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
    return "".join(f"{_NAME}{k}{_MEANS}{v}" for k, v in named.items())


def _entity(name: Column) -> Column:
    """Characters of a named entity, NULL for other names."""
    table = F.lit(_named_entities())
    key = F.concat(F.lit(_NAME), name, F.lit(_MEANS))

    def means(place: Column) -> Column:
        # An entity is one or two characters.
        after = F.substring(table, place + F.length(key), F.lit(3))
        return F.when(place > 0, F.substring_index(after, _NAME, 1))

    return bound(F.instr(table, key), means)


def _decoded(piece: Column) -> Column:
    """One entity decoded; anything else as it is."""
    hexadecimal = F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]{1,6});$", 1)
    decimal = F.regexp_extract(piece, r"^&#([0-9]{1,7});$", 1)
    digits = F.when(hexadecimal != "", F.upper(hexadecimal)).otherwise(
        F.when(decimal != "", F.hex(decimal.try_cast("bigint"))).otherwise("")
    )
    number = F.conv(digits, 16, 10).try_cast("bigint")
    sound = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    character = F.decode(F.unhex(F.lpad(F.when(sound, digits), 8, "0")), "UTF-32")
    word = F.substring(piece, 2, F.length(piece) - 2)
    return F.when(~piece.startswith("&") | (F.length(piece) < 3), piece).otherwise(
        F.coalesce(
            F.when(digits != "", F.coalesce(character, F.lit("\ufffd"))),
            _entity(word),
            piece,
        )
    )


def unescape(text: Column) -> Column:
    """Decode HTML entities, named and numbered. The text is split once at its ampersands."""

    def full(value: Column) -> Column:
        pieces = F.regexp_extract_all(value, F.lit(_ENTITY), 0)
        return F.array_join(F.transform(pieces, _decoded), "")

    return bound(text, lambda t: F.when(t.contains("&"), full(t)).otherwise(t))


def strip_markup(text: Column) -> Column:
    """Replace tags with spaces and collapse whitespace."""
    return squish(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "))


def split_glued_scripts(text: Column) -> Column:
    """Put a space between a Latin letter or digit and a following Cyrillic letter."""
    return F.regexp_replace(text, "([A-Za-z0-9&])([А-Яа-яЁё])", "$1 $2")


def clean_title(text: Column) -> Column:
    """Card title: entities decoded, spaces collapsed, glued scripts split."""
    return squish(split_glued_scripts(squish(unescape(text))))


def title_key(text: Column) -> Column:
    """Comparison form: lower case, ё as е, punctuation dropped, single spaces."""
    return squish(F.regexp_replace(fold(text), r"(?U)[^\w\s]", " "))


def g_format(number: Column) -> Column:
    """Shortest decimal form: 5.0 becomes 5, 4.8 stays."""
    return F.regexp_replace(number.cast("string"), r"\.0$", "")
