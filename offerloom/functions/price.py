"""Prices. Text and payload prices become integers; kopecks are never doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions.text import all_matches, first_match, has, strip


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[^\d]", "")


def _to_bigint(digits: Column) -> Column:
    return digits.try_cast("bigint")


def parse_price(text: Column) -> Column:
    """Rubles from text: ``1750.00`` is 1750, otherwise all digits; NULL when not positive."""
    compact = F.translate(strip(text), "\u202f ", "")
    value = F.when(
        compact.rlike(r"^\d+[.,]\d{1,2}$"), _to_bigint(F.regexp_extract(compact, r"^(\d+)", 1))
    ).otherwise(_to_bigint(_digits(compact)))
    return F.when(value > 0, value)


def parse_price_kopecks(text: Column, on_fail: int | None = None) -> Column:
    """Kopecks from all digits of the text; ``on_fail`` replaces a missing price."""
    value = _to_bigint(_digits(text)) * 100
    return value if on_fail is None else F.coalesce(value, F.lit(on_fail).cast("bigint"))


def payload_price(product: Column) -> Column:
    """Kopecks by key priority; zero counts as missing; 0 when nothing is found."""
    size_price = F.get(product["sizes"], 0)["price"]
    parts = [
        size_price["product"],
        size_price["total"],
        size_price["basic"],
        product["salePriceU"],
        product["priceU"],
    ]
    return F.coalesce(*[F.nullif(p, F.lit(0).cast("bigint")) for p in parts], F.lit(0))


def scale_price(value: Column) -> Column:
    """Variant price to kopecks: whole numbers below 100 000 and all texts are rubles."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "bigint")
    return (
        F.when(
            kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"),
            F.when(number < 100_000, number * 100).otherwise(number),
        )
        .otherwise(parse_price_kopecks(F.try_variant_get(value, "$", "string"), on_fail=0))
    )


def _within_bounds(value: Column) -> Column:
    return value.between(rules.MIN_PRICE_RUB, rules.MAX_PRICE_RUB)


def plausible_price(text: Column) -> Column:
    """A price within bounds, else the last grouped number within bounds, else NULL."""
    whole = parse_price(text)
    grouped = F.filter(
        F.transform(all_matches(text, f"({rules.GROUPED_NUMBER})"), parse_price), _within_bounds
    )
    return F.when(_within_bounds(whole), whole).otherwise(F.get(F.reverse(grouped), 0))


def first_plausible_price(text: Column) -> Column:
    """First currency-marked amount of at least the minimum."""
    amounts = F.transform(all_matches(text, rules.TEXT_PRICE), parse_price)
    return F.get(F.filter(amounts, lambda p: p >= rules.MIN_PRICE_RUB), 0)


def attribute_price(html: Column, pattern: str) -> Column:
    """Price in the first attribute that matches, when it is plausible."""
    value = parse_price(first_match(html, pattern))
    return F.when(value >= rules.MIN_PRICE_RUB, value)


def page_price(html: Column, structured: Column, described: Column) -> Column:
    """Rubles of a product page.

    ``structured`` is the price the markup states, ``described`` the title,
    description and raw price text. An implausible structured price is replaced by the
    first plausible amount found in the text, the attributes or anywhere on the page.
    """
    return F.coalesce(
        F.when(structured >= rules.MIN_PRICE_RUB, structured),
        F.when(structured.isNotNull(), first_plausible_price(described)),
        attribute_price(html, rules.ITEMPROP_PRICE),
        attribute_price(html, rules.ATTR_PRICE),
        first_plausible_price(html),
        F.when(structured > 0, structured),
    )


def has_price_attribute(html: Column) -> Column:
    return has(html, rules.ITEMPROP_PRICE) | has(html, rules.ATTR_PRICE)


def has_price_text(html: Column) -> Column:
    return has(html, rules.TEXT_PRICE)


def feed_price(sale: Column, promo: Column, base: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.coalesce(F.nullif(sale, zero), F.nullif(promo, zero), F.nullif(base, zero))
