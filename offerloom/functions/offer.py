"""Offer fields: ratings, characteristics, descriptions, titles, quality checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions.text import (
    contains_any,
    first_match,
    g_format,
    has,
    squish,
    strip,
    text_array,
)


def parse_rating(text: Column) -> Column:
    """First number of the text (comma or point)."""
    return first_match(F.translate(text, ",", "."), r"(\d+\.\d+|\d+)").try_cast("double")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_replace(first_match(text, pattern), r"(?U)\s", "").try_cast("bigint")


def parse_reviews(text: Column) -> Column:
    """Review count in brackets, else the number before the review word."""
    return F.coalesce(_count(text, r"\((\d[\d\s]*)\)"), _count(text, r"(\d[\d\s]*)\s*отзыв"))


def parse_bought(text: Column) -> Column:
    return _count(text, r"(\d[\d\s]*)\s*купил")


def parse_badges(text: Column) -> Column:
    return F.filter(text_array(rules.CARD_BADGES), lambda badge: text.contains(badge))


def reject_badge_title(title: Column) -> Column:
    """Single-spaced title up to 300 characters; NULL when too short or a badge text."""
    cleaned = squish(title)
    return F.when(
        (F.length(cleaned) >= 3) & ~contains_any(F.lower(cleaned), rules.BADGE_TITLES),
        F.substring(cleaned, 1, 300),
    )


def is_advert(title: Column, widget: Column | None = None) -> Column:
    """Advert marker in the title, or a recommendation widget."""
    result = contains_any(F.lower(title), rules.ADVERT_TITLES)
    if widget is not None:
        result = result | F.coalesce(
            contains_any(F.lower(widget), rules.SKIP_WIDGETS), F.lit(False)
        )
    return result


def _present(entries: list[tuple[str, Column]]) -> Column:
    """Map of the entries that have a value, in the given order."""
    pairs = F.array(
        *[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in entries]
    )
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def title_characteristics(title: Column) -> Column:
    """Variant, memory and colour named in a title."""
    parts = F.filter(F.transform(F.split(title, ","), strip), lambda p: p != "")
    variant = F.when(
        F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(2), F.size(parts)), ", ")
    )
    return _present(
        [
            ("variant", variant),
            ("memory", first_match(title, rules.MEMORY)),
            ("color", strip(first_match(title, rules.COLOUR))),
        ]
    )


def payload_characteristics(product: Column) -> Column:
    """Brand, seller, category, colours, seller rating and stock of a payload product."""
    colours = F.filter(F.transform(product["colors"], strip), lambda c: c != "")
    return _present(
        [
            ("Бренд", F.nullif(product["brand"], F.lit(""))),
            ("Продавец", F.nullif(product["supplier"], F.lit(""))),
            ("Категория", F.nullif(product["entity"], F.lit(""))),
            ("Цвет", F.when(F.size(colours) > 0, F.array_join(colours, ", "))),
            ("Рейтинг продавца", product["supplierRating"].cast("string")),
            ("В наличии", product["totalQuantity"].cast("string")),
        ]
    )


def _joined(*lines: Column) -> Column:
    return strip(F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n"))


def _feature_lines(chars: Column) -> Column:
    rows = F.transform(
        F.map_entries(chars), lambda e: F.concat(F.lit("• "), e["key"], F.lit(": "), e["value"])
    )
    return F.when(
        F.size(chars) > 0, F.concat(F.lit("Характеристики:\n"), F.array_join(rows, "\n"))
    )


def _rating_line(rating: Column, reviews: Column) -> Column:
    tail = F.coalesce(
        F.concat(F.lit(" ("), reviews.cast("string"), F.lit(" отзывов)")), F.lit("")
    )
    return F.when(rating.isNotNull(), F.concat(F.lit("Рейтинг: "), g_format(rating), tail))


def _blank_before(block: Column, previous: Column) -> Column:
    """The block with an empty line before it when something precedes it."""
    return F.when(previous.isNotNull(), F.concat(F.lit("\n"), block)).otherwise(block)


def payload_description(chars: Column, rating: Column, reviews: Column) -> Column:
    features = _feature_lines(chars)
    details = F.coalesce(
        _rating_line(rating, reviews),
        F.when(reviews.isNotNull(), F.concat(F.lit("Отзывов: "), reviews.cast("string"))),
    )
    return _joined(features, _blank_before(details, features))


def card_description(
    chars: Column,
    rating: Column,
    reviews: Column,
    bought: Column,
    delivery: Column,
    prose: Column | None = None,
) -> Column:
    text = F.nullif(strip(prose), F.lit("")) if prose is not None else F.lit(None).cast("string")
    features = _feature_lines(chars)
    details = F.nullif(
        F.concat_ws(
            "\n",
            _rating_line(rating, reviews),
            F.when(bought.isNotNull(), F.concat(F.lit("Купили: "), bought.cast("string"))),
            F.when(
                F.coalesce(delivery, F.lit("")) != "",
                F.concat(F.lit("Доставка: "), delivery),
            ),
        ),
        F.lit(""),
    )
    head = F.coalesce(text, features)
    return _joined(text, _blank_before(features, text), _blank_before(details, head))


def detail_description(prose: Column, chars: Column) -> Column:
    text = F.nullif(strip(prose), F.lit(""))
    features = _feature_lines(chars)
    return _joined(text, _blank_before(features, text))


def preview_description(
    title: Column, rating: Column, reviews: Column, badges: Column
) -> Column:
    """Title, star line and badges as paragraphs."""
    stars = F.nullif(
        F.concat_ws(
            " · ",
            F.concat(F.lit("★ "), g_format(rating)),
            F.when(
                reviews > 0,
                F.concat(
                    F.translate(F.format_number(reviews, 0), ",", " "), F.lit(" отзывов")
                ),
            ),
        ),
        F.lit(""),
    )
    badge_text = F.nullif(
        F.array_join(F.filter(F.transform(badges, strip), lambda b: b != ""), ", "), F.lit("")
    )
    return strip(F.concat_ws("\n\n", F.nullif(strip(title), F.lit("")), stars, badge_text))


def snippet_bought(description: Column) -> Column:
    """Bought count read back from a rendered description."""
    line = F.regexp_extract(description, r"(?m)^Купили: (.*)$", 1)
    return F.regexp_replace(line, r"[^\d]", "").try_cast("bigint")


def snippet_delivery(description: Column) -> Column:
    return F.nullif(
        strip(F.regexp_extract(description, r"(?m)^Доставка: (.*)$", 1)), F.lit("")
    )


def mark_incomplete(chars: Column, price: Column) -> Column:
    """Characteristics with a marker when the price is missing (last value wins)."""
    kept = F.map_filter(chars, lambda k, v: k != "price_unavailable")
    return F.when(
        price.isNull(),
        F.map_concat(kept, F.create_map(F.lit("price_unavailable"), F.lit("true"))),
    ).otherwise(chars)


def field_issues(
    source: Column, title: Column, price: Column, url: Column, image: Column
) -> Column:
    """Problems of one offer, in a fixed order; empty when it is sound."""

    def issue(condition: Column, *text: Column) -> Column:
        return F.when(condition, F.concat(source, *text))

    return F.filter(
        F.array(
            issue(strip(title) == "", F.lit(": empty title")),
            issue(price <= 0, F.lit(": invalid price "), price.cast("string")),
            issue(~url.startswith("http"), F.lit(": bad url "), F.substring(url, 1, 40)),
            issue(~image.startswith("http"), F.lit(": bad image "), F.substring(image, 1, 40)),
        ),
        lambda x: x.isNotNull(),
    )


def feed_image(path: Column) -> Column:
    clean = F.regexp_replace(path, "^/+", "")
    return F.when(path.isNotNull(), F.concat(F.lit("https://img.mvideo.ru/"), clean)).otherwise("")


def feed_url(product_id: Column, slug: Column) -> Column:
    clean = F.regexp_replace(strip(F.coalesce(slug, F.lit(""))), "^/+|/+$", "")
    return (
        F.when(
            (clean != "") & (product_id != ""),
            F.concat(F.lit("https://www.mvideo.ru/products/"), clean, F.lit("-"), product_id),
        )
        .when(product_id != "", F.concat(F.lit("https://www.mvideo.ru/product/"), product_id))
        .otherwise(F.lit("https://www.mvideo.ru/"))
    )


def card_page_state(html: Column) -> Column:
    """``blocked`` for a challenge page of the card source, ``empty`` or ``ok``."""
    lowered = F.lower(html)
    blocked = (
        lowered.contains("smartcaptcha")
        | lowered.contains("подтвердите, что запросы отправляли вы")
        | (lowered.contains("<title>403</title>") & (F.length(html) < 10_000))
    )
    return (
        F.when(F.coalesce(html, F.lit("")) == "", "empty").when(blocked, "blocked").otherwise("ok")
    )


def tile_page_state(html: Column) -> Column:
    """``blocked`` for a challenge page of the tile source, ``ready``, else ``pending``."""
    title = strip(F.regexp_extract(html, "(?iU)<title>([^<]+)</title>", 1))
    blocked = (
        title.isin(*rules.CHALLENGE_TITLES)
        | (html.contains("Похоже, нет") & html.contains("fab_"))
        | ((F.length(html) < 15_000) & F.lower(html).contains("antibot"))
        | (F.coalesce(html, F.lit("")) == "")
    )
    return (
        F.when(F.coalesce(blocked, F.lit(True)), "blocked")
        .when(html.contains("/product/") & html.contains("₽"), "ready")
        .otherwise("pending")
    )


def detail_page_state(html: Column) -> Column:
    """``blocked``, ``ready`` (description or many widgets rendered) or ``pending``."""
    described = has(html, r'property="og:description"\s+content="[^"]{10,}"')
    widgets = F.regexp_count(html, F.lit("data-widget"))
    return (
        F.when(tile_page_state(html) == "blocked", "blocked")
        .when(described | (widgets >= 20), "ready")
        .otherwise("pending")
    )


def is_consent_page(html: Column) -> Column:
    lowered = F.lower(html)
    return (
        lowered.contains("datenschutzeinstellungen")
        | lowered.contains("настройки конфиденциальности")
        | ((F.length(html) < 50_000) & lowered.contains("consent.yahoo.com"))
    )


def is_antibot(error: Column) -> Column:
    return F.coalesce(contains_any(F.lower(error), rules.ANTIBOT_MARKERS), F.lit(False))


