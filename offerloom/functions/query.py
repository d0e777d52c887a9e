"""Query normalisation, tokens, variants, categories and title relevance."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions.similarity import token_overlap
from offerloom.functions.text import (
    contains_any,
    first_match,
    fold,
    has,
    strip,
    text_array,
    unique_ignoring_case,
)

_WORD = "([a-zа-яё0-9]+)"


def snapshot_key(region: Column, query: Column, prefix: str = "") -> Column:
    """Cache key of one source's answer: ``prefix:region:lowered query``."""
    parts = [F.lit(prefix)] if prefix else []
    return F.concat_ws(":", *parts, region, F.lower(strip(query)))


def expand_query(query: Column) -> Column:
    """Dictionary expansion of the whole lowered query, NULL when it has none."""
    lowered = F.lower(strip(query))
    table = F.create_map(*[F.lit(x) for x in chain(*rules.QUERY_EXPANSIONS.items())])
    return F.try_element_at(table, lowered)


def corrected_query(query: Column, correction: Column) -> Column:
    """Dictionary expansion first, then a differing correction, then the query itself."""
    original = strip(query)
    differing = F.when(F.lower(strip(correction)) != F.lower(original), strip(correction))
    return F.when(original == "", F.lit("")).otherwise(
        F.coalesce(expand_query(query), differing, original)
    )


def query_variants(query: Column) -> Column:
    """Search texts for one query, most specific first, unique ignoring case."""
    original = strip(query)
    lowered = F.lower(original)
    simplified = F.when(
        has(lowered, r"^iphone\s+\d+\s+se\b"),
        F.regexp_replace(original, r"(?iU)(iphone)\s+\d+\s+(se\b.*)", "$1 $2"),
    )
    swapped = original
    for cyrillic, latin in (("айфон", "iphone"), ("Айфон", "iPhone"), ("АЙФОН", "IPHONE")):
        swapped = F.replace(swapped, F.lit(cyrillic), F.lit(latin))
    swapped = F.when(
        original.rlike("[Ѐ-ӿ]")
        & lowered.contains("айфон")
        & (F.lower(swapped) != lowered),
        strip(swapped),
    )
    branded = F.when(
        ~lowered.contains("apple") & ~F.lower(swapped).contains("apple"),
        F.concat(F.lit("Apple "), swapped),
    )
    phone = has(original, "айфон") | (
        has(lowered, r"iphone\s+\d{1,2}\b") & ~lowered.contains(" se")
    )
    optics = has(original, "очк")

    def suffixed(text: Column, suffix: str) -> Column:
        return F.concat(text, F.lit(f" {suffix}"))

    candidates = F.array(
        original,
        simplified,
        swapped,
        branded,
        F.when(phone, suffixed(original, "купить")),
        F.when(phone, suffixed(swapped, "купить")),
        F.when(optics, suffixed(original, "купить")),
        F.when(optics, F.lit("оправы для очков")),
        suffixed(original, "купить"),
        suffixed(original, "цена"),
        suffixed(original, "интернет-магазин"),
    )
    kept = F.filter(F.transform(candidates, strip), lambda x: x.isNotNull() & (x != ""))
    return F.when(original == "", text_array([])).otherwise(unique_ignoring_case(kept))


def query_tokens(query: Column) -> Column:
    """Words without punctuation, at least two characters, stop words removed."""
    raw = F.split(fold(query), r"(?U)\s+")
    cleaned = F.transform(raw, lambda t: F.regexp_replace(t, r"(?U)[^\w]", ""))
    return F.filter(
        cleaned, lambda t: (F.length(t) >= 2) & ~F.array_contains(text_array(rules.STOP_WORDS), t)
    )


def expanded_tokens(tokens: Column) -> Column:
    """Each token's aliases and the token itself, first occurrence kept."""
    table = F.create_map(
        *chain(*[(F.lit(k), text_array(v)) for k, v in rules.TOKEN_ALIASES.items()])
    )
    return F.array_distinct(
        F.flatten(
            F.transform(
                tokens,
                lambda t: F.concat(
                    F.coalesce(F.try_element_at(table, t), F.array(t)), F.array(t)
                ),
            )
        )
    )


def stem(token: Column) -> Column:
    """Digits stay; a word loses its last character but keeps at least three."""
    folded = fold(token)
    return F.when(folded.rlike(r"^\d+$"), folded).otherwise(
        F.substring(folded, F.lit(1), F.greatest(F.lit(3), F.length(folded) - 1))
    )


def _alias_stem(word: str) -> str:
    folded = word.lower().replace("ё", "е")
    return folded[: max(3, len(folded) - 1)]


def query_needles(query: Column) -> Column:
    """struct<words, nums>: word stems with their alias groups, and number tokens."""
    tokens = F.array_distinct(
        F.transform(
            F.filter(
                F.regexp_extract_all(query, F.lit(f"(?iU){_WORD}"), F.lit(1)),
                lambda t: t.rlike(r"^\d+$") | (F.length(t) > 2),
            ),
            stem,
        )
    )
    nums = F.filter(tokens, lambda t: t.rlike(r"^\d+$"))
    base = F.filter(tokens, lambda t: ~t.rlike(r"^\d+$"))
    # No alias stem is another group's trigger, so the groups do not feed each other.
    groups = [
        F.when(
            F.arrays_overlap(base, text_array(triggers)),
            text_array([_alias_stem(a) for a in aliases]),
        ).otherwise(text_array([]))
        for triggers, aliases in rules.NEEDLE_ALIASES
    ]
    words = F.array_distinct(F.concat(base, *groups))
    return F.struct(words.alias("words"), nums.alias("nums"))


def is_relevant(title: Column, words: Column, nums: Column) -> Column:
    """All numbers occur, and a word stem equals a title stem or occurs in the title."""
    lowered = fold(title)
    stems = F.transform(F.regexp_extract_all(lowered, F.lit(f"(?iU){_WORD}"), F.lit(1)), stem)
    return (
        ~has(lowered, f"(?:{rules.BAD_TITLE})")
        & F.forall(nums, lambda n: lowered.contains(n))
        & (
            (F.size(words) == 0)
            | F.arrays_overlap(words, stems)
            | F.exists(words, lambda w: lowered.contains(w))
        )
    )


def title_matches(title: Column, tokens: Column) -> Column:
    """Looser test: an alias, a token or a token's first three characters occur."""
    lowered = F.lower(title)
    return (
        (F.size(tokens) == 0)
        | F.exists(expanded_tokens(tokens), lambda a: lowered.contains(a))
        | F.exists(
            tokens,
            lambda t: lowered.contains(t)
            | ((F.length(t) >= 3) & lowered.contains(F.substring(t, 1, 3))),
        )
    )


def is_accessory(title: Column, tokens: Column) -> Column:
    """Title off the query, or an accessory word the query did not ask for."""
    lowered = fold(title)
    joined = F.array_join(tokens, " ")
    wants_accessory = contains_any(joined, rules.ACCESSORY_QUERY_WORDS)
    unasked = F.lit(False)
    for word in rules.ACCESSORY_WORDS:
        unasked = unasked | (lowered.contains(word) & ~joined.contains(word) & ~wants_accessory)
    return ((F.size(tokens) > 0) & ~title_matches(lowered, tokens)) | unasked


def classify_query(query: Column) -> Column:
    """Category by hint word, else by best prototype overlap, else ``unknown``."""
    lowered = F.lower(query)
    scored = F.array(
        *[
            F.struct(
                token_overlap(query, F.lit(text)).alias("score"),
                F.lit(-order).alias("earlier"),
                F.lit(name).alias("name"),
            )
            for order, (name, text) in enumerate(rules.CATEGORY_PROTOTYPES.items())
        ]
    )
    best = F.filter(
        F.array(F.array_max(scored)), lambda s: s["score"] >= rules.CATEGORY_SIMILARITY
    )
    by_score = F.coalesce(F.get(best, 0)["name"], F.lit("unknown"))
    result = by_score
    for name, hints in reversed(rules.CATEGORY_HINTS):
        result = F.when(contains_any(lowered, hints), name).otherwise(result)
    return F.when(strip(query) == "", "unknown").otherwise(result)


def classify_slug(slug: Column) -> Column:
    """First category with a keyword inside the slug, NULL when none."""
    lowered = F.lower(slug)
    result = F.lit(None).cast("string")
    for name, keywords in reversed(rules.SLUG_CATEGORIES):
        result = F.when(contains_any(lowered, keywords), name).otherwise(result)
    return result


def sitemap_tokens(query: Column, category: Column) -> Column:
    """Query words plus the URL hints and prototype words of the query's category."""
    lowered = F.lower(query)
    own = F.filter(F.split(lowered, r"(?U)\W+"), lambda t: F.length(t) > 2)
    extra = text_array([])
    for name, keywords, hints in reversed(rules.SITEMAP_HINTS):
        words = text_array([*hints, *rules.CATEGORY_PROTOTYPES[name].split()])
        extra = F.when(
            (category == name) | contains_any(lowered, keywords), words
        ).otherwise(extra)
    return F.array_distinct(F.concat(own, extra))


def geo_query(query: Column, region_id: Column, region_name: Column) -> Column:
    """Query with the region's name appended, except in the default region."""
    return F.when(
        region_id != rules.DEFAULT_REGION, strip(F.concat_ws(" ", query, region_name))
    ).otherwise(query)


def resolve_region(region_id: Column) -> Column:
    """Known region id in lower case, anything else the default."""
    lowered = F.lower(strip(region_id))
    return F.when(lowered.isin(*[r[0] for r in rules.REGIONS]), lowered).otherwise(
        F.lit(rules.DEFAULT_REGION)
    )


def attempts(original: Column, corrected: Column) -> Column:
    """Texts to try in turn: original, then corrected when it differs; blanks dropped."""
    return F.array_distinct(
        F.filter(F.array(strip(original), strip(corrected)), lambda t: t != "")
    )


def correction_from_text(html: Column) -> Column:
    """Suggested correction stated in a result page's text, NULL when absent."""
    found = []
    for pattern in rules.CORRECTION_PATTERNS:
        candidate = strip(first_match(html, pattern))
        found.append(
            F.when(
                (candidate != "") & ~candidate.startswith("/") & ~candidate.startswith("http"),
                candidate,
            )
        )
    return F.coalesce(*found)
