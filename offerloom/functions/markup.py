"""JSON-LD and page metadata by patterns and VARIANT values, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions.price import parse_price
from offerloom.functions.text import bound, first_match, first_of_each, strip, unescape

_BLOCK = r'(?s)type="application/ld\+json"[^>]*>(.*?)</script>'


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _text_at(value: Column, path: str) -> Column:
    """A string member; numbers and objects do not count."""
    member = _get(value, path, "variant")
    return F.when(F.schema_of_variant(member) == "STRING", _get(value, path))


def _types(node: Column) -> Column:
    many = _get(node, "$['@type']", "array<string>")
    return F.coalesce(many, F.array(F.coalesce(_get(node, "$['@type']"), F.lit(""))))


def _is_list(node: Column) -> Column:
    """Non-empty list (an empty one holds nothing to unwrap)."""
    return _get(node, "$[0]", "variant").isNotNull()


def _unwrap(node: Column) -> Column:
    """Members of one level of nesting; a product stands for itself."""
    types = _types(node)
    return (
        F.when(_is_list(node), _get(node, "$", "array<variant>"))
        .when(F.array_contains(types, "ListItem"), F.array(_get(node, "$.item", "variant")))
        .when(
            F.array_contains(types, "ItemList")
            & _get(node, "$.itemListElement", "array<variant>").isNotNull(),
            _get(node, "$.itemListElement", "array<variant>"),
        )
        .when(F.array_contains(types, "Product"), F.array(node))
        .otherwise(_get(node, "$['@graph']", "array<variant>"))
    )


def jsonld_blocks(html: Column) -> Column:
    """Parsed JSON-LD blocks of a page; broken ones are left out."""
    raw = F.regexp_extract_all(html, F.lit(_BLOCK), F.lit(1))
    parsed = F.transform(raw, lambda b: F.try_parse_json(strip(b)))
    return F.filter(parsed, lambda v: v.isNotNull())


def _flat(arrays: Column) -> Column:
    return F.filter(
        F.flatten(F.filter(arrays, lambda a: a.isNotNull())), lambda v: v.isNotNull()
    )


def _is_product(node: Column) -> Column:
    return ~_is_list(node) & F.array_contains(_types(node), "Product")


def _depth(text: Column) -> Column:
    """How deep the brackets of a JSON text are nested; those inside strings do not count."""
    unescaped = F.regexp_replace(text, r"(?s)\\.", "")
    outside = F.regexp_replace(unescaped, r'"[^"]*"', "")
    brackets = F.split(F.regexp_replace(outside, r"[^\[\]{}]", ""), "")

    def step(seen: Column, bracket: Column) -> Column:
        now = seen["now"] + F.when(bracket.isin("[", "{"), 1).when(bracket.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(seen["top"], now).alias("top"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))
    return F.aggregate(brackets, start, step)["top"]


def product_nodes(blocks: Column) -> Column:
    """Product nodes of lists, graphs and item lists at any depth, in document order."""
    # No product lies deeper than the block's brackets. Once only products are left, what remains of
    # the steps does nothing.
    nesting = F.array_max(F.transform(blocks, lambda b: _depth(F.to_json(b))))
    nodes = F.aggregate(
        F.sequence(F.lit(0), F.coalesce(nesting, F.lit(0))),
        F.filter(blocks, lambda b: b.isNotNull()),
        lambda nodes, _: F.when(
            F.exists(nodes, lambda n: ~_is_product(n)), _flat(F.transform(nodes, _unwrap))
        ).otherwise(nodes),
    )
    return F.filter(nodes, _is_product)


def _product_fields(node: Column) -> Column:
    offers = _get(node, "$.offers", "variant")
    offer = F.when(_is_list(offers), _get(offers, "$[0]", "variant")).otherwise(offers)
    image = F.coalesce(
        _text_at(node, "$.image"),
        _text_at(node, "$.image[0]"),
        _text_at(node, "$.image[0].url"),
    )
    return F.struct(
        _text_at(node, "$.name").alias("title"),
        _text_at(node, "$.description").alias("description"),
        image.alias("image_url"),
        F.coalesce(_text_at(offer, "$.url"), _text_at(node, "$.url")).alias("product_url"),
        _get(offer, "$.price").alias("price_raw"),
    )


def jsonld_products(blocks: Column) -> Column:
    """Products of a page's blocks, first of each title and price."""
    rows = F.filter(
        F.transform(product_nodes(blocks), _product_fields),
        lambda p: F.coalesce(
            p["title"], p["description"], p["image_url"], p["product_url"], p["price_raw"]
        ).isNotNull(),
    )
    return rows


def _product_key(p: Column) -> Column:
    blank = F.lit("")
    return F.concat_ws(
        "|", F.coalesce(p["title"], blank), F.coalesce(p["price_raw"], blank)
    )


def distinct_products(products: Column) -> Column:
    """The first product of each title and price."""
    return first_of_each(products, _product_key)


def visible(html: Column) -> Column:
    """Page without comments, scripts and styles."""
    return F.regexp_replace(
        html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " "
    )


def tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """Decoded attribute value of one tag, NULL when absent or empty."""
    pattern = rf"(?is)[\s\"']{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
    value = bound(
        F.regexp_extract(tag, pattern, 1),
        lambda v: F.when(
            v.startswith('"') | v.startswith("'"), F.substring(v, F.lit(2), F.length(v) - 2)
        ).otherwise(v),
    )
    return bound(unescape(value), lambda v: F.when(v != "", v))


def _tag_where(found: Column, name: str, value: str) -> Column:
    literal = value.replace(".", r"\.")
    pattern = rf"(?is)[\s\"']{name}\s*=\s*(?:\"{literal}\"|'{literal}'|{literal}[\s/>])"
    return F.get(F.filter(found, lambda t: t.rlike(pattern)), 0)


def meta_content(metas: Column, name: str) -> Column:
    """Content of the meta tag with this property, else with this name."""

    def content(naming: Column) -> Column:
        return F.coalesce(
            attribute(_tag_where(naming, "property", name), "content"),
            attribute(_tag_where(naming, "name", name), "content"),
        )

    # Few tags hold the words; patterns are tried on these alone.
    naming = F.filter(metas, lambda t: t.rlike(f"(?i){name}"))
    return bound(naming, lambda n: F.when(F.size(n) > 0, content(n)))


def link_href(links: Column, rel: str) -> Column:
    return attribute(_tag_where(links, "rel", rel), "href")


def element_text(html: Column, name: str) -> Column:
    """Text of the first element of a kind, NULL when empty."""
    inner = F.regexp_extract(html, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1)
    text = strip(unescape(F.regexp_replace(inner, r"(?s)<[^>]*>", "")))
    return bound(text, lambda t: F.when(t != "", t))


def first_image(images: Column, *attributes: str) -> Column:
    """First image source of a page that is not inline data."""
    sources = F.transform(
        images, lambda t: F.coalesce(*[attribute(t, a) for a in attributes])
    )
    return F.get(
        F.filter(sources, lambda s: s.isNotNull() & ~s.startswith("data:image")), 0
    )


def sign_price(html: Column) -> Column:
    """First amount with a currency sign on the page."""
    return first_match(html, rules.SIGN_PRICE)


META_FIELDS = (
    "title", "image_url", "description", "price_rub", "currency", "availability",
    "canonical_url",
)
_REQUIRED = ("title", "image_url", "price_rub")


def metadata(
    html: Column, seen: Column, metas: Column, links: Column, url: Column, ld_price: Column
) -> dict[str, Column]:
    """Page metadata by field name.

    ``seen`` is the visible page, ``metas`` and ``links`` its tags, ``ld_price`` the raw
    JSON-LD price.
    """
    title = F.coalesce(
        meta_content(metas, "og:title"), element_text(seen, "title"), element_text(seen, "h1")
    )
    image = F.coalesce(
        meta_content(metas, "og:image"),
        link_href(links, "image_src"),
        attribute(F.get(tags(seen, "img"), 0), "src"),
    )
    description = F.coalesce(
        meta_content(metas, "og:description"), meta_content(metas, "description")
    )
    price = bound(
        F.coalesce(
            meta_content(metas, "product:price:amount"),
            F.when(ld_price != "", ld_price),
            sign_price(html),
        ),
        parse_price,
    )
    return {
        "title": title,
        "image_url": image,
        "description": description,
        "price_rub": price,
        "currency": meta_content(metas, "product:price:currency"),
        "availability": meta_content(metas, "product:availability"),
        "canonical_url": F.coalesce(link_href(links, "canonical"), url),
    }


def coverage(meta: dict[str, Column], present: bool) -> Column:
    """Names of the metadata fields that were found, or of the required ones that were not."""
    names = META_FIELDS if present else _REQUIRED
    return F.filter(
        F.array(
            *[
                F.when(meta[n].isNotNull() if present else meta[n].isNull(), n)
                for n in names
            ]
        ),
        lambda x: x.isNotNull(),
    )
