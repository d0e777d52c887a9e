"""URL parts and page-kind rules.

``parse_url`` raises on bad input and loses Cyrillic hosts, so the parts come from
patterns. Rules take the parts as Columns; ``offerloom.operators.urls.classify_urls``
computes the parts once per row and applies them all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions.text import (
    any_of,
    contains_any,
    has,
    strip,
)

_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _NETLOC, 1))


def host(url: Column) -> Column:
    """Lower-cased host without a leading ``www.``."""
    return F.regexp_replace(netloc(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, _PATH, 1), ";[^/]*$", "")


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, _QUERY, 1)


def depth(url_path: Column) -> Column:
    """Number of non-empty path segments."""
    return F.regexp_count(url_path, F.lit("[^/]+"))


def last_segment(url_path: Column) -> Column:
    """Last non-empty path segment, '' when there is none."""
    return F.regexp_extract(url_path, "([^/]+)/*$", 1)


def has_segment(url_path: Column, pattern: str) -> Column:
    """A whole path segment matches the pattern; no array is built, so it stays compiled."""
    return url_path.rlike(f"(?:^|/)(?:{pattern})(?:/|$)")


def url_key(url: Column, level: int = 1) -> Column:
    """Dedup key: 1 drops the fragment, 2 also the query, 3 also trailing slashes."""
    if level == 1:
        return F.substring_index(url, "#", 1)
    base = F.concat(
        F.lower(F.regexp_extract(url, _SCHEME, 1)),
        F.lit("://"),
        F.regexp_extract(url, _NETLOC, 1),
    )
    if level == 2:
        return F.concat(base, path(url))
    return F.concat(base, F.regexp_replace(path(url), "/+$", ""))


def _on_host(host_col: Column, domains) -> Column:
    """Host is one of the domains or below one of them."""
    return host_col.rlike(rf"(?:^|\.)(?:{any_of(domains)})$")


def on_domain(host_col: Column, *domains: str) -> Column:
    return _on_host(host_col, domains)


def is_blacklisted(host_col: Column, match: str = "contains") -> Column:
    """``contains`` also drops hosts that merely contain a listed name; ``suffix`` does not."""
    if match == "suffix":
        return _on_host(host_col, rules.BLACKLIST)
    return contains_any(host_col, rules.BLACKLIST)


def is_rejected(url: Column, host_col: Column, path_col: Column, query_col: Column) -> Column:
    return (
        _on_host(host_col, rules.REJECT_HOSTS)
        | has(F.concat(path_col, query_col), f"(?:{rules.REJECT_PATH})")
        | has(url, f"(?:{rules.FOREIGN_LOCALE})")
    )


def is_ru(host_col: Column) -> Column:
    return host_col.endswith(".ru") | host_col.endswith(".рф")


def is_fetch_blocked(host_col: Column) -> Column:
    return host_col.isin(*rules.FETCH_BLOCKED_HOSTS)


_FAMILY = rules.MODEL_FAMILY.removeprefix("^").removesuffix("$")


def has_listing_segment(lowered_path: Column) -> Column:
    """Any segment is a known listing name, has a listing prefix or names a model family."""
    dashed = F.translate(lowered_path, "_", "-")
    names = any_of(rules.LISTING_SLUGS)
    return (
        has_segment(lowered_path, names)
        | has_segment(dashed, f"{names}|{_FAMILY}")
        | lowered_path.rlike(f"(?:^|/)(?:{any_of(rules.LISTING_PREFIXES)})")
    )


def _is_digits(text: Column) -> Column:
    return text.rlike(r"^\d+$")


def looks_like_product(path_col: Column) -> Column:
    lowered = F.lower(path_col)
    last = last_segment(lowered)
    in_catalog = has_segment(lowered, "catalog")
    return (
        F.when(has(lowered, f"(?:{rules.PRODUCT_PATH})") | has(lowered, rules.TIRE_SIZE), True)
        .when(_is_digits(last), ~(in_catalog & (F.length(last) < 5)))
        .when(has_segment(lowered, "product"), True)
        .when(
            in_catalog & (depth(lowered) == 2),
            ~has_listing_segment(last) & has(last, f"(?:{rules.PRODUCT_SLUG})"),
        )
        .otherwise(False)
    )


def in_catalogue(path_col: Column) -> Column:
    return has(path_col, f"(?:{rules.CATALOG_PATH})")


def _is_root(path_col: Column) -> Column:
    return path_col.rlike("^/*$")


def looks_like_listing(path_col: Column, rejected: Column, product: Column) -> Column:
    lowered = F.lower(path_col)
    return ~rejected & ~product & (
        _is_root(lowered) | in_catalogue(lowered) | has_listing_segment(lowered)
    )


def slash_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("/"), F.lit("")))


def quality(
    host_col: Column, path_col: Column, rejected: Column, product: Column, listing: Column
) -> Column:
    """-1 for rejected and pure listing URLs, else higher means more likely a product page."""
    score = (
        F.lit(0.2)
        + F.when(is_ru(host_col), 0.35).otherwise(0.0)
        + F.when(product, 0.4).otherwise(0.0)
        - F.when((slash_count(path_col) <= 3) & ~product, 0.15).otherwise(0.0)
        - F.when(is_fetch_blocked(host_col), 0.5).otherwise(0.0)
    )
    catalogue_only = (listing | in_catalogue(path_col)) & ~product
    return F.when(rejected | catalogue_only, F.lit(-1.0)).otherwise(score)


def depth_bonus(path_col: Column) -> Column:
    levels = depth(path_col)
    return F.when(levels >= 3, 0.12).when(levels <= 1, -0.08).otherwise(0.0)


def _grid_path(path_col: Column) -> Column:
    return F.regexp_replace(F.lower(path_col), "/+$", "")


def is_grid(path_col: Column, rejected: Column, product: Column) -> Column:
    """Page that may hold a grid of offers worth reading as a whole."""
    trimmed = _grid_path(path_col)
    levels = depth(trimmed)
    return ~rejected & ~product & (
        (levels == 0)
        | (has_segment(trimmed, "catalog") & (levels <= 4))
        | has_segment(trimmed, any_of(rules.GRID_SLUGS))
        | contains_any(trimmed, rules.GRID_PATH_TOKENS)
        | ((levels <= 2) & ~_is_digits(last_segment(trimmed)))
    )


def grid_priority(host_col: Column, path_col: Column) -> Column:
    trimmed = _grid_path(path_col)

    def points(condition: Column, value: float) -> Column:
        return F.when(condition, value).otherwise(0.0)

    by_host = (
        F.when(_on_host(host_col, ("dns-shop.ru",)), 0.3)
        .when(_on_host(host_col, ("technocity.ru",)), 1.0)
        .when(host_col.contains("e2e4online.ru"), 1.0)
        .when(_on_host(host_col, ("citilink.ru",)), 0.6)
        .when(host_col.contains("technopark.ru") | (host_col == "mvideo.ru"), 0.4)
        .otherwise(0.0)
    )
    return (
        points(trimmed.contains("/catalog/"), 1.0)
        + points(contains_any(trimmed, rules.GRID_PRIORITY_HINTS), 0.6)
        + points(depth(trimmed) >= 3, 0.2)
        + by_host
        + points(contains_any(trimmed, rules.GRID_MOUSE_TOKENS), 0.7)
        - points(trimmed.contains("proizvoditel--"), 0.4)
        - points(contains_any(host_col, ("beeline.ru", "blizko.ru")), 0.6)
        - points(trimmed == "", 0.3)
    )


def host_suffixes(host_col: Column) -> Column:
    """All suffixes of a host on label borders, longest first: a.b.c, b.c, c."""
    labels = F.split(host_col, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def domain_rule(host_col: Column) -> Column:
    """Name of the first domain rule whose domain is the host or a suffix of it."""
    result = F.lit(None).cast("string")
    for name, domains, *_ in reversed(rules.DOMAIN_RULES):
        result = F.when(_on_host(host_col, domains), name).otherwise(result)
    return result


def listing_key(host_col: Column) -> Column:
    """Shared key of a shop's regional hosts, else the host itself."""
    result = host_col
    for _, domains, _, group, *_ in reversed(rules.DOMAIN_RULES):
        result = F.when(_on_host(host_col, domains), group or host_col).otherwise(result)
    return result


def is_category_listing(title: Column, path_col: Column, product: Column) -> Column:
    """Title or URL of a category page rather than of one offer."""
    lowered = F.lower(title)
    return (
        has(lowered, f"(?:{rules.CATEGORY_PHRASE})")
        | (lowered.contains(" купить в ") & ~title.rlike(r"(?U)\d"))
        | (
            ~product
            & (
                has(title, f"(?:{rules.CATEGORY_TITLE})")
                | (has_segment(path_col, "catalog") & (depth(path_col) <= 4))
                | last_segment(path_col).isin(*rules.CATEGORY_LAST_SEGMENTS)
            )
        )
    )


def market_product(url: Column) -> Column:
    """(slug, numeric id) of a marketplace product URL, NULL for any other URL."""
    url_path = path(url)
    matches = netloc(url).isin(*rules.MARKET_PRODUCT_HOSTS) & url_path.rlike(
        rules.MARKET_PRODUCT_PATH
    )
    return F.when(
        matches,
        F.struct(
            F.regexp_extract(url_path, rules.MARKET_PRODUCT_PATH, 1).alias("slug"),
            F.regexp_extract(url_path, rules.MARKET_PRODUCT_PATH, 2).alias("numeric_id"),
        ),
    )


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute form of a link found on ``base`` (``.`` and ``..`` segments resolved)."""
    scheme = F.lower(F.regexp_extract(base, _SCHEME, 1))
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(base, _NETLOC, 1))
    base_path = F.regexp_extract(base, _PATH, 1)
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    joined = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, base_path, href))
        .when(href == "", base)
        .otherwise(
            F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), href)
        )
    )
    return F.when(joined.rlike(_DOTTED), _without_dots(joined)).otherwise(joined)


#: A path with a segment of one or two dots.
_DOTTED = r"^[^?#]*?://[^?#]*/\.{1,2}(?:[/?#]|$)"
_PARTS = r"^([^:/?#]+://[^/?#]*)([^?#]*)(.*)$"


def _without_dots(url: Column) -> Column:
    """The URL with ``.`` and ``..`` segments of its path resolved, however many there are."""
    segments = F.split(F.substring(F.regexp_extract(url, _PARTS, 2), 2, 2**31 - 1), "/")
    nothing = F.array().cast("array<string>")
    kept = F.aggregate(
        segments,
        nothing,
        lambda path, s: F.when(s == "..", F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))))
        .when(s == ".", path)
        .otherwise(F.concat(path, F.array(s))),
    )
    ends_in_folder = F.element_at(segments, -1).isin(".", "..")
    path = F.concat(kept, F.when(ends_in_folder, F.array(F.lit(""))).otherwise(nothing))
    return F.concat(
        F.regexp_extract(url, _PARTS, 1),
        F.lit("/"),
        F.array_join(path, "/"),
        F.regexp_extract(url, _PARTS, 3),
    )


def redirect_target(href: Column) -> Column:
    """Target of a search engine's redirect link, or the link itself when it is plain."""
    absolute = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)
    target = F.try_url_decode(F.regexp_extract(absolute, r"[?&]uddg=([^&#]+)", 1))
    resolved = F.when(
        absolute.contains("duckduckgo.com/l/") & absolute.contains("uddg=") & (target != ""),
        target,
    ).otherwise(absolute)
    return F.when(resolved.startswith("http"), resolved)


def breadcrumb_url(cite: Column, loose: bool = False) -> Column:
    """URL from a breadcrumb line such as ``https://shop.ru › catalog › 12``.

    ``loose`` accepts text before the URL and drops all spaces inside the path.
    """
    text = strip(cite)
    pattern = r"https?://[^\s›]+" if loose else r"^https?://[^\s›]+"
    head = F.regexp_extract(text, f"(?U){pattern}", 0)
    base = F.regexp_replace(head, "/+$", "")
    if loose:
        rest = F.when(
            text.contains("›"), F.substring(text, F.instr(text, "›") + 1, F.length(text))
        ).otherwise(F.lit(""))
        tail = F.regexp_replace(
            F.replace(F.translate(rest, "›", "/"), F.lit(" "), F.lit("")), "^/+|/+$", ""
        )
        url = F.when(tail == "", base).otherwise(F.concat_ws("/", base, tail))
    else:
        rest = strip(F.substring(text, F.length(head) + 1, F.length(text)))
        crumbs = F.when(
            rest.startswith("›"),
            F.translate(
                F.replace(
                    strip(F.regexp_replace(rest, "^›+", "")), F.lit(" › "), F.lit("/")
                ),
                "›",
                "/",
            ),
        ).otherwise(rest)
        slashed = F.when(crumbs.startswith("/"), crumbs).otherwise(
            F.concat(F.lit("/"), F.translate(crumbs, " ", "/"))
        )
        url = F.when(crumbs == "", base).otherwise(F.concat(base, slashed))
    return F.when(head != "", url)


def is_sitemap_product(loc: Column) -> Column:
    return has(loc, f"(?:{rules.SITEMAP_PRODUCT})")


def slug_title(path_col: Column) -> Column:
    """Last path part with dashes and underscores as spaces."""
    return F.translate(F.substring_index(path_col, "/", -1), "-_", "  ")


def original_image(url: Column) -> Column:
    """Full-size image instead of a thumbnail size suffix; NULL becomes ''."""
    cleaned = strip(F.coalesce(url, F.lit("")))
    return F.when(
        has(cleaned, rules.THUMBNAIL),
        F.concat(F.regexp_extract(cleaned, f"(?iU){rules.THUMBNAIL}", 1), F.lit("/orig")),
    ).otherwise(cleaned)


def image_allowed(url: Column, shop_domain: Column) -> Column:
    """Image host is allow-listed or belongs to the offer's own shop."""
    image_host = host(url)
    shop = F.regexp_replace(F.lower(F.coalesce(shop_domain, F.lit(""))), r"^www\.", "")
    own = (shop != "") & ((image_host == shop) | image_host.endswith(F.concat(F.lit("."), shop)))
    return own | _on_host(image_host, rules.IMAGE_HOSTS)


def real_image(url: Column) -> Column:
    """The URL when it is a real picture, NULL for placeholders and inline data."""
    return F.when(
        url.startswith("http") & ~contains_any(F.lower(url), rules.PLACEHOLDER_IMAGES), url
    )


def cdn_host(article: Column) -> Column:
    """Image host number of an article from the range table (clamped)."""
    volume = F.floor(article / 100_000)
    number = F.lit(rules.CDN_RANGES[-1][1] + 1)
    for upper, host_number in reversed(rules.CDN_RANGES):
        number = F.when(volume <= upper, host_number).otherwise(number)
    return F.least(F.lit(rules.CDN_MAX), F.greatest(F.lit(rules.CDN_MIN), number))


def cdn_image_url(article: Column, host_number: Column | None = None) -> Column:
    number = cdn_host(article) if host_number is None else host_number
    return F.format_string(
        "https://basket-%02d.wbbasket.ru/vol%d/part%d/%d/images/big/1.webp",
        number.cast("int"),
        F.floor(article / 100_000).cast("bigint"),
        F.floor(article / 1_000).cast("bigint"),
        article.cast("bigint"),
    )


def cdn_candidates(article: Column) -> Column:
    """Host numbers to try, from the table's answer upward."""
    hint = cdn_host(article)
    return F.sequence(hint, F.least(F.lit(rules.CDN_MAX), hint + rules.CDN_PROBE_DEPTH))
