"""Pages to offers: JSON-LD, metadata, cascades, listings, links and the index build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions import markup as m
from offerloom.functions import price as p
from offerloom.functions import query as q
from offerloom.functions import url as u
from offerloom.functions.text import first_of_each, has, strip
from offerloom.operators.cards import grid_cards
from offerloom.operators.planning import computed_once
from offerloom.operators.urls import url_kinds


def _with_products(pages: DataFrame) -> DataFrame:
    """Add ``_ld``: the page's distinct JSON-LD products."""
    parsed = computed_once(pages, {"_blocks": m.jsonld_blocks(F.col("html"))})
    listed = computed_once(parsed, {"_all": m.jsonld_products(F.col("_blocks"))})
    return computed_once(listed, {"_ld": m.distinct_products(F.col("_all"))}).drop(
        "_blocks", "_all"
    )


def jsonld_products(pages: DataFrame) -> DataFrame:
    """Every JSON-LD product of each page, in document order; no shuffle, no Python."""
    kept = [c for c in pages.columns if c != "html"]
    rows = _with_products(pages).select(
        *kept, F.posexplode("_ld").alias("position", "_p")
    )
    return rows.select(*kept, "position", "_p.*")


def jsonld_first(pages: DataFrame) -> DataFrame:
    return jsonld_products(pages).where(F.col("position") == 0).drop("position")


def _with_meta(pages: DataFrame) -> DataFrame:
    """Add ``_ld`` and ``_m_*``; each pass over the page text is planned once."""
    seen = computed_once(_with_products(pages), {"_seen": m.visible(F.col("html"))})
    tagged = computed_once(
        seen, {"_metas": m.tags(F.col("_seen"), "meta"), "_links": m.tags(F.col("_seen"), "link")}
    )
    meta = m.metadata(
        F.col("html"), F.col("_seen"), F.col("_metas"), F.col("_links"), F.col("url"),
        F.get("_ld", 0)["price_raw"],
    )
    # flat columns: nested ones would be pruned through the generator
    fields = {f"_m_{name}": meta[name] for name in m.META_FIELDS}
    return computed_once(tagged, fields).drop("_metas", "_links")



def page_meta(pages: DataFrame) -> DataFrame:
    """Metadata of each page with the lists of found and missing fields."""
    kept = [c for c in pages.columns if c != "html"]
    meta = {name: F.col(f"_m_{name}") for name in m.META_FIELDS}
    return _with_meta(pages).select(
        *kept,
        *[c.alias(name) for name, c in meta.items()],
        m.coverage(meta, True).alias("fields_extracted"),
        m.coverage(meta, False).alias("fields_missing"),
    )


def _clean_image(image: Column, base: Column) -> Column:
    resolved = u.resolve_link(base, strip(image))
    return F.when(
        (strip(image) != "") & resolved.startswith("http"), resolved
    ).otherwise(F.lit(""))


def extract_offers(pages: DataFrame) -> DataFrame:
    """One offer per product page, with method and confidence.

    Trusted shops use JSON-LD, then metadata when it has no title. Other pages use JSON-LD
    and let metadata replace it when title or price is missing. The price runs through the
    plausibility cascade; a page without title or price gives nothing.
    """
    kept = [c for c in pages.columns if c not in ("html", "url")]
    base = computed_once(_with_meta(pages), {"host": u.host(F.col("url"))})
    ld = F.get("_ld", 0)
    meta = {name: F.col(f"_m_{name}") for name in m.META_FIELDS}
    adapter = F.lit(None).cast("string")
    for domain in reversed(rules.ADAPTER_DOMAINS):
        adapter = F.when(u.on_domain(F.col("host"), domain), domain).otherwise(adapter)
    raw_names = ("title", "description", "image_url", "product_url", "price_raw")
    base = computed_once(
        base, {"_adapter": adapter, **{f"_r_{name}": ld[name] for name in raw_names}}
    )
    trusted = F.col("_adapter").isNotNull()
    raw = {name: F.col(f"_r_{name}") for name in raw_names}
    no_title = F.coalesce(raw["title"], F.lit("")) == ""
    use_meta = no_title | (~trusted & raw["price_raw"].isNull())
    itemprop = F.regexp_extract("html", r'itemprop="price"[^>]*content="(\d+)"', 1).try_cast("bigint")
    meta_price = F.when(use_meta, meta["price_rub"])
    stated = F.coalesce(
        meta_price,
        F.when(F.col("_adapter").isin(*rules.ADAPTER_ITEMPROP_DOMAINS), itemprop),
    )
    merged = computed_once(
        base,
        {
            "_title": strip(
                F.coalesce(
                    F.when(use_meta, meta["title"]), raw["title"], F.lit("")
                )
            ),
            "_desc": strip(
                F.coalesce(F.when(use_meta, meta["description"]), raw["description"], F.lit(""))
            ),
            "_image": F.coalesce(
                F.nullif(
                    strip(F.coalesce(F.when(use_meta, meta["image_url"]), raw["image_url"])),
                    F.lit(""),
                ),
                m.first_image(
                    m.tags(F.col("_seen"), "img"), "data-src", "data-lazy-src", "data-original",
                    "src",
                ),
                F.lit(""),
            ),
            "_stated": stated,
            "_raw": raw["price_raw"],
            "_from_meta": use_meta & ~trusted,
            "_by_meta": use_meta & ~trusted & meta["title"].isNotNull(),
            "product_url": strip(F.coalesce(raw["product_url"], F.col("url"))),
        },
    )
    priced = computed_once(
        merged,
        {
            "price_rub": p.page_price(
                F.col("html"),
                F.coalesce("_stated", p.parse_price(F.col("_raw"))),
                F.concat_ws(" ", "_title", "_desc", F.coalesce("_raw", F.lit(""))),
            ),
            "_attr": p.has_price_attribute(F.col("html")),
            "_text": p.has_price_text(F.col("html")),
        },
    ).where((F.col("_title") != "") & F.col("price_rub").isNotNull())
    unstated = F.col("_stated").isNull() & (F.coalesce("_raw", F.lit("")) == "")
    by_pattern = unstated & (F.col("_attr") | F.col("_text"))
    method = (
        F.when(by_pattern, "regex")
        .when(trusted, F.concat(F.lit("adapter:"), "_adapter"))
        .when(F.col("_by_meta"), "og")
        .otherwise("json_ld")
    )
    confidence = (
        F.when(trusted, rules.CONFIDENCE["adapter"])
        .when(F.col("_from_meta"), rules.CONFIDENCE["og"])
        .otherwise(rules.CONFIDENCE["json_ld"])
    )
    cap = F.when(unstated & F.col("_attr"), rules.CONFIDENCE["regex_attr"]).when(
        unstated & F.col("_text"), rules.CONFIDENCE["regex_text"]
    )
    return priced.select(
        *kept,
        "url",
        F.col("_title").alias("title"),
        F.col("_desc").alias("description"),
        "price_rub",
        _clean_image(F.col("_image"), F.col("url")).alias("image_url"),
        "product_url",
        u.host(F.col("product_url")).alias("source_domain"),
        method.alias("method"),
        F.least(confidence, F.coalesce(cap, F.lit(1.0))).alias("confidence"),
    )


def adapter_offers(pages: DataFrame) -> DataFrame:
    """Offers of trusted shops only."""
    return extract_offers(
        pages.where(u.on_domain(u.host(F.col("url")), *rules.ADAPTER_DOMAINS))
    )


def extract_listings(pages: DataFrame, limit: int = rules.LISTING_ITEMS) -> DataFrame:
    """Offers of listing pages: JSON-LD items, then cards, distinct by link.

    Both lists belong to one page, so they are joined, checked and numbered as arrays inside
    its row; only pages that can hold a card go through the tree walk.
    """
    kept = [c for c in pages.columns if c not in ("html", "url")]
    base = computed_once(_with_products(pages), {"host": u.host(F.col("url"))})
    may_hold_cards = has(F.col("html"), r"href\s*=") & has(F.col("html"), r"₽|руб|&#8381;|price")
    cards = grid_cards(
        F.when(may_hold_cards, F.col("html")).otherwise(F.lit("")), F.col("host")
    )
    base = base.withColumn("_cards", cards)
    json_items = F.transform(
        F.filter(
            "_ld",
            lambda x: (F.coalesce(strip(x["product_url"]), F.lit("")) != ""),
        ),
        lambda x: F.struct(
            strip(x["title"]).alias("title"),
            strip(F.coalesce(x["description"], F.lit(""))).alias("description"),
            p.parse_price(x["price_raw"]).alias("price_rub"),
            _clean_image(F.coalesce(x["image_url"], F.lit("")), F.col("url")).alias("image_url"),
            strip(x["product_url"]).alias("product_url"),
            F.lit("json_ld_listing").alias("method"),
            F.lit(rules.CONFIDENCE["json_ld_listing"]).alias("confidence"),
        ),
    )
    card_items = F.transform(
        "_cards",
        lambda x: F.struct(
            strip(x["title"]).alias("title"),
            F.lit("").alias("description"),
            x["price_rub"].alias("price_rub"),
            _clean_image(F.coalesce(x["image"], F.lit("")), F.col("url")).alias("image_url"),
            u.resolve_link(F.col("url"), x["href"]).alias("product_url"),
            F.lit("dom_listing").alias("method"),
            F.lit(rules.CONFIDENCE["dom_listing"]).alias("confidence"),
        ),
    )
    # The card reader keeps the first card of each link and at most ``limit`` of them.
    distinct_cards = F.slice(
        first_of_each(F.col("_c"), lambda x: u.url_key(x["product_url"])), 1, limit
    )
    listed = computed_once(
        computed_once(base, {"_j": json_items, "_c": card_items}),
        {"_items": F.concat(F.col("_j"), distinct_cards)},
    )

    def sound(x: Column) -> Column:
        path = u.path(x["product_url"])
        return F.coalesce(
            (x["title"] != "") & (x["price_rub"] > 0) & x["product_url"].startswith("http"),
            F.lit(False),
        ) & ~u.is_category_listing(x["title"], path, u.looks_like_product(path))

    checked = computed_once(listed, {"_good": F.filter("_items", sound)})
    distinct = first_of_each(F.col("_good"), lambda x: u.url_key(x["product_url"]))
    rows = checked.select(
        *kept,
        F.col("url").alias("page_url"),
        F.posexplode(F.slice(distinct, 1, limit)).alias("position", "_o"),
    )
    return rows.select(
        *kept, "page_url", "position", "_o.*", u.host(F.col("_o.product_url")).alias("source_domain")
    )


def page_links(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Same-host links of each page as ``product`` or ``catalogue``, first occurrence.

    Article numbers mentioned in catalogue paths count as links too. Links appear in page
    order (``position``).
    """
    kept = [c for c in pages.columns if c != "html"]
    base = F.col(url_col)
    hrefs = F.transform(
        F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*?\shref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1)),
        lambda h: F.struct(m.unescape(h).alias("href"), F.lit("link").alias("kind")),
    )
    skus = F.transform(
        F.filter(
            F.regexp_extract_all("html", F.lit(f"(?i){rules.HARVEST_SKU}"), F.lit(1)),
            lambda s: ~F.lower(s).isin(*rules.HARVEST_CATEGORY_SLUGS)
            & ~F.lower(s).startswith("brand_"),
        ),
        lambda s: F.struct(
            F.concat(F.lit("/catalog/"), s, F.lit("/")).alias("href"), F.lit("sku").alias("kind")
        ),
    )
    usable = F.filter(
        F.concat(hrefs, skus), lambda x: (x["href"] != "") & ~x["href"].startswith("#")
    )
    resolved = F.transform(
        usable,
        lambda x: F.struct(
            u.url_key(u.resolve_link(base, x["href"])).alias("link"), x["kind"].alias("kind")
        ),
    )
    same_host = F.filter(resolved, lambda x: u.netloc(x["link"]) == u.netloc(base))
    found = computed_once(pages, {"_found": same_host}).drop("html")
    first = first_of_each(F.col("_found"), lambda x: x["link"])
    rows = found.select(*kept, F.posexplode(first).alias("position", "_x")).select(
        *kept, "position", F.col("_x.link").alias("link"), F.col("_x.kind").alias("kind")
    )
    flagged = url_kinds(
        rows.withColumnRenamed(url_col, "_base").select(
            F.struct(*[F.col("_base" if c == url_col else c).alias(c) for c in kept]).alias("_k"),
            "position", F.col("link").alias("url"), "kind",
        )
    )
    path = F.col("path")
    skipped = has(path, f"(?:{rules.HARVEST_SKIP_PATH})")
    lowered = F.lower(path)
    is_product = (
        F.col("product") & ~skipped & ~lowered.contains("/all_sizes/")
        & ~lowered.contains("/category/")
    )
    is_catalogue = F.col("listing") | has(path, f"(?:{rules.HARVEST_CATALOG_PATH})")
    target = F.when(is_product, "product").when(
        (F.col("kind") == "link") & ~skipped & is_catalogue, "catalogue"
    )
    return (
        flagged.where(~F.col("rejected"))
        .withColumn("target", target)
        .where(F.col("target").isNotNull())
        .select("_k.*", "position", F.col("url").alias("link"), "target")
    )


def build_index(
    sitemap_urls: DataFrame,
    pages: DataFrame,
    per_domain: int = rules.PRECRAWL_PER_DOMAIN,
) -> DataFrame:
    """Index documents from sitemap product URLs and their stored pages.

    ``sitemap_urls``: domain, position, loc. URLs are cut per domain before any page text is
    touched.
    """
    from offerloom.operators.offer_index import document_id
    from offerloom.sources.sitemaps import product_urls

    wanted = product_urls(sitemap_urls, per_domain).select(F.col("loc").alias("url"))
    offers = extract_offers(pages.join(wanted, "url", "left_semi"))
    return offers.select(
        document_id(F.col("source_domain"), F.col("url")).alias("id"),
        "url",
        F.col("source_domain").alias("domain"),
        "title",
        q.classify_query(F.col("title")).alias("category"),
        "image_url",
        (F.col("price_rub") * 100).alias("last_price"),
        F.array().cast("array<string>").alias("keywords"),
        "confidence",
    )
