"""Extraction from page fixtures."""

import gzip
import json
import time

import pytest
from pyspark.sql import functions as F

from offerloom.operators import cards, extraction
from offerloom.operators.searching import corrections_from_pages
from offerloom.sources import serp, sitemaps
from offerloom.sources.payloads import payload_offers, read_payload_products


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, html string")


def ld(data):
    return f'<script type="application/ld+json">{json.dumps(data)}</script>'


def test_single_product(spark):
    html = ld({"@type": "Product", "name": "Ноутбук", "image": "/a.png", "offers": {"price": "64990"}})
    [row] = extraction.extract_offers(pages(spark, ("https://x.ru/p/1", html))).collect()
    assert (row["title"], row["price_rub"], row["method"], row["confidence"]) == (
        "Ноутбук", 64990, "json_ld", 0.8,
    )
    assert row["image_url"] == "https://x.ru/a.png" and row["source_domain"] == "x.ru"


def test_item_list_and_broken_blocks(spark):
    items = [
        {"@type": "ListItem", "item": {"@type": ["Product"], "name": n, "url": f"https://x.ru/product/{n}",
                                       "offers": [{"price": price}]}}
        for n, price in (("a1", 5000), ("b2", 6000.0), ("a1", 5000))
    ]
    html = '<script type="application/ld+json">{bad</script>' + ld(
        [{"@graph": [{"@type": "ItemList", "itemListElement": items}]}]
    )
    rows = extraction.extract_listings(pages(spark, ("https://x.ru/list", html))).collect()
    assert [(r["title"], r["price_rub"], r["method"]) for r in rows] == [
        ("a1", 5000, "json_ld_listing"), ("b2", 6000, "json_ld_listing"),
    ]


def test_implausible_meta_price_is_replaced(spark):
    html = (
        '<meta property="og:title" content="Чай 699 руб."><meta property="product:price:amount" content="1">'
    )
    [row] = extraction.extract_offers(pages(spark, ("https://x.ru/1", html))).collect()
    assert row["price_rub"] == 699


def test_metadata(spark):
    html = """<head><meta content="Книга &quot;A&quot;" property='og:title'/>
      <meta property=og:image content=/i.png><meta property="product:price:amount" content="8 990">
      <link href="https://x.ru/canon" rel="canonical"></head>"""
    [row] = extraction.page_meta(pages(spark, ("https://x.ru/1", html))).collect()
    assert (row["title"], row["price_rub"], row["canonical_url"]) == ('Книга "A"', 8990, "https://x.ru/canon")
    assert "price_rub" in row["fields_extracted"] and row["fields_missing"] == []


CARDS = {
    "text and attribute price": (
        "https://dns-shop.ru/c/",
        """<div class="catalog-product"><a class="catalog-product__name" href="/product/1/">Мышь A</a>
        <div class="catalog-product__price">590 ₽</div></div>
        <div class="catalog-product"><a class="catalog-product__name" href="/product/2/">Мышь B</a>
        <i data-product-price="1290"></i></div>""",
        [("Мышь A", 590), ("Мышь B", 1290)],
    ),
    "bare number": (
        "https://technocity.ru/c/",
        """<article class="catalog-item"><a href="/catalog/detail/9/"></a><div class="name">Коврик</div>
        <span class="price-above-button">650</span></article>""",
        [("Коврик", 650)],
    ),
    "article code is no price": (
        "https://spb.e2e4online.ru/c/",
        """<div><div><a href="/catalog/item/5/">Мышь USB</a></div><p>Код: 123456 485 ₽</p></div>""",
        [("Мышь USB", 485)],
    ),
    "stray amount and review link": (
        "https://shop.ru/c/",
        """<li><a href="/product/1/">Чайник X</a><b>1 ₽</b><b>2 490 ₽</b><a href="/product/1/#rev">отзывы о нём</a></li>
        <li><a href="/product/2/">Чайник Y 30000</a><b>1 500 ₽</b></li>""",
        [("Чайник X", 2490), ("Чайник Y 30000", 1500)],
    ),
}


@pytest.mark.parametrize("case", CARDS)
def test_card_layouts(spark, case):
    url, html, expected = CARDS[case]
    page = f"<html><body><ul>{html}</ul></body></html>"
    rows = extraction.extract_listings(pages(spark, (url, page))).orderBy("position").collect()
    assert [(r["title"], r["price_rub"]) for r in rows] == expected
    assert {r["method"] for r in rows} == {"dom_listing"}


def test_links(spark):
    html = """<a href="/product/1">a</a><a href='/product/1#x'>b</a><a href="https://y.ru/product/2">c</a>
      <a class="z" href="/catalog/smartfony/">d</a><a href="/news/1">e</a><p>/catalog/abc128gb</p>"""
    rows = extraction.page_links(pages(spark, ("https://x.ru/", html))).orderBy("position").collect()
    assert [(r["link"], r["target"]) for r in rows] == [
        ("https://x.ru/product/1", "product"),
        ("https://x.ru/catalog/smartfony/", "catalogue"),
        ("https://x.ru/catalog/abc128gb/", "product"),
    ]


def test_tiles_skip_recommendations_and_badges(spark):
    def tile(n, title, extra=""):
        return (
            f'<div class="tile-root"><a href="/product/{n}/?q=1" aria-label="{title}"></a>{extra}'
            f'<span class="tsBody500Medium">Распродажа</span><span class="tsHead500Medium">1 2{n}0 ₽</span></div>'
        )

    html = (
        '<div data-widget="tileGridDesktop">' + tile(1, "Чайник один") + tile(2, "Реклама тут") + "</div>"
        + '<div data-widget="skuShelf">' + tile(3, "Чайник три") + "</div>"
    )
    rows = cards.broad_offers(pages(spark, ("s", html))).collect()
    assert [(r["title"], r["price"], r["product_url"], r["tier"]) for r in rows] == [
        ("Чайник один", 121000, "https://www.ozon.ru/product/1/", "tiles")
    ]


def test_article_cards(spark):
    html = """<article><h3 data-auto="snippet-title" title="Apple iPhone&amp;nbsp;15, чернильный">x</h3>
      <span data-auto="snippet-price-current">47 746 ₽</span><a href="/card/x/1">l</a>
      <div data-auto="reviews">4.8(120) · 591 купили</div></article><article><h3>Без цены</h3></article>"""
    rows = cards.article_offers(spark.createDataFrame([("s", 1, html)], "search_id string, page int, html string"))
    [row] = rows.collect()
    assert row["price"] == 4774600 and row["rating"] == 4.8 and row["reviews_count"] == 120
    assert row["title"] == "Apple iPhone 15, чернильный" and "Купили: 591" in row["description"]


def test_payloads(spark):
    def item(i, **fields):
        return {"id": i, "name": f"n{i}", **fields}

    bodies = {
        "prices": {"products": [
            item(1, sizes=[{"price": {"product": 4073000}}]), item(2, sizes=[{"price": {"basic": 5000000}}]),
            item(3, salePriceU=199900), item(4, sizes=[])]},
        "throttled": {"data": {"products": [item(1, salePriceU=1)]}},
        "nested": {"data": {"products": [item(i, salePriceU=100) for i in range(1, 9)]}},
        "many": {"products": [item(i, salePriceU=100) for i in range(1, 30)]},
        "empty": {},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in bodies.items()], "search_id string, body string")
    offers = payload_offers(read_payload_products(df))
    counts = {r["search_id"]: r["count"] for r in offers.groupBy("search_id").count().collect()}
    assert counts == {"prices": 3, "nested": 8, "many": 15}
    prices = [r["price"] for r in offers.where("search_id = 'prices'").orderBy("position").collect()]
    assert prices == [4073000, 5000000, 199900]


def test_result_pages(spark):
    bing = ('<li class="b_algo"><h2><a href="#">A</a></h2><cite>https://shop.ru › catalog</cite></li>'
            '<li class="b_algo"><h2><a href="#">B</a></h2><cite>https://www.ozon.ru › x</cite></li>')
    ddg = '<a href="https://shop.ru/1">Хороший товар</a><a href="/x">y</a>'
    df = spark.createDataFrame([("bing", bing), ("ddg", ddg)], "provider string, html string")
    got = {(r["provider"], r["url"], r["title"]) for r in serp.serp_from_html(df).collect()}
    assert got == {("bing", "https://shop.ru/catalog", "A"), ("ddg", "https://shop.ru/1", "Хороший товар")}


def test_json_hits(spark):
    body = {"results": [
        {"url": "https://a.ru/1", "title": "A", "content": ""}, {"url": "https://a.ru/1", "title": "dup"},
        {"url": "ftp://b"}, {"url": "https://avito.ru/2"}, {"url": "https://c.ru/", "snippet": "S"}]}
    df = spark.createDataFrame([("s", json.dumps(body))], "search_id string, body string")
    got = [(r["url"], r["snippet"]) for r in serp.serp_from_json(df).orderBy("rank").collect()]
    assert got == [("https://a.ru/1", ""), ("https://c.ru/", "S")]


def test_sitemaps(spark, tmp_path):
    def xml(*locs):
        body = "".join(f"<url><loc> {x} </loc></url>" for x in locs)
        return f'<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{body}</urlset>'

    (tmp_path / "a.xml").write_text(xml("https://x.ru/product/1", "https://x.ru/product/2"))
    (tmp_path / "b.xml.gz").write_bytes(gzip.compress(xml("https://x.ru/product/3").encode()))
    (tmp_path / "c.xml").write_text(xml("https://x.ru/product/4")[:-12])
    got = {r["loc"] for r in sitemaps.read_sitemap(spark, str(tmp_path)).collect()}
    assert {f"https://x.ru/product/{i}" for i in (1, 2, 3)} <= got

    index = spark.createDataFrame(
        [("x.ru", 0, "https://x.ru/sitemap-product.xml"), ("x.ru", 1, "https://x.ru/blog.xml")],
        "domain string, position bigint, loc string")
    children = spark.createDataFrame(
        [("https://x.ru/sitemap-product.xml", 0, "https://x.ru/product/1"),
         ("https://x.ru/sitemap-product.xml", 1, "https://x.ru/product/1"),
         ("https://x.ru/sitemap-product.xml", 2, "https://x.ru/about"),
         ("https://x.ru/blog.xml", 0, "https://x.ru/product/9")],
        "parent_sitemap string, position bigint, loc string")
    rows = sitemaps.expand_sitemap_index(index, children, 10).collect()
    assert [r["loc"] for r in rows] == ["https://x.ru/product/1"]


def test_corrections(spark):
    rows = [
        ("ipone", "Исправлена опечатка: «iphone»"),
        ("teh", '<div>запрос исправлен <a href="/search/?text=the+end">x</a></div>'),
        ("same", "Исправлена опечатка «SAME»"),
        ("none", "<p>ничего</p>"),
    ]
    df = spark.createDataFrame(rows, "query string, html string")
    got = {r["query"]: r["correction"] for r in corrections_from_pages(df).collect()}
    assert got == {"ipone": "iphone", "teh": "the end"} or got == {"ipone": "iphone"}


def test_json_ld_of_many_products_in_linear_time(spark):
    def page(n):
        items = [
            {"@type": "ListItem", "item": {"@type": "Product", "name": f'p {i} [{{"]', "offers": {"price": str(i + 1)}}}
            for i in range(n)
        ]
        block = [[{"@graph": [{"@type": "ItemList", "itemListElement": items}, {"@type": "Organization"}]}], []]
        return f'<script type="application/ld+json">{json.dumps(block)}</script>'

    def timed(n):
        df = spark.createDataFrame([(1, "https://a.ru/x", page(n))], "page_id int, url string, html string")
        start = time.monotonic()
        rows = extraction.jsonld_products(df).select("position", "title").collect()
        assert [(r.position, r.title) for r in rows] == [(i, f'p {i} [{{"]') for i in range(n)]
        return time.monotonic() - start

    timed(10)
    few, many = timed(4000), timed(40000)
    assert many < 20 * max(few, 1.0)
