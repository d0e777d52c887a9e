"""Whole plans on small stored inputs."""

import json

from offerloom.operators import extraction
from offerloom.plans.marketplaces import broad_source, payload_source
from offerloom.plans.other_shops import collect_other_shops

PAD = "<p>" + "x" * 300 + "</p>"


def product(name, price):
    data = {"@type": "Product", "name": name, "offers": {"price": price}}
    return f'<script type="application/ld+json">{json.dumps(data)}</script>{PAD}'


def test_other_shops(spark):
    grid = "".join(
        f'<div><a href="/product/mouse-{i}">Мышь модель {i}{c}</a><b>{500 + i} ₽</b></div>' for i, c in enumerate("abcdefg")
    )
    pages = [
        # a listing of the known category: five of one shop at most
        ("https://grid.ru/catalog/mice/list/", grid + PAD),
        # a listing without cards leads to product pages
        ("https://deep.ru/catalog/lamps/list/", '<a href="/product/l1">1</a><a href="/product/l2">2</a>' + PAD),
        ("https://deep.ru/product/l1", product("Лампа настольная", "1500")),
        ("https://deep.ru/product/l2", product("Стол", "9000")),
        ("https://one.ru/product/5", product("Лампа красная", "700")),
        ("https://gone.ru/product/6", product("Лампа белая", "800")),
        ("https://avito.ru/product/7", product("Лампа синяя", "900")),
    ]
    stored = spark.createDataFrame(
        [(u, 404 if "gone" in u else 200, h) for u, h in pages], "url string, status int, html string"
    )
    hits = spark.createDataFrame(
        [("m", 0, "https://grid.ru/catalog/mice/list/"), ("l", 0, "https://deep.ru/catalog/lamps/list/"),
         ("l", 1, "https://one.ru/product/5#a"), ("l", 2, "https://gone.ru/product/6"), ("l", 3, "https://avito.ru/product/7")],
        "search_id string, position bigint, url string",
    ).selectExpr("*", "'' as title", "'' as snippet", "'yahoo' as provider", "0D as similarity")
    searches = spark.createDataFrame(
        [("m", "мышь", "orgtech"), ("l", "лампа", "unknown")], "search_id string, query string, category string"
    )
    links = extraction.page_links(stored.drop("status")).withColumnRenamed("url", "page")
    rows = collect_other_shops(searches, hits, stored, links).orderBy("search_id", "position").collect()
    got = {}
    for r in rows:
        got.setdefault(r["search_id"], []).append((r["title"], r["price"]))
    assert got["m"] == [(f"Мышь модель {i}{c}", (500 + i) * 100) for i, c in enumerate("abcde")]
    assert sorted(got["l"]) == [("Лампа красная", 70000), ("Лампа настольная", 150000)]


def test_marketplace_sources(spark):
    body = json.dumps({"products": [{"id": i, "name": f"n{i}", "salePriceU": 100} for i in range(1, 20)]})
    assert payload_source(spark.createDataFrame([("s", body)], "search_id string, body string")).count() == 15
    tiles = "".join(
        f'<div class="tile-root"><a href="/product/{i}/" aria-label="Товар {i}"></a><span class="tsHead500Medium">{i}00 ₽</span></div>'
        for i in range(1, 5)
    )
    offers = broad_source(spark.createDataFrame([("s", tiles)], "search_id string, html string")).orderBy("position")
    assert [(r["title"], r["price"], r["source"]) for r in offers.collect()][:1] == [("Товар 1", 10000, "ozon")]
