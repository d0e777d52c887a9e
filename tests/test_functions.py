"""Column functions on small literal cases."""

import pytest
from pyspark.sql import functions as F

from offerloom.functions import offer as o
from offerloom.functions import price as p
from offerloom.functions import query as q
from offerloom.functions import text as t
from offerloom.functions import url as u
from offerloom.functions.similarity import token_overlap
from offerloom.operators.urls import classify_urls


def apply(spark, values, fn, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", fn(F.col("v")).alias("r"))
    return [r["r"] for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_parse_price(spark):
    texts = ["8 990 ₽", "12990", "", "1 299 000", "1750.00", "abc", "0", "1 299 ₽", None]
    assert apply(spark, texts, p.parse_price) == [
        8990, 12990, None, 1299000, 1750, None, None, 1299, None,
    ]


def test_price_bounds_and_huge_numbers(spark):
    texts = ["49", "50", "5000001", "XM-90000000 12 990", "9" * 30]
    assert apply(spark, texts, p.plausible_price) == [None, 50, None, 12990, None]


def test_kopecks_on_failure(spark):
    assert apply(spark, ["47 746 ₽", "нет"], lambda c: p.parse_price_kopecks(c, 0)) == [4774600, 0]
    assert apply(spark, ["нет"], p.parse_price_kopecks) == [None]


def test_snippet_numbers(spark):
    text = "4.8(120) · 591 купили"
    assert apply(spark, [text], o.parse_rating) == [4.8]
    assert apply(spark, [text, "1 234 ОТЗЫВА"], o.parse_reviews) == [120, 1234]
    assert apply(spark, [text], o.parse_bought) == [591]


def test_titles(spark):
    assert apply(spark, ["Apple&nbsp;iPhone&amp;Чехол  X"], t.clean_title) == ["Apple iPhone& Чехол X"]
    assert apply(spark, ["Ёлка, «Люкс»!"], t.title_key) == ["елка люкс"]
    assert apply(spark, ["ab", "Распродажа", " Чай  зелёный "], o.reject_badge_title) == [
        None, None, "Чай зелёный",
    ]


def test_title_characteristics(spark):
    [chars] = apply(spark, ["Телефон X, 128 ГБ, чернильный"], o.title_characteristics)
    assert chars == {"variant": "128 ГБ, чернильный", "memory": "128 ГБ", "color": "чернильный"}


def test_query_expansion_and_correction(spark):
    df = spark.createDataFrame(
        [("  НОУТ ", None), ("ipone", "iphone"), ("x", "X "), ("  ", "y")], "v string, c string"
    )
    got = df.select(q.corrected_query(F.col("v"), F.col("c")).alias("r")).collect()
    assert [r["r"] for r in got] == ["ноутбук", "iphone", "x", ""]


def test_query_variants(spark):
    variants = apply(spark, ["iphone 10 se", "стол", "айфон 15", ""], q.query_variants)
    assert variants[0][:2] == ["iphone 10 se", "iphone se"]
    assert variants[1] == ["стол", "стол купить", "стол цена", "стол интернет-магазин"]
    assert variants[2][:3] == ["айфон 15", "iphone 15", "Apple iphone 15"]
    assert variants[3] == []


@pytest.mark.parametrize(
    "query, title, expected",
    [
        ("трусы мужские", "Боксеры хлопковые", True),
        ("iphone 15", "Смартфон Apple iPhone 15 128 ГБ", True),
        ("iphone 15", "Смартфон Apple iPhone 16", False),
        ("ноутбук", "Каталог ноутбуков", False),
        ("мышь", "Стол письменный", False),
    ],
)
def test_relevance(spark, query, title, expected):
    df = spark.createDataFrame([(query, title)], "query string, title string")
    n = q.query_needles(F.col("query"))
    [row] = df.select(q.is_relevant(F.col("title"), n["words"], n["nums"]).alias("r")).collect()
    assert row["r"] is expected


def test_tokens_and_accessories(spark):
    assert apply(spark, ["Купить новый ТЕЛЕФОН, a"], q.query_tokens) == [["телефон"]]
    df = spark.createDataFrame(
        [("телефон", "Чехол для телефона"), ("чехол телефон", "Чехол для телефона")],
        "query string, title string",
    )
    got = df.select(q.is_accessory(F.col("title"), q.query_tokens(F.col("query"))).alias("r"))
    assert [r["r"] for r in got.collect()] == [True, False]


def test_categories(spark):
    queries = ["зимняя резина", "ноутбук hp", "куртка зимняя", "хлеб", " "]
    assert apply(spark, queries, q.classify_query) == [
        "tires", "orgtech", "tires", "unknown", "unknown",
    ]
    assert apply(spark, ["Kurtka-x", "avtoshina-1", "foo"], q.classify_slug) == ["clothing", "tires", None]


def test_token_overlap(spark):
    df = spark.createDataFrame([("красные мышь а", "Мыши красных нет")], "q string, t string")
    [row] = df.select(token_overlap(F.col("q"), F.col("t")).alias("r")).collect()
    assert row["r"] == pytest.approx(0.5)


URLS = {
    "https://shop.ru/compare/": ("rejected", -1.0),
    "https://shop.de/product/1": ("rejected", -1.0),
    "https://shop.ru/news/x": ("rejected", -1.0),
    "https://www.shop.ru/product/abc": ("product", 0.95),
    "https://shop.ru/catalog/iphone-16/": ("listing", -1.0),
    "https://shop.ru/catalog/iphone-16-128gb-black/": ("product", 0.95),
    "https://shop.ru/a/b/c/123456": ("product", 0.95),
    "https://shop.com/about": (None, 0.05),
}


def test_url_kinds(spark):
    df = spark.createDataFrame([(k,) for k in URLS], "url string")
    for row in classify_urls(df).collect():
        kind, quality = URLS[row["url"]]
        flags = {k for k in ("rejected", "product", "listing") if row[k]}
        assert (kind in flags) if kind else not flags, row["url"]
        assert row["quality"] == pytest.approx(quality), row["url"]


def test_url_parts(spark):
    cases = {
        "HTTPS://WWW.Shop.RU:8080/a;p/b;q?x=1#f": ("shop.ru:8080", "/a;p/b", "x=1"),
        "https://магазин.рф/каталог/": ("магазин.рф", "/каталог/", ""),
        "not a url": ("", "not a url", ""),
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    c = F.col("v")
    got = df.select("v", u.host(c).alias("h"), u.path(c).alias("p"), u.query_string(c).alias("q"))
    for row in got.collect():
        assert (row["h"], row["p"], row["q"]) == cases[row["v"]]


def test_resolve_link(spark):
    from urllib.parse import urljoin

    base = "https://shop.ru/a/b/c.html?x=1"
    links = ["d", "/d", "//x.ru/d", "?p=2", "../d", "../../d", "./d", "https://y.ru/", "e/../f"]
    df = spark.createDataFrame([(x,) for x in links], "v string")
    got = df.select("v", u.resolve_link(F.lit(base), F.col("v")).alias("r")).collect()
    assert {r["v"]: r["r"] for r in got} == {x: urljoin(base, x) for x in links}


def test_regional_hosts_share_a_listing_key(spark):
    hosts = ["moscow.e2e4online.ru", "spb.e2e4online.ru", "www.citilink.ru", "x.ru"]
    assert apply(spark, hosts, u.listing_key) == [
        "e2e4online.ru", "e2e4online.ru", "www.citilink.ru", "x.ru",
    ]


def test_breadcrumbs_and_redirects(spark):
    assert apply(spark, ["https://shop.ru › catalog › 12", "shop.ru"], u.breadcrumb_url) == [
        "https://shop.ru/catalog/12", None,
    ]
    redirect = "//duckduckgo.com/l/?uddg=https%3A%2F%2Fshop.ru%2Fp%3Fa%3D1&rut=2"
    assert apply(spark, [redirect, "/local"], u.redirect_target) == ["https://shop.ru/p?a=1", None]


def test_images(spark):
    thumb = "https://avatars.mds.yandex.net/get-mpic/1/img_id2/50x50"
    assert apply(spark, [thumb, None], u.original_image) == [
        "https://avatars.mds.yandex.net/get-mpic/1/img_id2/orig", "",
    ]
    assert apply(spark, [14_300_000, 14_400_000, 99_999_999_999], u.cdn_host, "bigint") == [1, 2, 50]


def test_descriptions(spark):
    df = spark.createDataFrame([({"Цвет": "синий"}, 5.0, 12)], "m map<string,string>, r double, n bigint")
    [row] = df.select(
        o.payload_description(F.col("m"), F.col("r"), F.col("n")).alias("a"),
        o.card_description(
            F.col("m"), F.col("r"), F.col("n"), F.lit(7), F.lit("завтра"), F.lit(" Проза ")
        ).alias("b"),
        o.preview_description(F.lit("T"), F.lit(4.8), F.lit(1234), F.array(F.lit("Оригинал"))).alias("c"),
    ).collect()
    assert row["a"] == "Характеристики:\n• Цвет: синий\n\nРейтинг: 5 (12 отзывов)"
    assert row["b"] == (
        "Проза\n\nХарактеристики:\n• Цвет: синий\n\nРейтинг: 5 (12 отзывов)\nКупили: 7\nДоставка: завтра"
    )
    assert row["c"] == "T\n\n★ 4.8 · 1 234 отзывов\n\nОригинал"


def test_sql_functions_are_the_column_rules(spark):
    from offerloom.functions import sql

    assert sql.register_functions(spark) == list(sql.SQL_FUNCTIONS)
    values = ["1 750.00", "2\u202f499 ₽", "0", "", None, "Ёлка, «Стол»  2!", "https://WWW.Shop.RU/a//b;c?x=1#y",
              "//ozon.ru/t", "it's \\ a 'quote'", "shop.рф", "www.avito.ru", "9" * 30]
    frame = spark.createDataFrame([(v,) for v in values], "s string")
    for name, (_, _, rule) in sql.SQL_FUNCTIONS.items():
        got = frame.select(rule(F.col("s")).alias("x"), F.expr(f"{name}(s)").alias("y"))
        assert got.where("NOT x <=> y").count() == 0, name


def test_sql_jobs(spark):
    from offerloom.operators import sql_jobs

    rows = [("a", "s1", "x.ru", 300), ("a", "s2", "y.ru", 100), ("a", "s1", "x.ru", 0), ("b", "s1", "z.ru", 0),
            (None, "s1", "x.ru", 7)]
    offers = spark.createDataFrame(rows, "search_id string, source string, source_domain string, price bigint")
    offers.withColumn("search", F.lit("a")).createOrReplaceTempView("some_offers")
    assert sql_jobs.register_jobs(spark, offers="some_offers") == list(sql_jobs.OFFER_JOBS)
    every = spark.sql("SELECT * FROM price_summary()").collect()
    assert {tuple(r)[:2] for r in every} == {("a", 2), ("b", 0), (None, 1)}
    assert [tuple(r) for r in spark.sql("SELECT * FROM price_summary('a')").collect()] == [("a", 2, 100, 200, 300)]
    assert spark.sql("SELECT * FROM price_summary('none')").count() == 0
    sources = spark.sql("SELECT source FROM source_groups('a') ORDER BY source").collect()
    assert [r.source for r in sources] == ["s1", "s2"]
    # The search reaches the rows before they are grouped.
    plan = spark.sql("SELECT * FROM source_groups('a')")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Filter") > plan.rindex("Aggregate")
    offers.where("false").createOrReplaceTempView("no_offers")
    sql_jobs.register_jobs(spark, offers="no_offers")
    assert spark.sql("SELECT * FROM summary_rollup()").count() == 0
