"""Inputs beyond former limits: depth, length, malformed pages, repeated keys."""

import random
import json
import time

import pytest
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions import dom, markup, states, text, url
from offerloom.operators import cards, circuits, offers, ranking, searching
from offerloom.sources.sitemaps import market_products


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("depth", [1, 6, 7, 30])
def test_jsonld_at_any_depth(spark, depth):
    node = {"@type": "Product", "name": "a"}
    for k in range(depth):
        node = [node] if k % 2 else {"@graph": [node]}
    html = f'<script type="application/ld+json">{json.dumps(node)}</script>'
    found = F.size(markup.product_nodes(markup.jsonld_blocks(F.col("html"))))
    assert one(spark, found, html=html) == 1


@pytest.mark.parametrize(
    ("base", "href", "want"),
    [
        ("http://a.ru/1/2/3/4/5/6/7/p", "../../../../../../x", "http://a.ru/1/x"),
        ("http://a.ru/1/2/p", "../../../../x", "http://a.ru/x"),
        ("http://a.ru/1/2/p", "./x/./y", "http://a.ru/1/2/x/y"),
        ("http://a.ru/1/2/p", "..", "http://a.ru/1/"),
        ("http://a.ru/1/p", "q?u=/../z", "http://a.ru/1/q?u=/../z"),
    ],
)
def test_dot_segments(spark, base, href, want):
    assert one(spark, url.resolve_link(F.col("b"), F.col("h")), b=base, h=href) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Caf&eacute; &#8212; &#x442;", "Café — т"),
        ("a &amp;lt; b & c &unknown; &;", "a &lt; b & c &unknown; &;"),
        ("&#0; &#1114112; &#55296;", "� � �"),
        ("plain", "plain"),
    ],
)
def test_entities(spark, raw, want):
    assert one(spark, text.unescape(F.col("t")), t=raw) == want


def test_first_of_each_in_a_long_array(spark):
    frame = spark.range(1).select(
        F.transform(F.sequence(F.lit(0), F.lit(49_999)), lambda i: i % 20_000).alias("a")
    )
    started = time.time()
    got = frame.select(text.first_of_each(F.col("a"), lambda x: x).alias("x")).first().x
    assert got == list(range(20_000)) and time.time() - started < 20


def test_last_of_each_in_a_long_array(spark):
    frame = spark.range(1).select(
        F.transform(F.sequence(F.lit(0), F.lit(49_999)), lambda i: F.struct((i % 20_000).alias("k"), i.alias("v"))).alias("a")
    )
    started = time.time()
    got = frame.select(text.last_of_each(F.col("a"), lambda x: x["k"]).alias("x")).first().x
    assert [x.k for x in got] == list(range(20_000)) and time.time() - started < 20
    assert [x.v for x in got] == [40_000 + k if k < 10_000 else 20_000 + k for k in range(20_000)]
    small = frame.select(text.last_of_each(F.array(), lambda x: x).alias("x")).first().x
    assert small == []


def test_no_page_ends_a_job(spark):
    assert dom.parse("<div><![foo bar]><p>x</p></div>").text() == "x"
    assert dom.parse("<div>" * 5_000 + "</x>" * 50_000 + "y").text() == "y"
    deep = "[" * 200_000 + "]" * 200_000
    assert states.embedded(f'<script id="__NEXT_DATA__">{deep}</script>', "page") is None
    page = f'<![x]><script id="__NEXT_DATA__">{deep}</script><div class="tile-root"></div>'
    pages = spark.createDataFrame([("s", page)], "search_id string, html string")
    assert cards.broad_offers(pages).count() == 0


def test_state_of_many_levels():
    inner = '{"description": "a text that is long enough to count"}'
    deep = '{"x": [' * 800 + inner + "]}" * 800
    state = states.shredded('{"a": ' + deep + ', "name": "Color", "value": "red"}')
    assert states.description(state).startswith("a text")
    assert states.specifications(state) == {"Color": "red"}
    assert states.shredded("[" * 200_000) is None and states.description(None) is None


def test_state_in_document_order():
    state = states.shredded(json.dumps({
        "z": [{"description": "the first text that is long enough"}, [{"name": "A", "value": 1}]],
        "b": {"description": "the second text that is long enough", "name": "A", "value": 2},
        "specs": [{"key": "B", "text": "x"}, {"key": "C", "value": ""}, "D"],
    }))
    assert states.description(state).startswith("the first")
    assert list(states.specifications(state).items()) == [("B", "x"), ("A", "2")]
    # A value that is stated again later is not there.
    again = states.shredded('{"a": {"name": "A", "value": "1"}, "a": {"name": "B", "value": "2"}}')
    assert states.specifications(again) == {"B": "2"}


def test_grid_items_of_nested_widgets():
    main, skip = rules.MAIN_GRID_WIDGETS[0], rules.SKIP_WIDGETS[0]
    name, items = rules.WIDGET_NAMES[0][0], rules.STATE_ITEM_LISTS[0]
    page = {
        "w": [{name: main, "v": {items: [{"id": 1}, {}], "u": {name: skip, items: [{"id": 2}], "t": {items: [{"id": 3}]}}}}],
        items: [{"id": 4}],
        "x": {name: skip, "y": {name: main, items: [{"id": 5}]}},
    }
    assert states.grid_items(states.shredded(json.dumps(page))) == [{"id": 1}, {}, {"id": 5}]
    stored = {"widgetStates": {rules.STATE_GRID_KEYS[0]: json.dumps(page), "other": page}}
    assert states.widget_items(states.shredded(json.dumps(stored))) == [{"id": 1}, {}, {"id": 5}]
    deep = '{"x": ' * (rules.STATE_LEVELS + 1) + json.dumps(page) + "}" * (rules.STATE_LEVELS + 1)
    assert states.grid_items(states.shredded(deep)) == []


def test_many_cards_on_one_page():
    html = "".join(
        f'<div><div><a href="/product/{i}" title="Some product {i}">p</a><b>{1000 + i} ₽</b></div></div>'
        for i in range(10_000)
    )
    root = dom.parse(f"<body><div>{html}</div></body>")
    started = time.process_time()
    found = cards._LayoutReader(rules.GENERIC_LAYOUT).read(root)
    assert len(found) == 10_000 and time.process_time() - started < 2


def test_cards_of_elements_that_are_never_closed():
    html = "".join(
        f'<div><a href="/product/{i}" title="Some product {i}">p<b>{1000 + i} ₽' for i in range(2_000)
    )
    started = time.process_time()
    root = dom.parse(f"<body><div>{html}")
    found = cards._LayoutReader(rules.GENERIC_LAYOUT).read(root)
    assert len(found) == 2_000 and time.process_time() - started < 5


def test_specifications_in_linear_time():
    line = '<li><div><span data-auto="product-spec">Label {0}</span></div><i> value {0}</i></li>'
    lines = "".join(line.format(i) for i in range(10_000))
    want = {f"Label {i}": f"value {i}" for i in range(10_000)}
    for page in (f"<body><ul>{lines}</ul></body>", "<div>" * 10_000 + lines):
        started = time.process_time()
        assert cards._specifications(dom.parse(page)) == want
        assert time.process_time() - started < 5
    open_lines = lines.replace("</li>", "").replace("</div>", "").replace("<li>", "<section>")
    started = time.process_time()
    found = cards._specifications(dom.parse(open_lines))
    assert len(found) < 20 and time.process_time() - started < 5


@pytest.mark.parametrize(
    "html, want",
    [
        ('<p><b data-auto="product-spec">Color</b><i>red</i></p>', {"Color": "red"}),
        ('<p><u>Color</u><b data-auto="product-spec">Color</b><i>red</i></p>', {"Color": "Colorred"}),
        ('<div>apiary<p><b data-auto="product-spec">Color</b></p></div>', {}),
        ('<div><p><b data-auto="product-spec">Color</b></p> widgets</div>', {}),
        ('<p>by <b data-auto="product-spec">Color</b><i>red</i></p>', {}),
        ('<p><b data-auto="product-spec">Color</b>' + "x" * 201 + "</p>", {}),
        ('<p><b data-auto="product-spec">Color</b>' + "x" * 200 + "</p>", {"Color": "x" * 200}),
        ('<body><b data-auto="product-spec">Color</b>red</body>', {}),
        ('<p><b data-auto="product-spec"></b>red</p>', {}),
        ('<p><b data-auto="product-spec">A</b></p><p><b data-auto="product-spec">A</b>1</p>', {"A": "1"}),
        ('<p><b data-auto="product-spec">A</b>1</p><p><b data-auto="product-spec">A</b>2</p>', {"A": "1"}),
    ],
)
def test_specification_beside_its_label(html, want):
    assert cards._specifications(dom.parse(html)) == want


def test_corrections_belong_to_searches(spark):
    searches = spark.createDataFrame(
        [(str(i), " ноутбук ", "spb") for i in range(20)], "search_id string, query string, region string"
    )
    corrections = spark.createDataFrame(
        [(str(i), f"ноутбук {i}") for i in range(0, 20, 2)] + [("0", "ноутбук 9")],
        "search_id string, correction string",
    )
    got = searching.normalise_queries(searches, corrections)
    assert got.count() == 20
    assert {r.search_id: r.corrected for r in got.collect()}["4"] == "ноутбук 4"


def test_two_stored_pages_of_one_card(spark):
    details = spark.createDataFrame(
        [("u", "ok", {"a": "1"}, "old", 1), ("u", "ok", {"a": "2"}, "new", 2), ("v", "ok", {}, "x", 1)],
        "url_key string, state string, specs map<string,string>, prose string, fetched_at int",
    )
    once = offers._one_stored(details, "url_key", [F.to_json("specs"), F.col("prose")])
    assert {(r.url_key, r.prose) for r in once.collect()} == {("u", "new"), ("v", "x")}


def test_ranks_of_repeated_and_wide_values(spark):
    rows = [("a", 7)] * 999 + [("b", i * 1_000_003) for i in range(4_001)] + [("c", 5)]
    rows += [("d", v) for v in (1, 1, 2, 10**12)]
    frame = spark.createDataFrame(rows, "k string, v long")
    wanted = {"low": (0.5, ranking.lower_middle), "p95": (0.95, ranking.nearest_index(95))}
    got = {r.k: (r.n, r.low, r.p95) for r in ranking.exact_ranks(frame, ["k"], "v", wanted, 500).collect()}
    for key in "abcd":
        values = sorted(v for k, v in rows if k == key)
        n = len(values)
        assert got[key] == (n, values[(n + 1) // 2 - 1], values[min(int(n * 0.95), n - 1)])


def test_circuit_opened_twice_in_neighbouring_slices(spark):
    rows = [(i, "u", at, 429) for i, at in enumerate([0, 0, 30, 59, 60, 119, 121, 400])]
    requests = spark.createDataFrame(rows, "request_id long, user_id string, at long, status int")
    timed = requests.withColumn("ts", F.timestamp_seconds("at")).drop("at")
    got = circuits.circuit_state(timed, open_s=60)
    states_ = [r.state for r in got.orderBy("request_id").collect()]
    assert states_ == ["trips", "refused", "refused", "refused", "trips", "refused", "trips", "trips"]


def test_market_products_are_not_cut(spark):
    locs = spark.range(6_000).select(
        F.col("id").alias("position"),
        F.concat(F.lit("https://www.ozon.ru/product/name-"), F.col("id") + 1000, F.lit("/")).alias("loc"),
    )
    assert market_products(locs, limit=10).count() == 10
    assert market_products(locs).count() == 6_000


def _tree(root):
    def told(node):
        return [node.tag, node.attrs, [c if isinstance(c, str) else told(c) for c in node.children]]

    places = [(n.tag, n.begin, n.end, n.place, n.past) for n in root.page.nodes]
    return told(root), root.page.pieces, places


def _by_the_parser_alone(html):
    builder = dom._Builder()
    builder.feed(html)
    builder.close()
    return builder.root


PARTS = [
    "<div>", "</div>", "<p class=\"a b\">", "</P>", "<LI>", "<br>", "<br/>", "<a href='x'>", "<a HREF=\"/y?a=1&amp;b=2\">",
    "</a>", "<b x=\"1\" y=\"\" x=\"2\">", "<b x=\"1\"y=\"2\">", "</b >", "</ b>", "</b", "text ", " a &lt; b &amp", "a < b", "&",
    "<i\n\tdata-k=\"&quot;>\" >", "<script>", "if (a<b) \"</i>\"", "</script>", "<title>", "</title>", "<!-- <p> -->",
    "<!", "<![x]>", "<?x>", "<", ">", "<1>", "<x:y>", "</x:y>", "<b =\"c\">", "<K>", "</ſ>", "<aſ>", "</aſ>",
    "<td>", "<th>", " ", "<b x=\"", "\"",
]


def test_plain_pages_are_read_as_the_parser_reads_them():
    rng = random.Random(8)
    for size in (1, 2, 3, 6, 15):
        for _ in range(1500):
            html = "".join(rng.choices(PARTS, k=size))
            assert _tree(dom.parse(html)) == _tree(_by_the_parser_alone(html)), html


def test_plain_pages_are_read_in_one_scan():
    page = "".join(
        f'<div><span data-auto="product-spec">name {i}</span><i class="v">{i}</i></div>' for i in range(300)
    )

    def seconds(read):
        times = []
        for _ in range(7):
            started = time.perf_counter()
            read(page)
            times.append(time.perf_counter() - started)
        return min(times)

    assert seconds(dom.parse) < 0.8 * seconds(_by_the_parser_alone)
