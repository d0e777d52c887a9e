"""Word lists, patterns, lookup tables and limits.

These decide the results, so they are data and stay together here. Patterns are
plain; the text helpers add Java's ``(?iU)`` (case folding and classes for every
script) where they are used.
"""

from __future__ import annotations

# --- sources and regions (fixed values) -------------------------------------------------

# (source, display name, canonical order)
SOURCES = (
    ("wildberries", "Wildberries", 0),
    ("yandex_market", "Яндекс Маркет", 1),
    ("other", "Другие источники", 2),
    ("ozon", "Ozon", 3),
)

DEFAULT_REGION = "moscow"

# (id, name, market id, delivery code, city name, search keyword)
REGIONS = (
    ("moscow", "Москва", 213, -1257786, "Москва", "Москва"),
    ("spb", "Санкт-Петербург", 2, -1198059, "Санкт-Петербург", "СПб"),
    ("kazan", "Казань", 43, -2133464, "Казань", "Казань"),
    ("ekaterinburg", "Екатеринбург", 54, -5818943, "Екатеринбург", "Екатеринбург"),
    ("novosibirsk", "Новосибирск", 65, -364763, "Новосибирск", "Новосибирск"),
)

# --- limits (fixed values) ---------------------------------------------------------------

MAX_PER_SOURCE = 15
FAST_LIMIT = 5
MAX_PER_DOMAIN = 5
MAX_RESULTS = 15
BROAD_LIMIT = 48
SEMANTIC_TOP_K = 20
RANK_POOL = 32
LISTING_ITEMS = 12
LISTING_ITEMS_LIVE = 16
LIVE_HITS = 45
MIN_NESTED_PRODUCTS = 5
PAGE_LIMIT = 3
HARVEST_DEPTH = 2
HARVEST_CATALOGUES_PER_PAGE = 8
HARVEST_PER_LISTING = 8
HARVEST_LISTINGS = 4
SNIPPET_SIMILARITY = 0.45
CATEGORY_SIMILARITY = 0.35
TITLE_RATIO = 0.93
MIN_PRICE_RUB = 50
MAX_PRICE_RUB = 5_000_000
MIN_PAGE_CHARS = 200

# seconds (fixed values)
SNAPSHOT_TTL = 21_600
SPELL_TTL = 86_400
MISS_TTL = 3_600
BLOCKED_TTL = 3_600
META_TTL = 3_600
META_INCOMPLETE_TTL = 300
TASK_TTL = 3_600
CIRCUIT_OPEN = 900
REQUEST_SPACING = 3.0
TRIP_STATUSES = (429, 498)

# confidence by extraction method (fixed values)
CONFIDENCE = {
    "payload": 1.0,
    "card": 0.9,
    "card_enriched": 0.95,
    "adapter": 1.0,
    "json_ld": 0.8,
    "json_ld_listing": 0.75,
    "dom_listing": 0.65,
    "og": 0.6,
    "regex_attr": 0.5,
    "regex_text": 0.4,
    "feed": 0.75,
    "index": 1.0,
}

# --- query normalisation (fixed values) --------------------------------------------------

QUERY_EXPANSIONS = {
    "комп": "компьютер",
    "ноут": "ноутбук",
    "тел": "телефон",
    "айф": "айфон",
    "ипхон": "айфон",
    "ипон": "айфон",
    "айфн": "айфон",
    "афон": "айфон",
}

CORRECTION_PATTERNS = (
    r"Исправлена опечатка[^«»\"']*[«\"']([^«»\"']+)[»\"']",
    r"Возможно,\s*вы\s+имели\s+в\s+виду[^«»\"']*[«\"']([^«»\"']+)[»\"']",
)
CORRECTION_MARKERS = ("исправлен", "имели в виду")

STOP_WORDS = (
    "и", "в", "на", "для", "по", "с", "из", "купить", "цена", "недорого", "новый", "новая",
    "новое", "the", "a", "an",
)

TOKEN_ALIASES = {
    "телефон": ("телефон", "смартфон", "smartphone", "phone", "iphone", "айфон", "mobile"),
    "смартфон": ("смартфон", "телефон", "smartphone", "phone", "iphone", "айфон"),
    "айфон": ("айфон", "iphone", "apple", "смартфон", "телефон", "smartphone"),
    "iphone": ("iphone", "айфон", "apple", "смартфон", "телефон", "smartphone"),
    "ноутбук": ("ноутбук", "laptop", "notebook", "macbook"),
    "шины": ("шины", "шина", "tyre", "tire", "резин"),
    "очки": ("очки", "очков", "оправ", "ray-ban", "ray ban"),
}

# (trigger stems, alias words)
NEEDLE_ALIASES = (
    (("трус",), ("трус", "боксер", "боксёр", "слип", "бриф")),
    (("очк",), ("очк", "оправ", "линз", "rayban", "ray-ban", "ray ban")),
    (("шин", "резин"), ("шин", "резин", "tyre", "tire")),
    (("мыш",), ("мыш", "mouse")),
    (("ноут",), ("ноут", "laptop", "notebook")),
    (
        ("смартфон", "телефон", "iphone", "айфон"),
        ("смартфон", "телефон", "iphone", "айфон"),
    ),
)

# (category, hint words), first match in this order
CATEGORY_HINTS = (
    ("tires", ("шин", "резин", "tyre", "tire", "колес")),
    (
        "orgtech",
        (
            "ноутбук", "принтер", "монитор", "айфон", "iphone", "компьютер", "ипхон", "ипон",
            "мыш", "клавиат", "джойстик",
        ),
    ),
)

CATEGORY_PROTOTYPES = {
    "orgtech": "ноутбук компьютер принтер монитор клавиатура мышь процессор",
    "tires": "шина резина колесо диск типоразмер летняя зимняя",
    "clothes": "одежда куртка платье ботинки пальто джинсы футболка",
}

# (category, slug keywords), first match in this order
SLUG_CATEGORIES = (
    (
        "clothing",
        (
            "odezhda", "futbolk", "krossovk", "kurtka", "platy", "rubashk", "dzhins", "sviter",
            "bryuk", "kostyum", "nosk", "shapka", "perchatk",
        ),
    ),
    ("tires", ("shina", "shiny", "shin-", "avtoshin", "pokryshk", "disk-", "koleso")),
    (
        "office",
        (
            "printer", "mfu", "skaner", "skanner", "orgteh", "laserjet", "kartrid",
            "bumaga-ofis", "proektor",
        ),
    ),
)

# sitemap search: (category, query keywords, url hints), first match in this order
SITEMAP_HINTS = (
    (
        "tires",
        ("шин", "резин", "колес", "диск", "tyre", "tire"),
        ("shina", "shiny", "tyre", "tires", "wheel", "disk", "шин", "резин", "колес"),
    ),
    (
        "orgtech",
        ("ноут", "принтер", "монитор", "комп", "phone", "смартф"),
        ("noutbuk", "notebook", "printer", "monitor", "phone", "smartfon", "ноут", "принтер"),
    ),
    (
        "clothes",
        ("одеж", "курт", "плать", "ботин", "джинс"),
        ("odezhd", "kurtka", "dress", "boot", "jeans", "одеж", "куртк", "плать"),
    ),
)

# catalogue seeds: (family, query pattern, region -> url prefix or None, url template);
# {n} is the first capture group, {q} the query with spaces as plus signs
REGION_CATALOGUE_HOSTS = {
    "moscow": "moscow.e2e4online.ru",
    "spb": "spb.e2e4online.ru",
    "novosibirsk": "novosibirsk.e2e4online.ru",
}
SEED_RULES = (
    ("mouse", r"\b(?:мыш|mouse|мышк)", (
        "regional:myshi-18",
        "https://www.technocity.ru/catalog/13/",
        "https://www.dns-shop.ru/catalog/17a8a69116404e77/mysi/",
        "https://www.citilink.ru/catalog/myshi/",
        "https://www.mvideo.ru/komputernye-aksessuary-24/myshi-183",
    )),
    ("keyboard", r"\b(?:клавиат|keyboard)", (
        "regional:klaviatury-19",
        "https://www.dns-shop.ru/catalog/17a89aab16404e77/klaviatury/",
        "https://www.citilink.ru/search/?text=%D0%BA%D0%BB%D0%B0%D0%B2%D0%B8%D0%B0%D1%82%D1%83%D1%80%D0%B0",
    )),
    ("printer", r"\b(?:принтер|printer|мфу)\b", (
        "regional:printery-86",
        "https://www.dns-shop.ru/catalog/17a8d26216404e77/printery/",
        "https://www.citilink.ru/search/?text=%D0%BF%D1%80%D0%B8%D0%BD%D1%82%D0%B5%D1%80",
    )),
    ("iphone", r"(?:айфон|iphone)\s*(\d{1,2})", (
        "https://cmstore.ru/catalog/smartfony/apple_iphone/iphone_{n}/",
        "https://re-store.ru/smartfony/apple/iphone-{n}/",
        "https://shop.mts.ru/catalog/smartfony/apple/iphone-{n}/",
        "https://biggeek.ru/catalog/apple-iphone-{n}",
    )),
    ("optics", r"очк", (
        "https://www.letu.ru/browse/optika/ochki",
        "https://www.optic-city.ru/ochki_s_dioptrijami/",
        "https://ochkarik.ru/catalog/ochki/",
        "https://ochkarik.ru/catalog/solntsezashchitnye_ochki/",
    )),
    ("grocery", r"морожен|молок|хлеб|сыр|колбас|продукт|еда|напит", (
        "https://online.metro-cc.ru/search?q={q}",
        "https://www.vkusvill.ru/search/?q={q}",
    )),
)

# --- url rules (fixed values) -------------------------------------------------------------

BLACKLIST = (
    "wildberries.ru", "wb.ru", "ozon.ru", "market.yandex.ru", "avito.ru", "youla.ru",
    "kazanexpress.ru", "aliexpress.ru", "aliexpress.com", "price.ru", "e-katalog.ru",
    "market.ru", "vc.ru", "habr.com", "dtf.ru", "pikabu.ru", "duckduckgo.com", "kp.ru",
    "mail.ru", "hi-tech.mail.ru", "expertcen.ru", "ratingpc.ru", "ixbt.com", "3dnews.ru",
    "wikipedia.org", "youtube.com", "farpost.ru", "drom.ru", "baza.drom.ru", "pepper.ru",
    "2gis.ru", "zoon.ru", "be-in.ru",
)
FETCH_BLOCKED_HOSTS = ("dns-shop.ru", "citilink.ru", "cifrus.ru")
REJECT_HOSTS = (
    "gsmarena.com", "nanoreview.net", "phonemore.com", "lenta.ru", "chip.de", "idealo.de",
    "mediamarkt.de", "bild.de", "apple.com",
)
REJECT_PATH = (
    r"/compare(?:/|\?|$)|compare\.php|/filter/|/f/|/news/|/artikel/|/brand/|/articles?/"
    r"|/blog/|/responses/|/customers/products/"
)
FOREIGN_LOCALE = r"\.de(?:/|$)|\.com/(?:de|sg|uk|us|au|fr|it|es)(?:/|$)|/de/|/sg/"
PRODUCT_PATH = (
    r"/products?/|/p/\d|/item/|/goods/|/tovar/|/card/|/(?:shop/)?details/"
    r"|/catalog/(?:item|detail)/|/catalog_shin/|/razmer/|/\d{6,}|/\d{3}-\d{2}-\d{2}/?"
    r"|[_-]shina[_-]"
)
CATALOG_PATH = r"/catalog/|/category/|/categories/|/smartfony/|/collection/"
TIRE_SIZE = r"\d{3}[-/]\d{2}[-/]R?\d{2}"
LISTING_SLUGS = (
    "apple-iphone", "apple_iphone", "catalog.html", "iphone", "iphone-15", "iphone-16",
    "iphone-se", "klaviatury", "monitory", "naushniki", "noutbuki", "planshety", "printery",
    "shiny", "smartfony", "tyre", "tyres",
)
LISTING_PREFIXES = ("brand_", "category_", "klaviatury", "myshi", "mysi", "printery")
MODEL_FAMILY = r"^(?:apple[-_])?iphone(?:[-_]\d{1,2})?(?:[-_](?:se|pro|max|plus|mini))*$"
PRODUCT_SLUG = (
    r"\d{5,}|\d{2,4}(?:gb|tb)|(?:gb|tb)[-_]?\d{2,4}"
    r"|black|white|blue|green|red|pink|gray|grey|silver|gold|purple"
    r"|titan|natural|midnight|starlight"
)
GRID_SLUGS = (
    "naushniki", "smartfony", "noutbuki", "planshety", "monitory", "shiny", "tyres", "tyre",
    "catalog.html", "iphone-15", "iphone-16",
)
GRID_PATH_TOKENS = ("/smartfony/", "/iphone-", "/apple_iphone/", "/naushniki/")
GRID_PRIORITY_HINTS = ("/tyres", "/tyre", "/shiny", "season_", "/smartfony/", "/iphone-")
GRID_MOUSE_TOKENS = ("/myshi", "/mysi", "/mouse", "mysh")
CATEGORY_TITLE = r"купить\s+от|интернет[-\s]магазин|каталог\s+\w+\s+купить"
CATEGORY_PHRASE = (
    r"\bмагазины?\b|страница\s+каталог|каталог\s+товаров|подборк[аи]\s+товаров"
)
CATEGORY_LAST_SEGMENTS = ("iphone-15", "iphone-16", "smartfony")
HARVEST_CATALOG_PATH = r"/catalog/|/category/|/categories/|/search|/shiny|/auto/"
HARVEST_SKIP_PATH = (
    r"/actions/|/articles/|/news/|/blog/|/about/|/contacts/|/bookmark/|/petition|/ajax_|/note\?"
)
HARVEST_SKU = r"/catalog/([A-Za-z0-9_-]+)/?"
HARVEST_CATEGORY_SLUGS = (
    "naushniki", "smartfony", "noutbuki", "planshety", "monitory", "shiny", "tyres",
)
SITEMAP_PRODUCT = (
    r"/product[s]?/|/goods/|/item/|/tovar/|/shina/|/tyre[s]?/|/catalog/\d+|/catalog_shin/"
    r"|/razmer/|/\d{5,}|[_-]shina[_-]"
)
SITEMAP_CHILD = r"product|catalog|tyre|shina|goods|item"
MARKET_PRODUCT_PATH = r"/product/(.+)-(\d+)/?$"
MARKET_PRODUCT_HOSTS = ("www.ozon.ru", "ozon.ru")
PRECRAWL_DOMAINS = (
    "dns-shop.ru", "citilink.ru", "mvideo.ru", "4tochki.ru", "koleso.ru", "lamoda.ru",
)
PRECRAWL_PER_DOMAIN = 250

# (rule, domain suffixes, categories, shared listing key, listing layout, challenge page)
DOMAIN_RULES = (
    ("e2e4", ("e2e4online.ru",), ("orgtech",), "e2e4online.ru", True, False),
    ("citilink", ("citilink.ru",), ("orgtech",), None, True, True),
    ("mvideo", ("mvideo.ru",), ("orgtech",), None, True, False),
    ("dns-shop", ("dns-shop.ru",), ("orgtech",), None, True, True),
    ("technocity", ("technocity.ru",), ("orgtech",), None, True, False),
    ("4tochki", ("4tochki.ru",), ("tires",), None, True, False),
    ("koleso", ("koleso.ru",), ("tires",), None, True, False),
    ("lamoda", ("lamoda.ru",), ("clothes",), None, True, False),
)
# shops whose product pages are trusted as they are (confidence 1.0)
ADAPTER_DOMAINS = (
    "dns-shop.ru", "citilink.ru", "mvideo.ru", "notik.ru", "4tochki.ru", "koleso.ru",
    "lamoda.ru",
)
ADAPTER_ITEMPROP_DOMAINS = ("notik.ru",)

THUMBNAIL = r"^(https://avatars\.mds\.yandex\.net/get-mpic/\d+/[^/]+)/[^/]+$"
IMAGE_HOSTS = (
    "avatars.mds.yandex.net", "ir.ozone.ru", "ozone.ru", "wbbasket.ru", "wb.ru", "cmstore.ru",
    "re-store.ru", "mikrovuho.ru", "domicro.ru", "microgadgets.ru", "mikron45.ru",
)
PLACEHOLDER_IMAGES = ("data:image", "placeholder", "/wc50/", "multimedia-x/", "no-image")

# image hosts by article number div 100 000: (highest value, host number)
CDN_RANGES = (
    (143, 1), (287, 2), (431, 3), (719, 4), (1007, 5), (1061, 6), (1115, 7), (1169, 8),
    (1313, 9), (1601, 10), (1655, 11), (1919, 12), (2045, 13), (2189, 14), (2405, 15),
    (2621, 16), (2837, 17), (3053, 18), (3269, 19), (3485, 20), (3701, 21), (3917, 22),
    (4193, 23), (4469, 24), (4877, 25), (5285, 26), (5693, 27), (6101, 28), (6509, 29),
    (6917, 30), (7325, 31), (7733, 32), (8141, 33), (8549, 34), (8957, 35), (9365, 36),
    (9773, 37), (10181, 38), (10589, 39), (10997, 40), (11405, 41), (11813, 42), (12221, 43),
    (12629, 44), (13037, 45), (13445, 46), (13853, 47), (14261, 48), (14669, 49), (15077, 50),
)
CDN_MIN, CDN_MAX = 1, 50
CDN_PROBE_DEPTH = 8

# --- titles, prices, text (fixed values) --------------------------------------------------

BAD_TITLE = r"добавить\s+товар|нет\s+в\s+наличии|распродажа|каталог"
BADGE_TITLES = (
    "баллов за отзыв", "вау-цен", "распродажа", "цена что надо", "осталось", "шт",
)
ACCESSORY_WORDS = (
    "чехол", "стекло", "плёнка", "пленка", "наклейк", "кабель", "зарядное", "зарядка",
    "адаптер", "бампер", "подставк", "ремешок", "гарнитур", "наушник",
)
ACCESSORY_QUERY_WORDS = ("чехол", "стекло", "кабель", "заряд", "наушник")
ADVERT_TITLES = ("реклама", "спонсор")
SKIP_WIDGETS = (
    "recommendation", "sponsored", "skushelf", "analog", "advert", "marketing", "sellerother",
    "history",
)
MAIN_GRID_WIDGETS = ("searchresultsv2", "tilegrid", "skugrid", "catalog.search")
STATE_GRID_KEYS = ("searchresultsv2", "tilegrid", "skugrid")
STATE_ITEM_LISTS = ("items", "products", "tiles", "skuList", "searchResults")
CARD_BADGES = ("Оригинал", "Распродажа")
TEXT_PRICE = r"(\d[\d\s]*)\s*(?:₽|руб\.?)"
CARD_PRICE = r"(\d[\d\s]*)\s*(?:₽|&#8381;|руб\.?)"
SIGN_PRICE = r"(\d[\d\s]*)\s*₽"
GROUPED_NUMBER = r"\d{1,3}(?:\s\d{3})+"
ATTR_PRICE = r"(?:data-price|data-product-price|priceValue)\s*=\s*[\"']?(\d[\d\s]*)[\"']?"
ITEMPROP_PRICE = r"itemprop=[\"']price[\"'][^>]*content=[\"'](\d+)[\"']"
PRODUCT_LINK = r"/product/|/goods/|/item/|/catalog/detail/|/catalog/item/"
COLOUR = (
    r"(?:,\s*)((?:черн|бел|син|красн|зел|фиолет|розов|золот|сереб|тёмн|темн)[^\,]*)"
)
MEMORY = r"(\d+\s*(?:ГБ|GB|ТБ|TB))"

# --- page states, diagnostics, evaluation (fixed values) ----------------------------------

CHALLENGE_TITLES = ("Antibot Captcha", "Antibot Challenge Page", "Доступ ограничен")
ANTIBOT_MARKERS = ("429", "403", "капч", "captcha", "антибот", "smartcaptcha", "rate-limit")
TRANSPORT_MARKERS = ("bad_decrypt", "ssl_", "ssl ", "tls", "connection", "timeout")
SEARCH_BLOCK_MARKERS = ("captcha", "too many requests")
GATE_WITH, GATE_WITHOUT = 0.95, 0.70

DIAGNOSIS = {
    "head": "Другие источники: 0 товаров.",
    "timeout": "Внешний поиск отвечает слишком долго.",
    "blocked": "Внешние поисковики временно ограничили автоматические запросы.",
    "no_hits": "Не удалось получить результаты из внешнего веб-поиска.",
    "no_cards": "Ссылки нашлись, но магазины не отдали подходящие карточки товаров.",
    "exception": "Во время поиска произошла внешняя ошибка.",
    "other": "Не удалось получить данные из внешних источников.",
    "detail_blocked": "поисковики запросили CAPTCHA или включили ограничение по частоте",
    "detail_transport": "часть источников ответила сетевой ошибкой",
    "detail_cards": "магазины не отдали карточки товаров в удобном для парсинга виде",
    "retry": "Попробуйте повторить запрос чуть позже.",
}

# --- card layouts (fixed values) ----------------------------------------------------------
# One row per shop layout; a new shop is a new row. ``host`` is matched as a domain, or as a
# part of the host when it starts with "*". ``card`` lists card selectors, the first with any
# hit counts. An empty ``card`` climbs from each link towards its price instead.

CARD_LAYOUTS = (
    {
        "host": "dns-shop.ru",
        "card": (".catalog-product",),
        "link": ("a.catalog-product__name", "a.catalog-product__image-link"),
        "title": (".catalog-product__name",),
        "min_title": 3,
        "price": (".catalog-product__price", "[data-product-price]", ".product-buy__price"),
        "price_fallback": "card",
    },
    {
        "host": "technocity.ru",
        "card": ("article.catalog-item, .catalog-item.item",),
        "link": ("a[href*='/catalog/detail/']",),
        "title": (".name",),
        "min_title": 5,
        "title_fallback": "card",
        "price": (".price-above-button", "[class*='price']"),
        "price_fallback": "digits",
    },
    {
        "host": "citilink.ru",
        "card": ('[data-meta-name="SnippetProductVerticalLayout"]',),
        "link": ('a[href^="/product/"][title]',),
        "href_reject": "/otzyvy/",
        "title_attr": True,
        "min_title": 5,
        "price": ("[data-meta-price]", '[data-meta-name="Snippet__price"]'),
    },
    {
        "host": "*e2e4online.ru",
        "link": ("a[href*='/catalog/item/']",),
        "min_title": 5,
        "climb": 10,
        "price": (
            ".price-block__price", ".price-block", ".product-price", ".price-current",
        ),
        "price_fallback": "digits",
        "price_after_code": r"Код:\s*\d+\s+(\d[\d\s]*)\s*₽",
    },
    {
        "host": "*technopark.ru",
        "card": (".product-card", "[data-entity='item']", ".catalog-item", ".product-tile"),
        "link": ("a[href*='/product/']", "a[href*='/catalog/']"),
        "href_match": PRODUCT_LINK,
        "title_attr": True,
        "title": ("[class*='title']", "h3"),
        "title_late": True,
        "min_title": 3,
        "price": ("[class*='price']", "[data-price]"),
        "price_fallback": "card",
    },
)
GENERIC_LAYOUT = {
    "host": "*",
    "link": ("a[href]",),
    "href_match": PRODUCT_LINK,
    "title_attr": True,
    "min_title": 5,
    "climb": 8,
}
PRICE_ATTRIBUTES = ("data-product-price", "data-price", "content")

# search front ends: result block, title link, cite line, snippet, breadcrumb reading
SERP_LAYOUTS = {
    "bing": ("li.b_algo", ("h2 a",), ("cite",), (".b_caption p",)),
    "yahoo": (
        "div.algo", ("h3.title a", "a"), ("span.fc-falcon", "cite"), (".compText p", ".fc-falcon"),
    ),
    "ddg": ("a.result-link", (), (), ()),
}

# tile search pages of the broad source
TILE_CARDS = (
    "div.tile-root",
    "div.widget-search-result-container > div",
    '[data-widget="tileGridDesktop"] div.tile-root',
)
TILE_ROOTS = ('[data-widget="tileGridDesktop"]', "div.widget-search-result-container")
# where tiles are looked for, in order: enclosing elements ("" is the page), tile selectors
TILE_PLACES = ((TILE_ROOTS, TILE_CARDS), *((("",), (selector,)) for selector in TILE_CARDS))
TILE_TITLES = (
    "a.tile-hover-target span.tsBody500Medium",
    'a[href*="/product/"] span.tsBody500Medium',
    "span.tsBody500Medium",
)
TILE_PRICES = ("span.tsHead500Medium", "span.tsBody500Medium", "span.tsCompact500Medium")
TILE_DESCRIPTIONS = (
    '[data-widget="webDescription"]',
    '[data-widget="webDetailDescription"]',
    "#section-description",
    'div[itemprop="description"]',
)
TILE_SPEC_ROWS = '[data-widget="webCharacteristics"] tr, .characteristics tr'
SPEC_LISTS = ("characteristics", "attributes", "specs", "properties", "shortCharacteristics")
DESCRIPTION_KEYS = ("description", "fullDescription", "text", "content")
# forms of a specification: keys of the label, keys of the value
SPEC_OBJECT = (("name", "key", "title"), ("value", "text"))
SPEC_LINE = (("name", "key"), ("value", "text"))
NOT_SPECS = ("description", "title")

# seconds without news after which a stream forgets a key
STATE_IDLE = 86_400
#: Buckets that streams of many short-lived keys hold their state in.
STATE_BUCKETS = 512

# embedded states: pattern, whether backslashes are doubled in the page
STATE_SOURCES = {
    "state": (
        (r"window\.__NUXT__\.state\s*=\s*'(.+)'\s*;\s*window\.__NUXT__", True),
        (r'window\.__NUXT__\.state\s*=\s*"(.+)"\s*;\s*window\.__NUXT__', True),
    ),
    "page": ((r'<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', False),),
}
WIDGET_NAMES = (("component", "widgetName"), ("originName", "originComponent"))

# limits on single fields: values that enclose a grid item, lengths in characters, price digits
STATE_LEVELS = 16
LONGEST_TEXT = 5000
LEAST_DESCRIPTION = 21
LONGEST_SPEC = 200
LONGEST_CARD_TITLE = 160
MOST_PRICE_DIGITS = 8
# marks of page furniture that encloses a specification
NOT_SPEC_TEXT = ("apiary", "widgets")
SPEC_LABEL = '[data-auto="product-spec"]'
CARD_PROSE = '[data-auto="product-description"]'

# article cards of the card source
ARTICLE_FIELDS = {
    "title": '[data-auto="snippet-title"], h3',
    "price": '[data-auto="snippet-price-current"], [data-auto="price-value"]',
    "link": 'a[href*="/product/"], a[href*="/card/"]',
    "reviews": '[data-auto="reviews"]',
    "delivery": '[data-auto="delivery-wrapper"]',
}
CARD_SITE = "https://market.yandex.ru"
TILE_SITE = "https://www.ozon.ru"
