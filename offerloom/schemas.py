"""Explicit schemas of the input and output tables. Prices are integer kopecks."""

from __future__ import annotations

SEARCHES = "search_id string, query string, region string, requested_at timestamp"
PAYLOADS = (
    "search_id string, source string, seq int, fetched_at timestamp, status int, "
    "latency_ms double, body string"
)
PAGES = "url string, fetched_at timestamp, status int, html string"
SERP_HITS = (
    "search_id string, provider string, rank int, url string, title string, snippet string"
)
SITEMAP_LOCS = "domain string, parent_sitemap string, loc string"
OFFERS = (
    "search_id string, source string, position bigint, source_domain string, title string, "
    "description string, price bigint, currency string, image_url string, product_url string, "
    "characteristics map<string,string>, rating double, reviews_count bigint, "
    "relevance_score double, confidence double"
)
OFFER_INDEX = (
    "id string, url string, domain string, title string, category string, image_url string, "
    "last_price bigint, keywords array<string>, confidence double, updated_at timestamp"
)
REQUESTS = (
    "request_id bigint, ts timestamp, phase string, user_id string, endpoint string, status int, "
    "latency_ms double, retry_count int, cache_hit boolean, success boolean, layer string"
)
TASK_EVENTS = (
    "task_id string, ts timestamp, status string, message string, error string, source string"
)
SNAPSHOTS = (
    "key string, kind string, written_at timestamp, ttl_s bigint, payload string, day date"
)

PAYLOAD_PRODUCT = (
    "struct<id:bigint,name:string,brand:string,supplier:string,entity:string,"
    "colors:array<string>,supplierRating:double,totalQuantity:bigint,"
    "reviewRating:double,nmReviewRating:double,rating:double,"
    "nmFeedbacks:bigint,feedbacks:bigint,salePriceU:bigint,priceU:bigint,"
    "sizes:array<struct<price:struct<product:bigint,total:bigint,basic:bigint>>>>"
)
PAYLOAD = (
    f"struct<products:array<{PAYLOAD_PRODUCT}>,data:struct<products:array<{PAYLOAD_PRODUCT}>>>"
)

# One offer inside the nested response document.
PRODUCT_FIELDS = (
    "source",
    "source_domain",
    "title",
    "description",
    "price",
    "currency",
    "image_url",
    "product_url",
    "characteristics",
    "rating",
    "reviews_count",
    "relevance_score",
    "confidence",
)

OFFER_COLUMNS = (
    "search_id",
    "source",
    "position",
    *PRODUCT_FIELDS[1:],
)
