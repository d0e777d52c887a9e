"""Query normalisation, hit expansion, index and sitemap search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions import query as q
from offerloom.functions import url as u
from offerloom.functions.text import contains_any, first_match, has, strip, text_array
from offerloom.operators.planning import computed_once
from offerloom.operators.ranking import top_n
from offerloom.operators.setops import ordered_union
from offerloom.operators.settling import settle
from offerloom.sources.dims import with_region


def normalise_queries(searches: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """Original and corrected text, region and category of each search.

    ``corrections`` holds (search_id, correction): what was known at each search's time, see
    ``snapshots.fresh_corrections``. Of several for one search the first in order stands.
    """
    base = searches.withColumn("original", strip(F.col("query")))
    if corrections is None:
        base = base.withColumn("correction", F.lit(None).cast("string"))
    else:
        one = corrections.groupBy("search_id").agg(F.min("correction").alias("correction"))
        base = base.join(one, "search_id", "left")
    corrected = computed_once(
        base, {"corrected": q.corrected_query(F.col("original"), F.col("correction"))}
    ).drop("correction")
    return with_region(
        corrected.withColumn("category", q.classify_query(F.col("corrected")))
    )


def explode_variants(searches: DataFrame, text: str = "query") -> DataFrame:
    """One row per search and query variant, ``variant_ord`` from most to least specific."""
    return searches.select(
        "search_id", F.posexplode(q.query_variants(F.col(text))).alias("variant_ord", "variant")
    )


def explode_attempts(searches: DataFrame) -> DataFrame:
    """Original then corrected text of each search as numbered attempts."""
    return searches.select(
        "search_id",
        F.posexplode(q.attempts(F.col("original"), F.col("corrected"))).alias("attempt", "text"),
    )


def expanded_hits(searches: DataFrame, hits: DataFrame, text: str = "query") -> DataFrame:
    """Stored hits of all variants of each search, first occurrence per URL.

    ``hits`` has ``text, provider_ord, rank, url`` and more: answers are kept by query text,
    so equal texts of many searches share them.
    """
    variants = explode_variants(searches, text)
    joined = variants.join(
        hits.withColumnRenamed("text", "variant"), "variant"
    ).withColumn("url_key", u.url_key(F.col("url")))
    order = [F.asc("variant_ord"), F.asc("provider_ord"), F.asc("rank")]
    return top_n(joined, ["search_id", "url_key"], order, 1)


def first_working_text(hits: DataFrame) -> DataFrame:
    """Geo text first, plain text where the geo text found nothing (``tier`` 0 and 1)."""
    from offerloom.operators.ranking import best_tier

    return best_tier(hits, ["search_id"], F.col("tier"))


def _seed_urls(query: Column, region: Column) -> Column:
    """Catalogue URLs of every seed rule the query matches."""
    families = []
    regional_host = F.try_element_at(
        F.create_map(*[F.lit(x) for kv in rules.REGION_CATALOGUE_HOSTS.items() for x in kv]),
        F.lower(strip(region)),
    )
    for _, pattern, templates in rules.SEED_RULES:
        urls = []
        for template in templates:
            if template.startswith("regional:"):
                slug = template.removeprefix("regional:")
                urls.append(
                    F.concat(F.lit("https://"), regional_host, F.lit(f"/catalog/{slug}/"))
                )
                urls.append(F.lit(f"https://www.e2e4online.ru/catalog/{slug}/"))
            elif "{n}" in template:
                head, tail = template.split("{n}")
                number = first_match(query, pattern)
                urls.append(F.concat(F.lit(head), number, F.lit(tail)))
            elif "{q}" in template:
                plus = F.translate(query, " ", "+")
                urls.append(F.concat(F.lit(template.replace("{q}", "")), plus))
            else:
                urls.append(F.lit(template))
        present = F.filter(F.array(*urls), lambda x: x.isNotNull())
        families.append(F.when(has(query, pattern), present).otherwise(text_array([])))
    return F.flatten(F.array(*families))


def seed_candidates(searches: DataFrame) -> DataFrame:
    """Catalogue pages to try for queries of known kinds, by region.

    Takes ``search_id, query, region``.
    """
    exploded = searches.select(
        "search_id",
        "query",
        F.posexplode(_seed_urls(F.col("query"), F.col("region"))).alias("position", "url"),
    )
    return exploded.select(
        "search_id",
        "position",
        "url",
        u.host(F.col("url")).alias("domain"),
        F.col("query").alias("title"),
        F.lit("").alias("snippet"),
        F.lit("seed").alias("provider"),
    )


def relevant_offers(offers: DataFrame, searches: DataFrame) -> DataFrame:
    """Offers whose title answers their search's query.

    Needles are computed once per search and joined on search_id.
    """
    needles = computed_once(
        searches.select("search_id", "query"), {"_n": q.query_needles(F.col("query"))}
    ).drop("query")
    return (
        offers.join(needles, "search_id")
        .where(q.is_relevant(F.col("title"), F.col("_n.words"), F.col("_n.nums")))
        .drop("_n")
    )


def label_accessories(offers: DataFrame, searches: DataFrame) -> DataFrame:
    """Add ``matches`` (loose title match) and ``accessory``; nothing is filtered."""
    tokens = computed_once(
        searches.select("search_id", "query"), {"_t": q.query_tokens(F.col("query"))}
    ).drop("query")
    return (
        offers.join(tokens, "search_id")
        .withColumn("matches", q.title_matches(F.col("title"), F.col("_t")))
        .withColumn("accessory", q.is_accessory(F.col("title"), F.col("_t")))
        .drop("_t")
    )


def _index_words(*texts: Column) -> Column:
    joined = F.lower(F.concat_ws(" ", *texts))
    return F.array_distinct(F.filter(F.split(joined, r"(?U)\W+"), lambda t: t != ""))


def _best_sets(requests: DataFrame, sets: DataFrame, limit: int) -> DataFrame:
    """Best ``limit`` sets of each list of words: ``r, held, first_id, score``.

    ``requests``: r, words that sets hold, the rarest first. ``sets``: held, first_id. A list opens
    the sets that hold its first word and leaves sets without it to the list of its other words,
    which many lists share. Those are asked for only while a set without the first word can still
    be among the best: it scores at most their number. So a word that every set and every list
    holds is opened once for each list of words yet more common than it, not for each query.
    """
    order = [F.desc("score"), F.asc("first_id")]
    postings = sets.select("held", "first_id", F.explode("held").alias("word"))
    own = settle(requests.select("r", F.lit(0).cast("bigint").alias("floor")).distinct())
    longest = own.agg(F.max(F.size("r"))).first()[0] or 0
    score = F.size(F.array_intersect("held", "r")).cast("bigint")
    tail = F.slice("r", F.lit(2), F.size("r"))
    opened: dict[int, DataFrame] = {}
    asked = None
    for size in range(longest, 0, -1):
        now = own.where(F.size("r") == size)
        now = now if asked is None else now.unionByName(asked)
        # Some query that asks has ``limit`` sets that score ``floor`` at least.
        now = now.groupBy("r").agg(F.min("floor").alias("floor"))
        found = now.withColumn("word", F.col("r")[0]).join(postings, "word").drop("word")
        best = top_n(found.withColumn("score", score), ["r"], order, limit)
        opened[size] = settle(best.select("r", "floor", "held", "first_id", "score"))
        known = F.when(F.count("*") >= limit, F.min("score")).otherwise(F.lit(0))
        asked = (
            opened[size]
            .groupBy("r", "floor")
            .agg(known.alias("known"))
            .select(tail.alias("r"), F.greatest("floor", "known").alias("floor"))
            .where(F.col("floor") <= F.size("r"))
        )
    answers = None
    for size in range(1, longest + 1):
        mine = opened[size].drop("floor")
        if answers is not None:
            others = answers.select(F.col("r").alias("_tail"), "held", "first_id")
            passed = (
                mine.select("r").distinct().join(others, tail == F.col("_tail")).drop("_tail")
            )
            both = mine.unionByName(passed.withColumn("score", score)).dropDuplicates(["r", "held"])
            mine = top_n(both, ["r"], order, limit)
        answers = settle(mine)
        opened[size] = answers
    columns = "r array<string>, held array<string>, first_id {}, score bigint"
    kind = dict(sets.dtypes)["first_id"]
    every = requests.sparkSession.createDataFrame([], columns.format(kind))
    for level in opened.values():
        every = every.unionByName(level)
    return every


def index_search(
    searches: DataFrame, index: DataFrame, limit: int = 10, fields: tuple[str, ...] = (
        "title", "domain", "keywords", "url",
    )
) -> DataFrame:
    """Best ``limit`` index documents per search by number of query words found.

    Ties go to the smaller id; a blank query gets the first documents. Searches with the
    same words are answered once. Documents are grouped by the set of query words they hold:
    equal sets score alike, so only each set's first ``limit`` ids and, per query, its best
    ``limit`` sets can matter. Copies of one document never multiply the matching work, and
    common words are opened last, once for the queries that share them (``_best_sets``).
    """
    queries = computed_once(
        searches.select("search_id", "query"), {"words": F.array_sort(_index_words(F.col("query")))}
    ).select("search_id", "words")
    texts = [
        F.array_join(f, " ") if dict(index.dtypes)[f].startswith("array") else F.col(f)
        for f in fields
    ]
    query_words = (
        queries.select("words").distinct().select("words", F.explode("words").alias("word"))
    )
    vocabulary = query_words.select("word").distinct()
    known = (
        index.select("id", F.explode(_index_words(*texts)).alias("word"))
        .join(vocabulary, "word", "left_semi")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list("word")).alias("held"))
    )
    firsts = settle(top_n(known, ["held"], [F.asc("id")], limit))
    sets = firsts.groupBy("held").agg(F.min("id").alias("first_id"))
    rarity = (
        sets.select(F.explode("held").alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    by_rarity = F.transform(
        F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]
    )
    lists = settle(query_words.join(rarity, "word").groupBy("words").agg(by_rarity.alias("r")))
    best_sets = lists.join(_best_sets(lists, sets, limit), "r")
    answers = top_n(
        best_sets.join(firsts, "held").select("words", "id", "score"),
        ["words"],
        [F.desc("score"), F.asc("id")],
        limit,
        "rank",
    )
    worded = queries.where(F.size("words") > 0).join(answers, "words").drop("words")
    leading = index.select("id").orderBy("id").limit(limit)
    first_docs = leading.agg(F.array_sort(F.collect_list("id")).alias("ids"))  # limit ids
    blank = (
        queries.where(F.size("words") == 0)
        .select("search_id", F.lit(1).alias("_one"))
        .join(F.broadcast(first_docs.withColumn("_one", F.lit(1))), "_one")
        .select("search_id", F.posexplode("ids").alias("_i", "id"))
        .select(
            "search_id", "id", F.lit(0).cast("bigint").alias("score"),
            (F.col("_i") + 1).alias("rank"),
        )
    )
    return worded.select("search_id", "id", "score", "rank").unionByName(blank)


def servable_from_index(hits: DataFrame) -> DataFrame:
    """Index hits good enough to serve without reading the page.

    Takes index columns plus ``similarity``; relevance and listing rules are applied by
    ``relevant_offers`` and ``urls.final_offers``.
    """
    return hits.where(
        (F.col("last_price") > 0)
        & (F.coalesce("image_url", F.lit("")) != "")
        & (F.coalesce("title", F.lit("")) != "")
    ).withColumns(
        {
            "confidence": F.lit(rules.CONFIDENCE["index"]),
            "relevance_score": F.greatest(F.coalesce("similarity", F.lit(0.0)), F.lit(1.0)),
            "method": F.lit("index"),
        }
    )


def _trigrams(text: Column) -> Column:
    return F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))),
            lambda i: F.substring(text, i, F.lit(3)),
        )
    )


#: First trigrams of query words that a plan holds.
MOST_GRAMS = 5_000


def sitemap_hits(searches: DataFrame, sitemap_urls: DataFrame, limit: int = 20) -> DataFrame:
    """Sitemap product URLs that contain any token of the query.

    ``sitemap_urls``: domain, domain_ord, position, loc. Tokens have at least three
    characters, so a URL containing one holds its first three characters as a trigram: that
    is an equi join, and ``contains`` settles it. A URL yields a row for each of its trigrams that
    begins a token; up to ``MOST_GRAMS`` of them are in the plan, and with more the join sorts
    out the others. Each (token, domain) list is cut to its
    first ``limit`` URLs before it meets the queries, which loses nothing of the first
    ``limit`` of any union of such lists.
    """
    classified = computed_once(
        searches.select("search_id", "query"), {"category": q.classify_query(F.col("query"))}
    )
    tokens = computed_once(
        classified, {"tokens": q.sitemap_tokens(F.col("query"), F.col("category"))}
    ).select("search_id", "tokens")
    host = u.host(F.col("loc"))
    own = F.replace(F.lower("domain"), F.lit("www."), F.lit(""))
    urls = (
        sitemap_urls.where(
            F.col("loc").startswith("http")
            & ~u.is_blacklisted(host)
            & host.contains(own)
            & u.is_sitemap_product(F.col("loc"))
        )
        .withColumn("url_key", u.url_key(F.col("loc")))
    )
    urls = top_n(urls, ["url_key"], [F.asc("domain_ord"), F.asc("position")], 1)
    vocabulary = (
        tokens.select(F.explode("tokens").alias("token")).distinct()
        .withColumn("gram", F.substring("token", 1, 3))
    )
    lowered = F.lower("loc")
    grams = _trigrams(lowered)
    starts = [r["gram"] for r in vocabulary.select("gram").distinct().limit(MOST_GRAMS + 1).collect()]
    if len(starts) <= MOST_GRAMS:
        grams = F.filter(grams, lambda g: g.isin(starts))
    matched = (
        urls.withColumn("gram", F.explode(grams))
        .join(vocabulary, "gram")
        .where(F.contains(lowered, F.col("token")))
        .drop("gram")
    )
    order = [F.asc("domain_ord"), F.asc("position")]
    leading = top_n(matched, ["token", "domain"], order, limit)
    # Equal token lists are answered once.
    lists = tokens.select("tokens").where(F.size("tokens") > 0).distinct()
    by_token = lists.select("tokens", F.explode("tokens").alias("token")).join(leading, "token")
    distinct = top_n(by_token.drop("token"), ["tokens", "url_key"], order, 1)
    per_domain = top_n(distinct, ["tokens", "domain"], order, limit)
    answers = top_n(per_domain, ["tokens"], order, limit, "rank").select("tokens", "rank", "loc")
    # A query without tokens takes the first URLs of every domain.
    every = top_n(urls, ["domain"], order, limit).orderBy(*order).limit(limit)
    numbered = every.agg(
        F.array_sort(F.collect_list(F.struct("domain_ord", "position", "loc"))).alias("_all")
    )  # at most ``limit`` entries
    free = numbered.select(
        F.array().cast("array<string>").alias("tokens"), F.posexplode("_all").alias("_i", "_u")
    ).select("tokens", (F.col("_i") + 1).alias("rank"), F.col("_u.loc").alias("loc"))
    found = tokens.join(answers.unionByName(free), "tokens")
    return found.select(
        "search_id",
        "rank",
        F.col("loc").alias("url"),
        u.host(F.col("loc")).alias("domain"),
        u.slug_title(u.path(F.col("loc"))).alias("title"),
    )


def corrections_from_pages(pages: DataFrame) -> DataFrame:
    """(query, correction) read from stored suggestion pages.

    The stated correction wins; else the text of the first search link whose surroundings
    carry a correction marker. A correction equal to the query is dropped.
    """
    block = r"(?is)(<(?:div|p|span|li)\b[^>]*>(?:(?!</?(?:div|p|li)\b).)*?<a\b.*?</a>.*?</(?:div|p|span|li)>)"
    blocks = F.regexp_extract_all("html", F.lit(block), F.lit(1))
    marked = F.get(
        F.filter(
            blocks,
            lambda b: contains_any(F.lower(b), rules.CORRECTION_MARKERS)
            & b.rlike(r'href="[^"]*search'),
        ),
        0,
    )
    href = F.regexp_extract(marked, r'<a\b[^>]*href="([^"]*search[^"]*)"', 1)
    target = F.try_url_decode(F.regexp_extract(href, r"[?&](?:amp;)?(?:text|query)=([^&#\"]+)", 1))
    label = strip(F.regexp_extract(marked, r'(?s)<a\b[^>]*href="[^"]*search[^"]*"[^>]*>([^<]*)</a>', 1))
    from_link = F.when(
        F.length(label) >= 2, F.coalesce(F.nullif(strip(target), F.lit("")), label)
    )
    stated = q.correction_from_text(F.col("html"))
    correction = strip(F.coalesce(stated, from_link))
    return (
        pages.select(*[c for c in pages.columns if c != "html"], correction.alias("correction"))
        .where(F.col("correction").isNotNull() & (F.col("correction") != ""))
        .where(F.lower("correction") != F.lower(strip(F.col("query"))))
    )


def merge_hits(*providers: DataFrame) -> DataFrame:
    """Hits of several providers in their order, tagged with ``provider_ord``."""
    return ordered_union(*providers).withColumnRenamed("src_ord", "provider_ord")
