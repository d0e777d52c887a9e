"""Jobs: exactness on hot keys, order independence, upkeep, streams."""

import os
import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from offerloom.operators import (
    circuits, evaluation, harvest, metrics, neardup, offer_index, searching, selection, setops,
    snapshots, summaries, tasks,
)
from offerloom.operators.ranking import (
    best_tier, exact_ranks, first_by, lower_middle, nearest_index,
)
from offerloom.operators.urls import range_join
from offerloom.streaming import jobs, state

T0 = datetime(2024, 1, 1)


def offers(spark, rows):
    return spark.createDataFrame(
        rows, "search_id string, source string, position bigint, source_domain string, price bigint"
    )


def test_summary_cases(spark):
    rows = []
    for key, prices in {"zero": [0, 1000], "even": [100, 200, 300, 400], "odd": [100, 500, 900], "none": [0]}.items():
        rows += [(key, "other", i, "a.ru", v) for i, v in enumerate(prices)]
    got = {r["search_id"]: tuple(r)[1:] for r in summaries.price_summary(offers(spark, rows)).collect()}
    assert got == {
        "zero": (1, 1000, 1000, 1000), "even": (4, 100, 250, 400), "odd": (3, 100, 500, 900),
        "none": (0, None, None, None),
    }


def test_exact_ranks_on_a_hot_key(spark):
    rng = random.Random(7)
    rows = [("hot", int(rng.expovariate(0.001)) * 10) for _ in range(40_000)]
    rows += [(f"k{i % 50}", rng.randrange(5)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "k string, v bigint").repartition(7)
    got = exact_ranks(
        df, ["k"], "v", {"mid": (0.5, lower_middle), "p95": (0.95, nearest_index(95)), "p1": (0.01, nearest_index(1))},
        hot_rows=1_000,
    ).collect()
    values = {}
    for k, v in rows:
        values.setdefault(k, []).append(v)
    assert len(got) == len(values)
    for row in got:
        held = sorted(values[row["k"]])
        n = len(held)
        assert row["mid"] == held[(n + 1) // 2 - 1]
        assert row["p95"] == held[min(n * 95 // 100, n - 1)]
        assert row["p1"] == held[min(n // 100, n - 1)]


def test_best_tier_on_a_hot_key(spark):
    df = spark.range(5_000).selectExpr("if(id < 4000, 'hot', cast(id % 9 as string)) as k", "id % 4 + if(id < 4000, 2, 0) as t")
    cold, split = (best_tier(df, ["k"], F.col("t"), hot_rows=n) for n in (10**6, 100))
    assert split.count() == cold.count() == 1_000 + 250
    assert split.where("t > 2").count() == 0


def test_caps_are_nested_and_ignore_partitioning(spark):
    rng = random.Random(1)
    rows = [("s", i, f"d{rng.randrange(3)}", rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "search_id string, position bigint, source_domain string, relevance_score double")

    def picked(frame, k):
        return {r["position"] for r in selection.cap_per_domain(frame, k, 15).collect()}

    assert picked(df, 4) == picked(df.repartition(9, "position"), 4)
    best = sorted(rows, key=lambda r: (-r[3], r[1]))
    eight = spark.createDataFrame([("s", i, "d", float(i)) for i in range(8)], df.schema)
    assert picked(eight, 5) == {3, 4, 5, 6, 7}
    assert best[0][1] in picked(df, 1)


def test_paged_collect_stops(spark):
    def run(pages, **kw):
        rows = [("s", p, i, k) for p, keys in pages.items() for i, k in enumerate(keys)]
        df = spark.createDataFrame(rows, "search_id string, page int, position int, key string")
        return {r["key"] for r in selection.paged_collect(df, "key", **kw).collect()}

    assert run({1: "ab", 2: "ab", 3: "c"}) == {"a", "b"}
    assert run({1: "a", 2: "ab", 3: "c"}) == {"a", "b", "c"}
    assert run({1: "a", 3: "c"}) == {"a"}
    assert len(run({1: "abcdefghijkl", 2: "mnopqrst"})) == 15


def _walk(rows, limit=15):
    """The rule, offer by offer."""
    kept = []
    for position, title, url in sorted(rows):
        if not any(u == url or t == title or SequenceMatcher(None, title, t).ratio() >= 0.93 for _, t, u in kept):
            kept.append((position, title, url))
    return {p for p, _, _ in kept[:limit]}


def test_near_duplicates_match_the_rule(spark):
    rng = random.Random(3)
    words = "чайник белый черный мышь стол лампа кабель ноутбук экран плита".split()
    rows = []
    for search, size in (("hot", 400), ("b", 60), ("c", 3)):
        for i in range(size):
            title = " ".join(rng.choices(words, k=4)) + (f" {i % 10}" if rng.random() < 0.5 else "")
            rows.append((search, i, title, f"https://x.ru/{rng.randrange(size)}"))
    # a long run of copies in front
    rows += [("copies", i, f"одинаковый товар номер один {i:03d}", f"https://y.ru/{i}") for i in range(300)]
    rows += [("copies", 300 + i, w, f"https://z.ru/{i}") for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "search_id string, position bigint, title string, product_url string")
    got = {}
    for r in neardup.near_duplicate_survivors(df.repartition(5), batch=16).collect():
        got.setdefault(r["search_id"], set()).add(r["position"])
    for search in ("hot", "b", "c", "copies"):
        mine = [(p, t, u) for s, p, t, u in rows if s == search]
        assert got[search] == _walk(mine), search


def test_semantic_top_k(spark):
    rows = [("a", i, [1.0, float(i)]) for i in range(5)] + [("b", 0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "search_id string, position bigint, embedding array<float>")
    queries = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [0.0, 1.0])], "search_id string, query_embedding array<float>")
    got = {(r["search_id"], r["position"]): r["similarity"] for r in selection.semantic_top_k(df, queries, 2).collect()}
    assert got == {("a", 4): 4.0, ("a", 3): 3.0, ("b", 0): None}


def test_index_upsert_is_idempotent(spark):
    schema = "id string, title string, updated_at timestamp"
    base = spark.createDataFrame([("1", "a", T0), ("2", "b", T0)], schema)
    changes = spark.createDataFrame([("2", "B", T0 + timedelta(1)), ("3", "c", T0)], schema)
    once = offer_index.upsert(base, changes)
    twice = offer_index.upsert(once, changes)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r["id"]: r["title"] for r in once.collect()} == {"1": "a", "2": "B", "3": "c"}
    assert {r["id"] for r in offer_index.delete(once, changes).collect()} == {"1"}


def test_snapshots(spark):
    rows = [
        ("k", "hit", T0, 60, "old"), ("k", "hit", T0 + timedelta(seconds=10), 5, "short"),
        ("k", "miss", T0, 3600, None), ("z", "hit", T0 - timedelta(hours=5), 86400, "far"),
    ]
    stored = spark.createDataFrame(rows, "key string, kind string, written_at timestamp, ttl_s bigint, payload string")
    asks = spark.createDataFrame(
        [(1, "k", T0), (2, "k", T0 + timedelta(seconds=12)), (3, "k", T0 + timedelta(seconds=20)),
         (4, "z", T0), (5, "k", T0 - timedelta(seconds=1))],
        "lookup_id bigint, key string, at timestamp")
    got = {r["lookup_id"]: (r["kind"], r["payload"]) for r in snapshots.fresh(asks, stored).collect()}
    # the short-lived write replaced the older answer
    assert got == {1: ("hit", "old"), 2: ("hit", "short"), 3: ("miss", None), 4: ("hit", "far"), 5: (None, None)}


def test_index_search_matches_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choices(words, k=4))) for i in range(300)] + [(1000 + i, "w0 w1 same") for i in range(200)]
    queries = [(i, " ".join(rng.choices(words, k=3))) for i in range(40)] + [(99, "")]
    index = spark.createDataFrame(docs, "id bigint, title string")
    searches = spark.createDataFrame(queries, "search_id bigint, query string")
    got = {}
    for r in searching.index_search(searches, index, 5, ("title",)).collect():
        got.setdefault(r["search_id"], []).append((r["rank"], r["id"]))
    for key, text in queries:
        asked = set(text.split())
        scored = sorted((-len(asked & set(t.split())), i) for i, t in docs if not asked or asked & set(t.split()))
        assert [i for _, i in sorted(got[key])] == [i for _, i in scored[:5]]


def _ranked(docs, text, limit):
    asked = set(text.split())
    return [i for _, i in sorted((-len(asked & set(t.split())), i) for i, t in docs if asked & set(t.split()))][:limit]


def test_index_search_on_words_that_all_hold(spark):
    """Two words are in every document and every query; others are common, rare or in no document."""
    rng = random.Random(8)
    words = [f"w{min(i, 40)}" for i in range(60)]
    docs = [(i, " ".join(["all", "both", *rng.sample(words, rng.randint(0, 5))])) for i in range(400)]
    queries = [(i, " ".join(["both", "all", *rng.sample(words, rng.randint(0, 4)), "none"][: rng.randint(2, 7)])) for i in range(150)]
    index = spark.createDataFrame(docs, "id bigint, title string")
    got = {}
    for r in searching.index_search(
        spark.createDataFrame(queries, "search_id bigint, query string"), index, 5, ("title",)
    ).collect():
        got.setdefault(r["search_id"], []).append((r["rank"], r["id"]))
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == {k: _ranked(docs, t, 5) for k, t in queries}


def test_common_words_are_opened_once(spark, monkeypatch):
    """Lists of one own word and a word that all sets hold: the common word is asked for at most once."""
    n = 300
    sets = spark.createDataFrame([(["all", f"w{i}"], i) for i in range(n)], "held array<string>, first_id bigint")
    lists = spark.createDataFrame([([f"w{i}", "all"],) for i in range(n)], "r array<string>")
    rows = []

    def counted(df):
        kept = df.checkpoint()
        rows.append(kept.count())
        return kept

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    monkeypatch.setattr(searching, "settle", counted)
    best = searching._best_sets(lists, sets, 3)
    assert best.where("size(r) = 2").count() == 3 * n
    # lists, sets opened by own words, the common word's best, answers
    assert rows == [n, n, 3, 3, 3 * n]


def test_range_join(spark):
    ranges = spark.createDataFrame([(0, 10, "a"), (10, 500, "b")], "lo bigint, hi bigint, name string")
    points = spark.createDataFrame([(v,) for v in (0, 1, 10, 11, 500, 501)], "v bigint")
    got = {r["v"]: r["name"] for r in range_join(points, "v", ranges, 64).collect()}
    assert got == {0: None, 1: "a", 10: "a", 11: "b", 500: "b", 501: None}


def test_harvest_budgets(spark):
    links = [("p0", i, f"c{i}", "catalogue") for i in range(12)] + [("p0", 20, "item0", "product")]
    links += [(f"c{i}", j, f"item{i}-{j}", "product") for i in range(12) for j in range(3)]
    df = spark.createDataFrame(links, "page string, position bigint, link string, target string")
    seeds = spark.createDataFrame([("s", "p0#x")], "seed_id string, url string")
    rows = harvest.harvest(seeds, df, per_listing=6).orderBy("rank").collect()
    assert [r["link"] for r in rows] == ["item0", "item0-0", "item0-1", "item0-2", "item1-0", "item1-1"]


def test_merge_and_tiers(spark):
    schema = "search_id string, position bigint, url string"
    a = spark.createDataFrame([("s", 1, "https://a.ru/1#x"), ("s", 2, "https://supermarket.ru/")], schema)
    b = spark.createDataFrame([("s", 1, "https://a.ru/1"), ("s", 2, "https://b.ru/2")], schema)
    assert {r["url"] for r in setops.merge_candidates(a, b).collect()} == {"https://a.ru/1#x", "https://b.ru/2"}
    kept = setops.merge_candidates(a, b, match="suffix")
    assert "https://supermarket.ru/" in {r["url"] for r in kept.collect()}
    same = setops.merge_candidates(a, a.limit(0))
    assert same.count() == 1


def _requests(spark, rows):
    return spark.createDataFrame(
        [(i, T0 + timedelta(seconds=s), u, c) for i, (s, u, c) in enumerate(rows)],
        "request_id bigint, ts timestamp, user_id string, status int",
    )


def _fold(rows, open_s=900):
    until, out = {}, {}
    for i, (s, u, c) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[0])):
        if s < until.get(u, -1):
            out[i] = "refused"
        elif c in (429, 498):
            until[u] = s + open_s
            out[i] = "trips"
        else:
            out[i] = "passes"
    return out


def test_circuit_matches_the_fold(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(60_000), "hot", rng.choice([200, 429, 498])) for _ in range(600)]
    rows += [(rng.randrange(200_000), f"u{i % 5}", rng.choice([200, 200, 429])) for i in range(200)]
    got = circuits.circuit_state(_requests(spark, rows)).collect()
    assert {r["request_id"]: r["state"] for r in got} == _fold(rows)


def test_request_metrics(spark):
    df = spark.createDataFrame([(True, False, 12.5, 200)], "success boolean, cache_hit boolean, latency_ms double, status int")
    [row] = metrics.request_metrics(df).collect()
    assert (row["total_requests"], row["success_rate"], row["p50"], row["p95"]) == (1, 1.0, 12.5, 12.5)


def test_task_lifecycle(spark):
    rows = [
        ("a", 0, "pending", None, None), ("a", 1, "running", "шаг", None), ("a", 2, "completed", None, None),
        ("b", 0, "pending", None, None), ("b", 1, "failed", None, "сбой"),
        ("ghost", 0, "running", "x", None), ("old", 0, "pending", None, None),
    ]
    df = spark.createDataFrame(
        [(t, T0 + timedelta(seconds=n) - timedelta(hours=2 if t == "old" else 0), n, s, m, e) for t, n, s, m, e in rows],
        "task_id string, ts timestamp, seq int, status string, message string, error string")
    now = F.lit(T0 + timedelta(minutes=5))
    got = {r["task_id"]: (r["status"], r["message"], r["error"]) for r in tasks.drop_expired(tasks.task_status(df), now).collect()}
    assert got == {"a": ("completed", "Готово", None), "b": ("failed", "сбой", "сбой")}


def test_evaluation(spark):
    cases = spark.createDataFrame(
        [("ok", 10, 100, 1, 1, True, {"other": 1}), ("soft", 10, 100, 2, 1, True, {}), ("bad", 500, 100, 2, 1, False, {"ozon": 2})],
        "case_id string, took_ms int, max_took_ms int, min_sources_ok int, min_total int, allow_antibot boolean, required map<string,int>")
    groups = spark.createDataFrame(
        [("ok", "other", 3, None), ("soft", "other", 3, None), ("soft", "ozon", 0, "captcha"), ("bad", "other", 3, None), ("bad", "ozon", 0, "captcha")],
        "case_id string, source string, count bigint, error string")
    got = {r["case_id"]: r for r in evaluation.evaluate_cases(cases, groups).collect()}
    assert got["ok"]["passed"] and got["soft"]["passed"] and not got["bad"]["passed"]
    assert got["soft"]["notes"] == ["ozon: antibot (captcha)", "soft pass: 1 active sources, others antibot/unavailable"]
    assert got["bad"]["notes"][1:] == ["timeout: 500ms > 100ms", "sources ok 1 < 2", "ozon: 0 < 2"]


@pytest.fixture
def request_files(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(30_000), f"u{i % 3}", rng.choice([200, 429])) for i in range(300)]
    rows.sort()
    folder = tmp_path / "in"
    for part in range(3):
        chunk = rows[part * 100:(part + 1) * 100]
        df = spark.createDataFrame(
            [(part * 100 + i, T0 + timedelta(seconds=s), u, c) for i, (s, u, c) in enumerate(chunk)],
            "request_id bigint, ts timestamp, user_id string, status int")
        df.coalesce(1).write.parquet(str(folder / f"f{part}"))
    return folder, rows


def test_circuit_stream_equals_batch(spark, request_files, tmp_path):
    folder, rows = request_files
    whole = spark.read.parquet(*[str(folder / f"f{i}") for i in range(3)])
    stream = (
        spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(str(folder))
    )
    run = jobs.drain_to(state.circuit_state_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    jobs.run_to_idle(run)
    got = {r["request_id"]: r["state"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == _fold(rows)


def test_fast_first_publishes_once(spark, tmp_path):
    rows = [("a", i, f"o{i}", float(i), False) for i in range(7)] + [("b", 0, "x", 1.0, False), ("b", 1, None, None, True), ("c", 0, "y", 1.0, False)]
    df = spark.createDataFrame(
        [(s, T0 + timedelta(seconds=n), n, o, r, e) for s, n, o, r, e in rows],
        "search_id string, arrived_at timestamp, seq bigint, offer string, relevance_score double, ended boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    jobs.run_to_idle(jobs.drain_to(state.fast_first_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp")))
    got = {r["search_id"]: r["offers"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": ["o4", "o3", "o2", "o1", "o0"], "b": ["x"]}


def _one_file_batches(spark, folder, batches, schema):
    """A stream of one micro-batch for each list of rows."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/f{k}")
        for f in (folder / f"f{k}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + 10 * k,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return stream.option("recursiveFileLookup", "true").parquet(str(folder))


def test_keyed_streams_keep_late_rows(spark, tmp_path):
    days = [5, 400, 0, 200]  # of the micro-batches: the third and fourth are far behind the second
    stream = _one_file_batches(
        spark, tmp_path / "requests",
        [[(10 * k + i, T0 + timedelta(days=d, seconds=i), f"u{k}", 429) for i in range(2)] for k, d in enumerate(days)],
        "request_id bigint, ts timestamp, user_id string, status int")
    jobs.run_to_idle(jobs.drain_to(state.circuit_state_stream(stream), str(tmp_path / "c"), str(tmp_path / "ccp")))
    got = {r["request_id"]: r["state"] for r in spark.read.parquet(str(tmp_path / "c")).collect()}
    assert got == {10 * k + i: ("trips", "refused")[i] for k in range(4) for i in range(2)}
    # "held" has an offer in each batch and is published with the last
    arrivals = _one_file_batches(
        spark, tmp_path / "arrivals",
        [[(f"s{k}", T0 + timedelta(days=d), k, f"o{k}", 1.0, True), ("held", T0 + timedelta(days=d), k, f"h{k}", float(k), k == 3)] for k, d in enumerate(days)],
        "search_id string, arrived_at timestamp, seq bigint, offer string, relevance_score double, ended boolean")
    jobs.run_to_idle(jobs.drain_to(state.fast_first_stream(arrivals), str(tmp_path / "f"), str(tmp_path / "fcp")))
    found = {r["search_id"]: r["offers"] for r in spark.read.parquet(str(tmp_path / "f")).collect()}
    assert found == {f"s{k}": [f"o{k}"] for k in range(4)} | {"held": ["h3", "h2", "h1", "h0"]}


def _states_left(query):
    return [sum(x.numRowsTotal for x in p.stateOperators) for p in query.recentProgress]


def test_keyed_streams_forget_by_the_clock(spark, tmp_path):
    requests = _one_file_batches(
        spark, tmp_path / "requests",
        [[(10 * k + i, T0 + timedelta(days=d), f"u{i}", 429) for i in range(4)] for k, d in enumerate([0, 9, 3])],
        "request_id bigint, ts timestamp, user_id string, status int")
    arrivals = _one_file_batches(
        spark, tmp_path / "arrivals", [[(f"s{k}", T0, 0, "o", 1.0, False)] for k in range(3)],
        "search_id string, arrived_at timestamp, seq bigint, offer string, relevance_score double, ended boolean")
    events = _one_file_batches(
        spark, tmp_path / "events", [[(f"t{k}", T0, 0, "pending", None, None)] for k in range(3)],
        "task_id string, ts timestamp, seq bigint, status string, message string, error string")
    streams = {
        "c": state.circuit_state_stream(requests, idle_s=1),
        "f": state.fast_first_stream(arrivals, idle_s=1),
        "t": state.task_status_stream(events, idle_s=1),
    }
    for name, stream in streams.items():
        run = jobs.drain_to(stream, str(tmp_path / name), str(tmp_path / f"{name}cp"))
        left = _states_left(jobs.run_to_idle(run, forgotten=True, timeout_s=120))
        assert max(left) > 0 and left[-1] == 0
    assert spark.read.parquet(str(tmp_path / "c")).count() == 12


def test_silent_sources_are_reported(spark, tmp_path):
    """Answers in later batches than their requests, before them, late, twice, and none at all."""
    at = lambda s: None if s is None else T0 + timedelta(seconds=s)
    batches = [
        [("q", "silent", 0, 5, None, None), ("q", "good", 0, 5, None, None), ("r", "early", None, None, 3, 7)],
        [("q", "good", None, None, 5, 2), ("q", "good", None, None, 5, 9), ("q", "slow", 0, 5, None, None)],
        [("q", "slow", None, None, 6, 4), ("r", "early", 0, 5, None, None), ("q", "none", 0, 5, 1, 0)],
        [("q", "good", 0, 5, None, None), ("r", "stray", None, None, 1, 1)],
    ]
    log = _one_file_batches(
        spark, tmp_path / "in",
        [[(s, c, at(asked), budget, at(came), n) for s, c, asked, budget, came, n in rows] for rows in batches],
        "search_id string, source string, requested_at timestamp, budget_s int, arrived_at timestamp, count int")
    stream = state.deadline_stream(
        log.where("requested_at is not null"), log.where("arrived_at is not null"), wait_s=30, idle_s=45)
    run = jobs.drain_to(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    left = _states_left(jobs.run_to_idle(run, forgotten=True, timeout_s=240))
    assert left[-1] == 0 and len(left) > 4
    got = [tuple(r)[:5] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [
        ("q", "good", False, 2, "complete"), ("q", "none", False, 0, "empty"),
        ("q", "silent", True, 0, "error"), ("q", "slow", True, 0, "error"),
        ("r", "early", False, 7, "complete"),
    ]


def test_open_windows_are_near_and_closed_ones_exact(spark, tmp_path):
    rng = random.Random(3)
    rows = [
        (T0 + timedelta(seconds=rng.randint(0, 7200)), rng.choice([200, 200, 429, None]), float(rng.randint(1, 5000)))
        for _ in range(3000)
    ]
    rows = [(t, s, v, s == 200, False) for t, s, v in sorted(rows, key=lambda r: r[0])]
    stream = _one_file_batches(
        spark, tmp_path / "in", [rows[:1200], rows[1200:2000], rows[2000:]],
        "ts timestamp, status int, latency_ms double, success boolean, cache_hit boolean")
    out = str(tmp_path / "out")
    jobs.drain_to(jobs.metrics_stream(stream, "1 hour"), out, str(tmp_path / "cp"), "update").awaitTermination()
    newest = first_by(spark.read.parquet(out), ["window_start", "status"], [F.desc("batch")]).drop("batch")
    stored = spark.read.parquet(*[str(tmp_path / "in" / f"f{k}") for k in range(3)])
    # Merging sketches draws lots, so both sides are read from one evaluation.
    jobs.open_windows(newest).write.parquet(str(tmp_path / "windows"))
    windows = spark.read.parquet(str(tmp_path / "windows"))
    near = {r.window_start: r for r in windows.collect()}
    done = {r.window_start: r for r in jobs.closed_windows(
        windows, stored, F.lit(T0 + timedelta(hours=1)), "1 hour").collect()}
    for start, r in done.items():
        held = sorted(v for t, _, v, *_ in rows if start <= t < start + timedelta(hours=1))
        exact = [held[min(len(held) * p // 100, len(held) - 1)] for p in (50, 95)]
        if start < T0 + timedelta(hours=1):
            assert [r.p50, r.p95] == exact
        else:
            assert [r.p50, r.p95] == [near[start].p50, near[start].p95]
        for name, p in (("p50", 0.5), ("p95", 0.95)):
            rank = sum(v <= near[start][name] for v in held) / len(held)
            assert abs(rank - p) < 0.05 or len(held) < 100
        known = [s for t, s, *_ in rows if start <= t < start + timedelta(hours=1) and s]
        assert r.total_requests == len(held) and sum(r.status_counts.values()) == len(known)
    assert len(done) >= 2


def test_plan_limits_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as search_id", "id as position", "'a' as source")
    plan = selection.first_n(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")


def test_snapshot_table_round_trip(spark, tmp_path):
    results = spark.createDataFrame([("a", ["x"]), ("b", [])], "q string, products array<string>")
    rows = snapshots.result_snapshots(results, F.concat(F.lit("k:"), F.col("q")), F.lit(T0))
    path = str(tmp_path / "snapshots")
    snapshots.write_snapshots(rows, path)
    [row] = snapshots.read_snapshots(spark, path).collect()
    assert (row["key"], row["ttl_s"], row["payload"], str(row["day"])) == ("k:a", 21600, '["x"]', "2024-01-01")


def test_index_versions_on_disk(spark, tmp_path):
    schema = "id string, title string, updated_at timestamp"
    base = spark.createDataFrame([("1", "a", T0), ("2", "b", T0)], schema)
    offer_index.bucketed(base).write.partitionBy("bucket").parquet(str(tmp_path / "v1"))
    changes = spark.createDataFrame([("2", "B", T0 + timedelta(1)), ("3", "c", T0)], schema)
    offer_index.write_upsert(spark, str(tmp_path / "v1"), changes, str(tmp_path / "v2"))
    got = {r["id"]: r["title"] for r in spark.read.parquet(str(tmp_path / "v2")).collect()}
    assert got == {"1": "a", "2": "B", "3": "c"}


def test_request_log_and_report(spark, tmp_path):
    from offerloom.sources.pages import read_requests

    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text(
        '{"request_id": 1, "ts": "2024-01-01T00:00:00Z", "user_id": "u", "status": 200, "latency_ms": 5.5, "success": true, "cache_hit": false, "layer": "primary"}\n'
    )
    report = metrics.request_metrics(read_requests(spark, str(tmp_path / "log")))
    evaluation.write_report(report, str(tmp_path / "report"))
    [row] = spark.read.json(str(tmp_path / "report")).collect()
    assert row["total_requests"] == 1 and row["p95"] == 5.5


def test_search_responses(spark, tmp_path):
    from offerloom.operators.offers import to_offers
    from offerloom.plans.search import search_responses

    searches = spark.createDataFrame([("s", " Ноут ", "SPB"), ("t", "x", None)], "search_id string, query string, region string")
    rows = [("s", i, "a.ru", f"t{i}", p, f"https://a.ru/{i}") for i, p in enumerate([100, 0, 500, 900] + [7] * 20)]
    found = spark.createDataFrame(rows, "search_id string, position bigint, source_domain string, title string, price bigint, product_url string")
    outcomes = spark.createDataFrame([("s", "ozon", "captcha", None)], "search_id string, source string, error string, status string")
    docs = {r["search_id"]: r for r in search_responses(searches, [to_offers(found, "other")], outcomes=outcomes).collect()}
    s = docs["s"]
    assert (s["query"]["corrected"], s["query"]["region_name"]) == ("ноутбук", "Санкт-Петербург")
    assert [g["source"] for g in s["groups"]] == ["other", "ozon"]
    assert [g["status"] for g in s["groups"]] == ["complete", "error"]
    assert s["groups"][0]["count"] == 24 and len(s["groups"][0]["products"]) == 15
    assert s["summary"]["total_found"] == 23 and s["summary"]["median_price"] == 7
    assert docs["t"]["groups"] == [] and docs["t"]["query"]["region"] == "moscow"
    summaries.write_responses(spark.createDataFrame([("x",)], "v string"), str(tmp_path / "docs"))


def test_deadlines_and_attempts(spark):
    rows = [("a", T0, T0 + timedelta(seconds=91), 90, 3), ("b", T0, T0 + timedelta(seconds=90), 90, 3), ("c", T0, None, 90, None)]
    df = spark.createDataFrame(rows, "search_id string, requested_at timestamp, arrived_at timestamp, budget_s int, count int")
    got = {r["search_id"]: (r["timed_out"], r["count"], r["status"]) for r in metrics.deadlines(df).collect()}
    assert got == {"a": (True, 0, "error"), "b": (False, 3, "complete"), "c": (True, 0, "error")}
    tries = spark.createDataFrame(
        [("s", 1, 403, 0, "x"), ("s", 2, 429, 0, "y"), ("s", 3, 429, 0, "z"), ("w", 1, 429, 0, "x"), ("w", 2, 200, 4, None)],
        "search_id string, ord int, status int, n_products int, error string")
    best = {r["search_id"]: (r["ord"], r["outcome"]) for r in metrics.best_attempt(tries).collect()}
    assert best == {"s": (2, "failure"), "w": (2, "success")}


def test_sitemap_search(spark, monkeypatch):
    locs = [
        ("a.ru", 0, i, f"https://www.a.ru/product/{n}-{i}") for i, n in enumerate(["shina-zima", "avtoshina", "stol"])
    ] + [("b.ru", 1, 0, "https://b.ru/product/printer"), ("b.ru", 1, 1, "https://b.ru/about/printer"), ("b.ru", 1, 2, "https://a.ru/product/printer")]
    urls = spark.createDataFrame(locs, "domain string, domain_ord int, position int, loc string")
    searches = spark.createDataFrame([("t", "зимние шины"), ("p", "принтер printer"), ("e", "a"), ("n", "кккк")], "search_id string, query string")
    got = {}
    for r in searching.sitemap_hits(searches, urls, 3).orderBy("search_id", "rank").collect():
        got.setdefault(r["search_id"], []).append(r["url"])
    assert got == {
        "t": ["https://www.a.ru/product/shina-zima-0", "https://www.a.ru/product/avtoshina-1"],
        "p": ["https://b.ru/product/printer"],
        "e": [u for *_, u in locs[:3]],
    }
    monkeypatch.setattr(searching, "MOST_GRAMS", 1)
    again = searching.sitemap_hits(searches, urls, 3).collect()
    assert sorted((r["search_id"], r["rank"], r["url"]) for r in again) == sorted(
        (k, i + 1, u) for k, found in got.items() for i, u in enumerate(found)
    )


def test_streams_of_many_keys_hold_few_states(spark, tmp_path):
    """State calls and timers grow with the buckets, not with searches and sources."""
    arrivals = spark.range(20_000).select(
        F.col("id").alias("search_id"), F.lit(T0).alias("arrived_at"), F.col("id").alias("seq"),
        F.lit("o").alias("offer"), F.lit(1.0).alias("relevance_score"), (F.col("id") % 2 == 0).alias("ended"))
    arrivals.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(arrivals.schema).parquet(str(tmp_path / "in"))
    asked = stream.select("search_id", F.lit("s").alias("source"), F.col("arrived_at").alias("requested_at"), F.lit(9).alias("budget_s"))
    answers = stream.where("ended").select("search_id", F.lit("s").alias("source"), "arrived_at", F.col("seq").alias("count"))
    streams = {"f": state.fast_first_stream(stream), "d": state.deadline_stream(asked, answers, wait_s=1, idle_s=900)}
    for name, rows in streams.items():
        run = jobs.drain_to(rows, str(tmp_path / name), str(tmp_path / f"{name}cp"))
        left = _states_left(jobs.run_to_idle(run, timeout_s=240))
        assert 0 < max(left) < 20_000 // 4
    assert spark.read.parquet(str(tmp_path / "f")).count() == 10_000
    d = spark.read.parquet(str(tmp_path / "d"))
    assert d.where("not timed_out and search_id % 2 = 0 and count = search_id").count() == 10_000


def test_streams_of_many_users_and_tasks_hold_few_states(spark, tmp_path):
    """As above for circuits and tasks: one entry of state a bucket, not one a user or a task."""
    rows = spark.range(20_000).select(
        F.col("id").alias("request_id"), F.col("id").alias("user_id"), F.col("id").alias("task_id"),
        F.lit(T0).alias("ts"), F.lit(429).alias("status"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    nothing = F.lit(None).cast("string")
    events = stream.select("task_id", "ts", F.col("request_id").alias("seq"), F.lit("pending").alias("status"), nothing.alias("message"), nothing.alias("error"))
    streams = {"c": state.circuit_state_stream(stream), "t": state.task_status_stream(events)}
    for name, found in streams.items():
        run = jobs.drain_to(found, str(tmp_path / name), str(tmp_path / f"{name}cp"))
        left = _states_left(jobs.run_to_idle(run, timeout_s=240))
        assert 0 < max(left) < 20_000 // 4
    assert spark.read.parquet(str(tmp_path / "c")).where("state = 'trips'").count() == 20_000
    assert spark.read.parquet(str(tmp_path / "t")).select("task_id").distinct().count() == 20_000
