"""Products over sources and time, against plain loops."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from offerloom.operators import enrichment, matching, offer_index, price_history, ranking

T0 = datetime(2024, 1, 1)


def _observed(n=600, seed=4):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        product = rng.choice(["hot", "hot", "hot", "a", "b", None])
        at = T0 + timedelta(hours=rng.randint(0, 900) * 3)
        rows.append((product, at, seq, rng.choice([100, 100, 120, 90, None])))
    return rows


def _changes(rows):
    by_product = defaultdict(list)
    for product, at, seq, price in rows:
        if product is not None and price is not None:
            by_product[product].append((at, seq, price))
    out = set()
    for product, seen in by_product.items():
        before = None
        for at, seq, price in sorted(seen):
            if price != before:
                out.add((product, at, seq, price, before))
            before = price
    return out


SCHEMA = "product string, observed_at timestamp, seq bigint, price bigint"


def test_price_changes_in_slices_and_in_parts(spark):
    rows = _observed()
    want = _changes(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    whole = price_history.price_changes(df, slice_seconds=86_400)
    assert {tuple(r) for r in whole.collect()} == want
    cut = T0 + timedelta(days=40)
    first = price_history.price_changes(df.where(F.col("observed_at") < F.lit(cut)))
    second = price_history.price_changes(
        df.where(F.col("observed_at") >= F.lit(cut)), price_history.last_prices(first)
    )
    assert {tuple(r) for r in first.unionByName(second).collect()} == want
    assert price_history.price_changes(df.limit(0)).count() == 0


def test_prices_at(spark):
    rows = _observed()
    log = sorted(_changes(rows), key=lambda r: (r[1], r[2]))
    asks = [(i, p, T0 + timedelta(hours=7 * i)) for i in range(400) for p in ("hot", "b", "none")]
    changes = price_history.price_changes(spark.createDataFrame(rows, SCHEMA))
    got = price_history.prices_at(
        changes, spark.createDataFrame(asks, "ask int, product string, at timestamp")
    ).collect()
    assert len(got) == len(asks)
    for r in got:
        past = [c[3] for c in log if c[0] == r["product"] and c[1] <= r["at"]]
        assert r["price"] == (past[-1] if past else None)


def test_alerts_with_a_hot_product(spark, monkeypatch):
    rows = _observed()
    watches = [(i, p, t, d) for i, (p, t, d) in enumerate(
        [("hot", 95, None), ("hot", None, 20), ("hot", 100, 5), ("a", 120, None), ("none", 1, 1), (None, 1, 1)]
    )]
    want = set()
    for product, at, seq, price, before in _changes(rows):
        for watch, p, target, drop in watches:
            if p != product:
                continue
            if target is not None and price <= target and (before is None or before > target):
                want.add((watch, product, at, seq, price, before, "target"))
            elif drop is not None and before is not None and (before - price) * 100 >= before * drop:
                want.add((watch, product, at, seq, price, before, "drop"))
    changes = price_history.price_changes(spark.createDataFrame(rows, SCHEMA))
    df = spark.createDataFrame(watches, "watch_id int, product string, target bigint, drop_percent int")
    got = price_history.price_alerts(changes, df).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_product_matches(spark, monkeypatch):
    rng = random.Random(6)
    words = ["red", "blue", "phone", "case", "pro", "max", "mini", "new", "used", "black"]
    rows = []
    for i in range(220):
        title = " ".join(rng.sample(words, rng.randint(3, 6)))
        rows.append((i, rng.choice(["s1", "s2", "s3"]), title + rng.choice(["", "", " 64GB", " 128gb"])))
    rows += [(300 + i, f"s{i % 2}", "The same, Title") for i in range(120)]
    rows += [(500, "s1", None), (501, "s2", ""), (502, "s1", "12 34"), (503, "s2", "12 34"), (None, "s1", rows[0][2])]

    def parts(title):
        ws = set((title or "").lower().replace(",", " ").split())
        numbers = frozenset(w for w in ws if any(c.isdigit() for c in w))
        return numbers, frozenset(ws - numbers)

    sound = {i: (s, *parts(t)) for i, s, t in rows if i is not None and parts(t)[1]}
    component = {i: i for i in sound}

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    for i, (_, numbers, own) in sound.items():
        for j, (_, other_numbers, other) in sound.items():
            if i < j and numbers == other_numbers and len(own & other) * 100 >= len(own | other) * 80:
                a, b = sorted((root(i), root(j)))
                component[b] = a
    sources = defaultdict(set)
    for i, (s, *_) in sound.items():
        sources[root(i)].add(s)
    want = {
        (i, s, root(i), len(sources[root(i)])) for i, (s, *_) in sound.items() if len(sources[root(i)]) > 1
    }
    df = spark.createDataFrame(rows, "offer_id bigint, source string, title string")
    assert {tuple(r) for r in matching.product_matches(df).collect()} == want
    assert len(want) > 150
    monkeypatch.setattr(ranking, "HOT_ROWS", 10)
    assert {tuple(r) for r in matching.product_matches(df).collect()} == want
    assert matching.product_matches(df.limit(0)).count() == 0


def _due(offers, log, now, max_tries=3, backoff=3600, lease=900, threshold=0.7):
    newest = {}
    for i, confidence, at in offers:
        if i is not None and at is not None:
            key = (at, -(confidence or 0.0))
            newest[i] = max(newest.get(i, key), key)
    out = set()
    for i, (version, lack) in newest.items():
        mine = [(at, state) for j, at, state in log if j == i and at is not None and version <= at <= now]
        tries = [at for at, state in mine if state == "taken"]
        if -lack >= threshold or any(s == "done" for _, s in mine) or len(tries) >= max_tries:
            continue
        at = version
        if tries:
            last = max(at for at, _ in mine)
            at = max(last + timedelta(seconds=backoff * 2 ** (len(tries) - 1)), max(tries) + timedelta(seconds=lease))
        if at <= now:
            out.add((i, -lack, len(tries), at))
    return out


def test_due_offers(spark):
    rng = random.Random(9)
    hours = lambda n: T0 + timedelta(hours=rng.randint(0, n))
    offers = [(f"o{rng.randint(0, 40)}", rng.choice([None, 0.2, 0.5, 0.7, 0.9]), hours(5)) for _ in range(70)]
    offers += [(None, 0.1, T0), ("t", 0.1, None), ("new", 0.3, T0)]
    log = [(f"o{rng.randint(0, 40)}", hours(30), rng.choice(["taken", "taken", "failed", "failed", "done"])) for _ in range(90)]
    log += [("o1", None, "done"), (None, T0, "done")] + [("hot", T0, "failed")] * 300
    now = T0 + timedelta(hours=26)
    df = spark.createDataFrame(offers, "id string, confidence double, updated_at timestamp")
    logged = spark.createDataFrame(log, "id string, at timestamp, state string")
    got = enrichment.due(df, logged, F.lit(now), max_tries=3).collect()
    want = _due(offers, log, now)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 5
    assert {r.tries for r in got} >= {0, 1}
    assert enrichment.due(df.limit(0), logged, F.lit(now)).count() == 0


def test_queue_takes_nothing_twice(spark, tmp_path):
    offers = spark.createDataFrame(
        [(f"o{i}", i / 10, T0) for i in range(10)], "id string, confidence double, updated_at timestamp"
    )
    queue = enrichment.EnrichmentQueue(spark, str(tmp_path / "queue"), max_tries=2)
    at = lambda h: F.lit(T0 + timedelta(hours=h))
    take = lambda h, batch, **k: {r.id for r in queue.take(offers, at(h), batch, **k).collect()}
    assert queue.log().count() == 0
    assert take(0, "a", limit=3) == {"o0", "o1", "o2"}
    assert take(5, "a") == {"o0", "o1", "o2"}  # the batch again
    assert take(0, "b") == {"o3", "o4", "o5", "o6"}
    assert take(0, "c") == set()
    queue.report(spark.createDataFrame([("o0", True), ("o1", False), ("o3", None)], "id string, ok boolean"), at(1), "a")
    queue.report(spark.createDataFrame([("o0", False)], "id string, ok boolean"), at(1), "a")  # again: as it was
    assert take(1.5, "d") == {"o2", "o4", "o5", "o6"}  # their lease and first wait are over
    assert take(2, "e") == {"o1", "o3"}
    queue.spark.createDataFrame([], enrichment.LOG_SCHEMA).write.parquet(str(tmp_path / "queue" / "result-empty"))
    (tmp_path / "queue" / "taken-half").mkdir()  # a batch that never ended
    assert take(99, "f") == set()  # all done or taken twice
    assert queue.log().count() == 3 + 4 + 3 + 4 + 2


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    def files():
        return {str(p) for p in (tmp_path / "ix" / "data").rglob("*.parquet")}

    schema = "id string, title string, updated_at timestamp"
    base = [(f"d{i}", f"t{i}", T0) for i in range(200)]
    index = offer_index.VersionedIndex(spark, str(tmp_path / "ix"), buckets=16)
    assert index.documents() is None
    assert index.apply(spark.createDataFrame(base + [(None, "x", T0)], schema)) == list(range(16))
    first, before = files(), {f for f in index.documents().inputFiles()}
    change = spark.createDataFrame(
        [("d3", "new", T0 + timedelta(1)), ("d4", "old", T0 - timedelta(1))], schema
    )
    gone = spark.createDataFrame([("d5",), ("none",), (None,)], "id string")
    touched = index.apply(change, gone)
    assert 0 < len(touched) <= 4 and first <= files()
    kept = before & set(index.documents().inputFiles())
    assert kept and all(f"bucket={b}/" not in f for f in kept for b in touched)
    assert len({f.split("bucket=")[1].split("/")[0] for f in kept}) == 16 - len(touched)
    want = {i: t for i, t, _ in base} | {"d3": "new"}
    del want["d5"]
    assert {r.id: r.title for r in index.documents().collect()} == want
    index.apply(change)
    assert {r.id: r.title for r in index.documents().collect()} == want
    # A version whose list is not complete is not seen.
    (tmp_path / "ix" / "versions" / "000000000009").mkdir()
    assert index.documents().count() == len(want)
    assert index.apply(change.limit(0)) == [] and index.documents().count() == len(want)
    index.apply(change.limit(0), index.documents().select("id"))
    assert index.documents().count() == 0
    wider = change.withColumn("rating", F.lit(5))
    index.apply(wider)
    assert {r.rating for r in index.documents().collect()} == {5}
