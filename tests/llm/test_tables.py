"""Operators on vectors, conversations and archive records."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.llm import chat, components, crosspolytope, queries, warc
from offerloom.llm.store import Workspace

VECTORS = "vec_id long, embedding array<float>, label int, rank int, `class` string, ids int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows], VECTORS)


def exact(rows, asked, k):
    out = {}
    usable = [(i, np.array(v, float)) for i, v in rows if v and np.isfinite(v).all() and any(v)]
    for i, v in usable:
        if asked(i):
            near = [
                (-float(v @ w / np.sqrt((v @ v) * (w @ w))), j)
                for j, w in usable
                if j != i and len(w) == len(v)
            ]
            out[i] = [(j, -s) for s, j in sorted((round(s, 9), j) for s, j in near)[:k]]
    return out


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(12)]
    rows += [(20 + i, rows[3][1]) for i in range(9)]  # copies
    rows += [(40, None), (41, [0.0] * 6), (42, [float("nan")] + [1.0] * 5), (43, [1.0, 2.0])]
    rows += [(44, [float("inf")] + [1.0] * 5), (45, []), rows[0]]
    got = crosspolytope.nearest(vectors(spark, rows), F.col("vec_id") % 4 == 0).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    want = exact(rows[:-1], lambda i: i % 4 == 0, 5)
    assert found == {q: [(j, round(s, 6)) for j, s in near] for q, near in want.items()}
    assert crosspolytope.nearest(vectors(spark, []), F.lit(True)).count() == 0


def test_recall_and_scores(spark):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    rows = [(r.vec_id, list(r.embedding)) for r in table]
    want = exact(rows, lambda i: i % 50 == 0, 5)
    got = queries.QUERIES["op3_cross_polytope"](spark, folder).collect()
    hits = sum(r.vec_id in {j for j, _ in want[r.query_id]} for r in got)
    assert hits >= 0.9 * len(got) and len(got) == 5 * len(want)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    for r in got:
        assert r.score == pytest.approx(unit[r.query_id] @ unit[r.vec_id], abs=1e-12)


def test_crowded_bucket_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(crosspolytope, "BLOCK_VECTORS", 16)
    monkeypatch.setattr(crosspolytope, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.05).tolist()) for i in range(300)]
    got = crosspolytope.nearest(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    want = exact([(r.vec_id, r.embedding) for r in vectors(spark, rows).collect()],
                 lambda i: i % 10 == 0, 5)
    hits = sum(r.vec_id in {j for j, _ in want[r.query_id]} for r in got.collect())
    assert hits >= 0.9 * 150 and got.count() == 150


TURNS = "conv_id long, turn long, role string, text string, place int, n_turns string"


def test_chats(spark):
    logs = {
        1: ["hi", "hello"],
        2: ["hi", "hello", "more", None],
        3: ["hi", "hello", "other"],
        4: ["hi", "hello", "other"],
        5: ["hi"],
        6: [""],
        7: ["hello", "hi"],
    }
    rows = [
        (c, i, "user" if i % 2 == 0 else None, t, 1, "x")
        for c, turns in logs.items()
        for i, t in enumerate(turns)
    ]
    rows += [rows[0], (None, 0, "user", "lost", 1, "x")]
    got = chat.format_chats(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted((r.conv_id, r.n_turns) for r in got) == [(2, 4), (3, 3), (6, 1), (7, 2)]
    text = {r.conv_id: r.chat for r in got}
    assert text[2] == (
        "<|user|>\nhi<|end|>\n<||>\nhello<|end|>\n<|user|>\nmore<|end|>\n<||>\n<|end|>\n"
    )
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_common_first_turn(spark):
    rows = [(c, 0, "user", "same", 1, "x") for c in range(3000)]
    rows += [(c, 1, "assistant", f"{c % 1500}", 1, "x") for c in range(0, 3000, 2)]
    got = chat.format_chats(spark.createDataFrame(rows, TURNS))
    assert got.agg(F.count("*"), F.min("n_turns")).first() == (750, 2)


RECORDS = "file long, key long, record string, hash int, `range` int"


def test_fixity(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAF_BYTES", 64)
    monkeypatch.setattr(warc, "FANOUT", 2)
    rows = [(f, k, f"record {f} {k} " + "x" * (k % 30), 1, 2) for f in range(4) for k in range(60)]
    rows += [(None, None, None, 1, 2), (None, 5, "", 1, 2), rows[7]]
    bad = dict(((f, k), r) for f, k, r, *_ in rows)
    del bad[(1, 7)]
    bad[(2, 9)] = bad[(2, 9)][:-1] + "!"
    bad[(3, 59)] += "longer"
    other = [(f, k, r, 1, 2) for (f, k), r in bad.items()] + [rows[7]]
    first, second = (spark.createDataFrame(r, RECORDS) for r in (rows, other))
    ours = warc.index(warc.digests(first))
    got = warc.audit(ours, warc.held(warc.digests(second), ours)).collect()
    assert sorted((r.file, r.key, r.state) for r in got) == [
        (1, 7, "missing"), (2, 9, "changed"), (3, 59, "resized"),
    ]
    ends = {f: 0 for f in range(4)}
    for f, k, r, *_ in sorted(rows[:240] + [rows[7]]):
        for x in got:
            if (x.file, x.key) == (f, k):
                assert x.offset == ends[f] and x.length == len(r)
        ends[f] += len(r)
    assert warc.audit(ours, ours).count() == 0
    none = warc.index(warc.digests(spark.createDataFrame([], RECORDS)))
    assert warc.audit(none, none).count() == 0
    assert {r.state for r in warc.audit(ours, none).collect()} == {"missing"}
    assert {r.state for r in warc.audit(none, ours).collect()} == {"extra"}


def test_fixity_of_foreign_records_and_equal_keys(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAF_BYTES", 16)
    monkeypatch.setattr(warc, "FANOUT", 2)
    rows = [(0, k, f"record {k}", 1, 2) for k in range(9)]
    rows += [(0, None, "a", 1, 2), (0, None, "b", 1, 2), (0, None, "b", 1, 2), (0, 3, "other", 1, 2)]
    rows += [(1, 1, None, 1, 2), (1, 1, "", 1, 2), (None, None, "lone", 1, 2)]
    other = [r for r in rows if r[:3] not in ((0, None, "b"), (0, 5, "record 5"), (0, 3, "other"))]
    other += [(0, None, "b", 1, 2), (0, None, "cc", 1, 2)]  # one copy has turned into cc
    other += [(0, 3, "odder", 1, 2), (0, 4, "foreign", 1, 2), (0, 4, "foreign", 1, 2)]
    other += [(0, 99, "behind", 1, 2), (7, 1, "new file", 1, 2), (1, 1, "x", 1, 2)]
    first, second = (spark.createDataFrame(r, RECORDS) for r in (rows, other))
    ours = warc.index(warc.digests(first))
    theirs = warc.held(warc.digests(second), ours)
    assert theirs.count() == len(other)
    got = warc.audit(ours, theirs).collect()
    assert sorted((r.file, r.key or -1, r.length or -1, r.found or -1, r.state) for r in got) == [
        (0, -1, 1, 2, "resized"),
        (0, 3, 5, 5, "changed"),
        (0, 4, -1, 7, "extra"),
        (0, 4, -1, 7, "extra"),
        (0, 5, 8, -1, "missing"),
        (0, 99, -1, 6, "extra"),
        (1, 1, -1, 1, "extra"),
        (7, 1, -1, 8, "extra"),
    ]
    end = sum(len(r[2]) for r in rows if r[0] == 0)
    extra = sorted(r.offset for r in got if r.state == "extra" and r.file == 0)
    assert extra == [end, end + 7, end + 14]
    assert warc.audit(ours, warc.held(warc.digests(first), ours)).count() == 0
    nothing = spark.createDataFrame([], RECORDS)
    assert warc.held(warc.digests(nothing), ours).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    links += [(205, 203), (204, 205), (203, 201)]
    space = Workspace(spark, "test")
    got = components.components(spark.createDataFrame(links, "a long, b long"), space, "c")
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
    want |= {i: 201 for i in (201, 203, 204, 205)}
    assert {r.node: r.component for r in got.collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long"), space, "d").count() == 0
