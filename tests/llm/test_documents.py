"""Operators on documents against plain versions, odd rows included."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from brute import (
    deduped_lines,
    documents,
    empty,
    frame,
    jaccard,
    likeness,
    winnowed,
)
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from offerloom.llm import langid, licenses, linededup, mixing, packing, queries, tgm, winnow
from offerloom.llm.text import WORD

ROWS = documents()
TOKENS = public_tokenizers.path("byte_bpe_50k.json")


def test_line_dedup(spark):
    want = deduped_lines(ROWS)
    for batches, fanout in ((1, 2), (4, 2), (7, 3)):
        got = linededup.drop_repeated_lines(frame(spark, ROWS), batches=batches, fanout=fanout)
        rows = got.collect()
        assert len(rows) == len(ROWS)
        assert {(r.doc_id, r.text): (r.n_lines, r.n_dropped, r.kept_text) for r in rows} == want
        assert {r._row for r in rows} == {"x"}
    assert sum(n for _, n, _ in want.values()) > 5
    assert linededup.drop_repeated_lines(empty(spark)).count() == 0


def test_line_in_a_third_of_all_documents(spark):
    hot = "a line that very many documents have in common"
    rows = [(i, f"own {i}\n{hot}" if i % 3 == 0 else f"own {i}", None, None) for i in range(4000)]
    got = linededup.drop_repeated_lines(frame(spark, rows)).where("n_dropped > 0")
    assert got.agg(F.count("*"), F.max("doc_id")).first() == (1333, 3996)


def test_jaccard_components(spark):
    for k, percent in ((3, 90), (5, 80), (2, 50)):
        want = jaccard(ROWS, k, percent)
        rows = tgm.jaccard_components(frame(spark, ROWS), k, percent).collect()
        assert len(rows) == len(ROWS)
        by_id = defaultdict(set)
        for (d, _), value in want.items():
            by_id[d].add(value)
        assert all((r.n_shingles, r.component_id) in by_id[r.doc_id] for r in rows)
        assert Counter(r.n_shingles for r in rows) == Counter(
            want[(d, t or "")][0] for d, t, *_ in ROWS
        )
    assert tgm.jaccard_components(empty(spark)).count() == 0


def test_jaccard_chain_of_near_copies(spark):
    """A family in which neighbours are linked and the ends are not, among unrelated documents."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(80):
        words = [f"x{j}" if j < i else w for j, w in enumerate(base)]
        rows.append((1000 - i, " ".join(words), None, None))
    rows += [(i, " ".join(f"u{i}v{j}" for j in range(30)), None, None) for i in range(50)]
    rows.append((500, " ".join(base), None, None))
    want = jaccard(rows, 3, 90)
    got = tgm.jaccard_components(frame(spark, rows), 3, 90).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: c for (d, _), (_, c) in want.items()}
    kept = tgm.one_per_component(frame(spark, rows), 3, 90)
    assert kept.count() == len({c for _, c in want.values()})
    assert kept.columns == frame(spark, rows).columns


def test_one_row_of_each_component(spark):
    """Repeated and null ids: each row goes with its own text's component, and one row stays."""
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"x{i}" for i in range(60))
    third = " ".join(f"y{i}" for i in range(60))
    rows = [(1, base), (2, base + " more"), (2, other), (None, third + " a"), (None, third + " b")]
    rows += [(3, other), (3, other), (None, None), (None, ""), (7, "   "), (7, " "), (8, third.upper())]
    kept = tgm.one_per_component(
        frame(spark, [(*r, None, None) for r in rows]), 5, 80
    ).select("doc_id", "text")
    got = Counter(map(tuple, kept.collect()))
    assert max(got.values()) == 1
    assert {r for r in got if r[1] and r[1].strip()} == {(1, base), (2, other), (8, third.upper())}
    assert {r for r in got if r[0] == 7} == {(7, "   "), (7, " ")}
    assert sum(r[0] is None for r in got) == 1


def test_winnowing(spark):
    for k, w in ((12, 8), (3, 4), (2, 2)):
        got = winnow.compare_with_edit(frame(spark, ROWS), k, w).collect()
        assert len(got) == len(ROWS)
        order = sorted(
            ROWS, key=lambda r: (r[0] is None, -(r[0] or 0))
        )
        by_id = {r[0]: (r[1] or "", (order[(i + 1) % len(order)][1] or "")) for i, r in enumerate(order)}
        for r in got:
            if r.doc_id in (None, 0, 2):  # next to rows that share an id: text order decides
                continue
            text, following = by_id[r.doc_id]
            cut = len(text) // 3
            edited = text[: len(text) - cut] + following[:cut]
            a, b, c = (winnowed(t, k, w) for t in (text, edited, following))
            pairs = [
                [(x >> 31, x & (2**31 - 1)) for x in numbers]
                for numbers in (r.chosen, r.edited_chosen)
            ]
            assert (r.n_chars, r.edited, pairs) == (len(text), edited, [a, b])
            assert r.near_edited == pytest.approx(likeness(a, b))
            assert r.near_next == pytest.approx(likeness(a, c))
    assert winnow.compare_with_edit(empty(spark)).count() == 0


def test_next_document_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(winnow, "SLICE_ROWS", 7)
    rows = [(i * i, f"text {i}", None, None) for i in range(100)]
    got = winnow.compare_with_edit(frame(spark, rows)).collect()
    want = {(i * i): f"text {i}"[: len(f"text {i}") - len(f"text {i}") // 3]
            + f"text {(i - 1) % 100}"[: len(f"text {i}") // 3] for i in range(100)}
    assert {r.doc_id: r.edited for r in got} == want


def test_packing_round_trip(spark):
    tokenizer = Tokenizer.from_file(TOKENS)
    rows = [*ROWS, (900, "a <|endoftext|> b", None, None), (901, "x" * 70_000, None, None)]
    rows += [(902, "long text, " * 40_000, None, None)]
    docs = frame(spark, rows).repartition(5)
    for most_open in (1, 4, 64):
        got = packing.pack(docs, TOKENS, most_open=most_open).collect()
        ids = defaultdict(list)
        for r in got:
            ids[r.doc_id].append((r.start, np.frombuffer(r.ids, dtype="<u4").tolist(), r.doc_tokens))
        want = defaultdict(list)
        for d, t, *_ in rows:
            want[d].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
        assert ids.keys() == want.keys()
        for d, texts in want.items():
            if len(texts) == 1:
                pieces = sorted(ids[d])
                assert [p[0] for p in pieces] == np.cumsum([0, *map(lambda p: len(p[1]), pieces)])[
                    :-1
                ].tolist()
                assert sum((p[1] for p in pieces), []) == texts[0]
                assert {p[2] for p in pieces} == {len(texts[0])}
            assert sum(len(p[1]) for p in ids[d]) == sum(map(len, texts))
        sequences = defaultdict(list)
        for r in got:
            sequences[r.sequence_id].append((r.offset, r.length))
        for pieces in sequences.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            assert end <= 2048 and (end & (end - 1) == 0)  # nothing to pad
    assert packing.pack(empty(spark), TOKENS).count() == 0


def test_packing_merges_many_leftovers(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGE_PARTS", 2)
    rows = [(i, f"some text {i}", None, None) for i in range(40)]
    got = packing.pack(
        frame(spark, rows).repartition(20), TOKENS, digest={"crc": F.crc32("ids")}
    ).collect()
    tokenizer = Tokenizer.from_file(TOKENS)
    for r in got:
        if r.length == r.doc_tokens:
            ids = np.array(tokenizer.encode(f"some text {r.doc_id}").ids + [1], dtype="<u4")
            assert r.crc == zlib.crc32(ids.tobytes())
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)


def sized(text):
    import re

    return len(re.findall(WORD, text or ""))


@pytest.mark.parametrize("seed", [7, 8])
def test_mixing(spark, seed):
    got = mixing.mix(frame(spark, ROWS), seed=seed).collect()
    assert len(got) == len(ROWS)
    sizes = defaultdict(int)
    for _, t, _, s in ROWS:
        sizes[s] += sized(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        unit = left / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and weight[s] * unit > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    target = {s: 3 * sizes[s] if s in capped else weight[s] * unit for s in order}
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s in order:
        largest = max(sized(t) for _, t, _, x in ROWS if x == s)
        assert abs(taken[s] - target[s]) <= largest / 2 + 1
    rows = mixing.mixed_rows(frame(spark, ROWS), seed=seed)
    assert rows.columns == frame(spark, ROWS).columns
    assert rows.count() == sum(r.copies for r in got)
    again = mixing.mix(frame(spark, ROWS).repartition(7), seed=seed).collect()
    count = lambda x: Counter((r.doc_id, r.row_key, r.copies) for r in x)
    assert count(again) == count(got)
    assert mixing.mix(empty(spark)).count() == 0


def test_inclusion_is_proportional(spark):
    """Over many seeds each document is taken about as often as its source's share says."""
    rows = [(i, "w " * 5, None, "ab"[i % 2]) for i in range(60)]
    counts = Counter()
    for seed in range(12):
        for r in mixing.mix(frame(spark, rows), seed=seed).collect():
            counts[r.doc_id % 2] += r.copies
    assert counts[0] == 12 * 20 and counts[1] == 12 * 40


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(10):
        sizes = rng.integers(1, 300, rng.integers(1, 6))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        scores = rng.normal(size=(sizes.sum(), 4)).astype(np.float32) * 3
        labels = langid.viterbi(scores, starts, 6.0)
        for a, n in zip(starts, sizes, strict=True):
            own, best = scores[a : a + n].astype(float), np.zeros(4)
            for row in own:
                best = np.maximum(best, best.max() - 6.0) + row
            chosen = labels[a : a + n]
            value = own[np.arange(n), chosen].sum() - 6.0 * (np.diff(chosen) != 0).sum()
            assert value == pytest.approx(best.max(), abs=1e-2)


TRAINING = {
    "en": "the weather of the north was with them and that is what they thought of when the ship came",
    "de": "das wetter ist nicht schön und die straße wird von den leuten über den berg gebaut worden",
    "ru": "погода была хорошая и люди шли по дороге к большому дому чтобы увидеть своих друзей",
}


def test_language(spark):
    rows = [(i, t, lang, None) for lang, t in TRAINING.items() for i in range(5)]
    rows += [(90, "no label here", None, None), (91, None, "en", None)]
    model = langid.fit(frame(spark, rows))
    assert model.langs == ["de", "en", "ru"]
    mixed = f"{TRAINING['en']}. {TRAINING['de']}! {TRAINING['ru']}"
    texts = [*TRAINING.values(), mixed, None, "", "12 !? 34", "ελληνικά μόνο", "the " * 100_000]
    docs = frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    found = docs.select("doc_id", langid.language(F.col("text"), model, spans=True).alias("f"))
    got = {r.doc_id: r.f for r in found.collect()}
    assert [got[i].lang for i in range(3)] == ["en", "de", "ru"]
    assert all(got[i].score > 0.9 and len(got[i].spans) == 1 for i in range(3))
    assert [s.lang for s in got[3].spans] == ["en", "de", "ru"]
    assert mixed[got[3].spans[1].start : got[3].spans[1].end] == TRAINING["de"]
    assert [(got[i].lang, got[i].score) for i in (4, 5, 6)] == [("und", 0.0)] * 3
    assert got[7].score < 0.3 and got[7].lang in model.langs
    assert got[8].lang == "en" and got[8].score > 0.9
    nothing = langid.fit(empty(spark))
    assert nothing.langs == []
    assert docs.select(langid.language(F.col("text"), nothing).alias("f")).first().f.lang == "und"


def test_viterbi_with_many_languages(monkeypatch):
    monkeypatch.setattr(langid, "THROUGH_CELLS", 1000)
    rng = np.random.default_rng(3)
    scores = rng.normal(size=(200, 300)).astype(np.float32)
    scores[:90, 299] += 9
    scores[90:200, 128] += 9
    labels = langid.viterbi(scores, np.array([0, 150]), 6.0)
    assert labels.tolist() == [299] * 90 + [128] * 110


def test_copies_of_a_text_count_once(spark):
    rows = [(i, "der hund und die katze", "de", None) for i in range(500)]
    rows += [(1000 + i, f"the dog and cat {i}", "en", None) for i in range(60)]
    one = langid.fit(frame(spark, rows), sample_per_lang=20)
    few = langid.fit(frame(spark, [rows[0], *rows[500:]]), sample_per_lang=20)
    assert one.langs == few.langs and np.array_equal(one.scores, few.scores)


def test_language_is_learned_from_text_alone(spark):
    got = queries.QUERIES["op1_language_id"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = got.where("held_out").join(docs, "doc_id")
    right = held.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.97 and held.count() > 20


def test_license_scan(spark):
    notice = dict(licenses.TEMPLATES)
    header = notice["mpl-2.0-header"].split(" ")
    header[10:12] = ["other", "words"]
    rows = [
        *ROWS,
        (800, "before\n" + notice["mit-notice"].upper() + "\nafter", None, None),
        (801, "x " * 997 + notice["isc-permission"] + " y" * 997, None, None),
        (802, " ".join(header), None, None),
        (803, " ".join(notice["gpl-3.0-header"].split(" ")[:20]), None, None),
    ]
    rows += [(810 + i, "q " * i + notice["apache-2.0-header"], None, None) for i in range(9)]
    got = sorted((r.doc_id, r.license) for r in licenses.scan(frame(spark, rows)).collect())
    want = [(800, "mit-notice"), (801, "isc-permission")]
    for i in range(9):
        want += [(810 + i, "apache-2.0-header"), (810 + i, "apache-2.0-notice")]
    assert [x for x in got if x[0] != 802] == sorted(want)
    assert licenses.scan(empty(spark)).count() == 0


def test_license_templates_as_a_table(spark, monkeypatch):
    texts = [("a", "one two three four five six"), ("a", "red green blue black white grey"),
             ("b", "Too short"), (None, "one two three four five six"), ("c", None)]
    table = spark.createDataFrame(texts, "license string, text string").withColumn("x", F.lit(1))
    rows = [(None, "see ONE two, three four five six", None, None),
            (None, "see ONE two, three four five six", None, None),
            (1, "red green blue black white grey", None, None), (2, "", None, None)]
    want = {(None, "a", 2, 2, 1.0), (1, "a", 2, 2, 1.0)}
    got = licenses.scan(frame(spark, rows), table).collect()
    assert set(map(tuple, got)) == want and len(got) == 2
    # Tables too large to broadcast are shuffled, with the same result.
    monkeypatch.setattr(licenses, "SMALL", 0)
    assert set(map(tuple, licenses.scan(frame(spark, rows), table).collect())) == want
    nothing = table.where("false")
    assert licenses.scan(frame(spark, rows), nothing).count() == 0


def test_license_bands_are_independent_orders(spark):
    """One shingle of a window of eight is found in some band but for the stated probability."""
    n = 20_000
    shingle = [F.xxhash64(F.col("id"), F.lit(j)) for j in range(licenses.WINDOW)]
    missed = (
        spark.range(n)
        .select(F.array(*shingle).alias("w"))
        .select(licenses.bands(F.col("w")).alias("all"),
                licenses.bands(F.slice("w", 3, 1)).alias("one"))
        .where(F.size(F.array_intersect("all", "one")) == 0)
        .count()
    )
    stated = (1 - 1 / licenses.WINDOW) ** licenses.BANDS
    assert missed <= n * stated + 4 * (n * stated) ** 0.5


@pytest.mark.parametrize(
    "name",
    ["op5_license_scan", "op6_line_dedup", "op7_mixing", "op9_chat_snapshots", "op10_warc_fixity"],
)
def test_sql_twins(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    rows = queries.QUERIES[name](spark, folder).select(*names).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(want.fetchall(), key=str)
