"""Phrase collocations against a count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from brute import documents, empty, frame

from offerloom.llm import collocations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases(rows, least, max_words, top, percent):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for m in range(1, max_words + 1):
                f.update((lang, *ws[i : i + m]) for i in range(len(ws) - m + 1))
    found = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    out = {}
    for (lang, *ws), a in found.items():
        longer = [
            b
            for (other, *vs), b in found.items()
            if other == lang
            and len(vs) > len(ws)
            and any(vs[i : i + len(ws)] == ws for i in range(len(vs)))
        ]
        if any(100 * b >= percent * a for b in longer):
            continue
        cuts = [(f[(lang, *ws[:k])], f[(lang, *ws[k:])], k) for k in range(1, len(ws))]
        score, _, l, r = min((1000 * a * n[lang] // (l * r), k, l, r) for l, r, k in cuts)
        out.setdefault(lang, []).append((score, a, " ".join(ws), l, r, n[lang]))
    rows = set()
    for lang, held in out.items():
        held.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        rows |= {
            (lang, i + 1, p, a, l, r, n, score)
            for i, (score, a, p, l, r, n) in enumerate(held[:top])
        }
    return rows


def spoken(n=150, seed=5):
    """Sentences of few words, so that phrases of all lengths are frequent, in several languages."""
    rng = random.Random(seed)
    words = ["the", "of", "Of", "a", "ü", "x-y", " z", "9", "\x00", "é́"]
    rows = []
    for i in range(n):
        text = "".join(
            rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b"])
            for _ in range(rng.randint(0, 60))
        )
        rows.append((i, text, rng.choice(["en", "de", None, "und", ""]), None))
    return rows + [(None, "the of the of the of the", "en", None)] * 40


@pytest.mark.parametrize(("least", "max_words", "percent"), [(5, 5, 100), (3, 3, 60), (2, 2, 100)])
def test_phrases(spark, least, max_words, percent):
    rows = [*spoken(), *documents()]
    got = collocations.collocations(
        frame(spark, rows).repartition(5), least, max_words, 50, percent
    ).collect()
    assert {tuple(r) for r in got} == phrases(rows, least, max_words, 50, percent)
    assert len(got) == len(set(got)) > 30


@pytest.mark.parametrize("most_listed", [10**6, 3])
def test_wide_routes_are_dealt_again(spark, monkeypatch, most_listed):
    """Every route is too wide: beginnings of two, three and four words are counted apart."""
    monkeypatch.setattr(collocations, "MOST_LISTED", most_listed)
    monkeypatch.setattr(collocations, "LEAST_UNEVEN", 0)
    monkeypatch.setattr(collocations, "UNEVEN", 0)
    monkeypatch.setattr(collocations, "ROUTE_BYTES", 500)
    monkeypatch.setattr(collocations, "TASK_TOKENS", 500)
    rows = spoken()
    got = collocations.collocations(frame(spark, rows), least=4, top=10**6).collect()
    assert {tuple(r) for r in got} == phrases(rows, 4, 5, 10**6, 100)


def test_empty(spark):
    assert collocations.collocations(empty(spark)).count() == 0
    assert collocations.collocations(frame(spark, documents(n=3))).count() == 0


def test_sort_abandons_only_rare_beginnings():
    rng = np.random.default_rng(2)
    columns = rng.integers(1, 6, (4, 3000))
    columns[3, columns[2] == 2] = 0
    weights = rng.integers(1, 9, 3000)
    want = Counter()
    for row, w in zip(columns.T.tolist(), weights.tolist(), strict=True):
        for m in range(1, 5):
            if row[m - 1]:
                want[tuple(row[:m])] += w
    got = collocations.frequent_prefixes(columns, weights, 120, 1)
    assert {tuple(columns[:m, p].tolist()): n for p, m, n in got} == {
        k: n for k, n in want.items() if n >= 120
    }


def test_scores_are_exact(spark):
    from pyspark.sql import functions as F

    rows = [(7 * 10**11 + 3, 10**14 + 9, 10**12 + 7, 10**12 - 1), (10**12, 10**15, 10**13, 10**12), (3, 7, 5, 9)]
    got = (
        spark.createDataFrame(rows, "a long, n long, l long, r long")
        .select(collocations.exact_score(*map(F.col, "anlr")))
        .collect()
    )
    assert [r[0] for r in got] == [1000 * a * n // (l * r) for a, n, l, r in rows]
