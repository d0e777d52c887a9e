"""Language identification of mixed-language text.

Letters are grouped into words; a word's script narrows the languages it may be in to those that
the training text writes in that script. Each word gets a score per language, the sum of its
letters' log probabilities given their neighbours, and a Viterbi pass over the words with a penalty
for each change of language labels spans of one language.

Features are hashed into ``BUCKETS`` counters per language, so that the model has one size whatever
the training text. It is fitted on at most ``sample_per_lang`` texts of each language.

Nulls and texts without a letter are ``und`` with score 0 and no spans. Words in a script that no
language uses have no label and count against the score. An empty training table gives a model
without languages, which calls everything ``und``. Other columns of a table are left alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.llm.store import modest_batches

UNDETERMINED = "und"
BUCKETS = 1 << 16
#: Characters scored at once, and words per chunk of the Viterbi pass.
BLOCK_CHARS, CHUNK = 1_000_000, 64
#: Scores between two languages, over all chunks, that are computed at once.
THROUGH_CELLS = 1 << 20
#: Added to the score of a language that does not use a word's script.
FOREIGN = np.float32(-40.0)
#: Letter scores are not independent: evidence is weakened by this factor for the posterior.
TEMPER = 0.25
#: First and last code points of scripts (fixed values).
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x0370, 0x03FF),
    ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
    ("han", 0x20000, 0x323AF),
)
SCRIPT_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]
RESULT = "lang string, score double, spans array<struct<start: int, end: int, lang: string>>"


@dataclass(frozen=True)
class Model:
    langs: list[str]
    scores: np.ndarray  # log probability by bucket and language
    written_in: np.ndarray  # whether a language uses a script, by script and language
    penalty: float


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case letter, 0 for others, and the script."""
    lower = np.zeros(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if unicodedata.category(c)[0] == "L":
            small = c.lower()
            lower[point] = ord(small) if len(small) == 1 else point
    script = np.zeros(0x110000, dtype=np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    return lower, script


def _features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the letters of ``text``, their buckets and which of them begin a word."""
    lower, _ = _letters()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = np.zeros(len(points) + 2, dtype=np.uint32)
    low[1:-1] = lower[points]
    at = np.flatnonzero(low[1:-1])
    before, here, after = low[at], low[at + 1], low[at + 2]
    mixed = here * np.uint32(0x9E3779B1) + before * np.uint32(0x85EBCA6B)
    mixed += after * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    mixed ^= mixed >> np.uint32(13)
    return at, (mixed & np.uint32(BUCKETS - 1)).astype(np.int64), before == 0


def _first_scripts(text: str, at: np.ndarray) -> np.ndarray:
    _, script = _letters()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return script[points[at]]


def _blocks(text: str) -> Iterator[tuple[int, str]]:
    """Stretches of a text and where they begin; words are not cut unless longer than a block."""
    at = 0
    while len(text) - at > BLOCK_CHARS:
        cut = text.rfind(" ", at, at + BLOCK_CHARS)
        cut = at + BLOCK_CHARS if cut <= at else cut
        yield at, text[at:cut]
        at = cut
    yield at, text[at:]


# --- training ---------------------------------------------------------------------------------


def _counts(langs: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(langs), BUCKETS), dtype=np.int64)
        scripts = np.zeros((len(langs), len(SCRIPT_NAMES)), dtype=np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                k = langs.index(lang)
                for _, block in _blocks(text.as_py()):
                    at, bucket, _ = _features(block)
                    grams[k] += np.bincount(bucket, minlength=BUCKETS)
                    scripts[k] += np.bincount(
                        _first_scripts(block, at), minlength=len(SCRIPT_NAMES)
                    )
        for kind, table in (("gram", grams), ("script", scripts)):
            lang, place = np.nonzero(table)
            yield pa.RecordBatch.from_pydict(
                {
                    "kind": [kind] * len(lang),
                    "lang": lang,
                    "place": place,
                    "n": table[lang, place],
                }
            )

    return run


def fit(labelled: DataFrame, sample_per_lang: int = 5_000, penalty: float = 12.0) -> Model:
    """Fit on ``text`` and ``lang`` of at most ``sample_per_lang`` texts of each language.

    Equal texts of a language count once. The texts are those whose hash lies in the share of all
    hashes that holds a little less than ``sample_per_lang`` of them, and of these the smallest.
    ``penalty`` is what a change of language costs in units of log probability. The number of
    languages bounds what comes to the driver.
    """
    modest_batches(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64("text").alias("_h")
    )
    texts = rows.groupBy("lang", "_h").count().groupBy("lang").agg(F.count("*").alias("n"))
    sizes = {r["lang"]: r["n"] for r in texts.collect()}
    langs = sorted(sizes)
    sampled = F.lit(False)
    for lang, n in sizes.items():
        share = min(1.0, 0.95 * sample_per_lang / n) if n > sample_per_lang else 1.0
        limit = min(2**63 - 1, int(share * 2**64) - 2**63)
        sampled = sampled | ((F.col("lang") == lang) & (F.col("_h") <= limit))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("_h"))
    once = rows.where(sampled).groupBy("lang", "_h").agg(F.first("text").alias("text"))
    chosen = once.withColumn("_rank", rank).where(F.col("_rank") <= sample_per_lang)
    counted = (
        chosen.repartition("_h")
        .select("lang", "text")
        .mapInArrow(_counts(langs), "kind string, lang long, place long, n long")
        .groupBy("kind", "lang", "place")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    grams = np.zeros((BUCKETS, len(langs)))
    scripts = np.zeros((len(SCRIPT_NAMES), len(langs)))
    for kind, table in (("gram", grams), ("script", scripts)):
        part = counted[counted["kind"] == kind]
        table[part["place"].to_numpy(), part["lang"].to_numpy()] = part["n"].to_numpy()
    smooth = 0.5
    scores = np.log((grams + smooth) / (grams.sum(0) + smooth * BUCKETS)).astype(np.float32)
    used = scripts >= 0.01 * np.maximum(scripts.sum(0), 1)
    return Model(langs, scores, used & (scripts > 0), penalty)


# --- labelling --------------------------------------------------------------------------------


def _step(state: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best score before the next word for every language, whether it stays, and the best rival."""
    best = state.argmax(-1)
    switched = np.take_along_axis(state, best[..., None], -1) - penalty
    stays = state >= switched
    return np.where(stays, state, switched), stays, best


def viterbi(scores: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word. ``starts`` are the first words of documents, ascending.

    Documents are cut into chunks of equal length. What a chunk does to each language it may be
    entered in is computed for all chunks at once, then chained along each document; the same is
    done backwards for the labels. The result is that of one pass over each document.
    """
    n_langs = scores.shape[1]
    ends = np.append(starts[1:], len(scores))
    n_chunks = -(-(ends - starts) // CHUNK)
    first_chunk = np.concatenate([[0], np.cumsum(n_chunks)[:-1]])
    doc = np.repeat(np.arange(len(starts)), ends - starts)
    place = first_chunk[doc] * CHUNK + np.arange(len(scores)) - starts[doc]
    total = int(n_chunks.sum())
    # Words added to fill the last chunk score 0: nothing changes after the last real word.
    padded = np.zeros((total * CHUNK, n_langs), dtype=np.float32)
    padded[place] = scores
    padded = padded.reshape(total, CHUNK, n_langs)

    # What a chunk adds from each entry language to each exit language; so many chunks at once.
    through = np.empty((total, n_langs, n_langs))
    at_once = max(1, THROUGH_CELLS // n_langs**2)
    for first in range(0, total, at_once):
        part = np.full((min(at_once, total - first), n_langs, n_langs), -1e9)
        part[:, np.arange(n_langs), np.arange(n_langs)] = 0.0
        for t in range(CHUNK):
            part = _step(part, penalty)[0] + padded[first : first + at_once, t, None, :]
        through[first : first + at_once] = part
    entry = np.zeros((total, n_langs))
    longest = int(n_chunks.max(initial=0))
    order = np.argsort(-n_chunks, kind="stable")
    lengths = n_chunks[order]
    state = np.zeros((len(starts), n_langs))
    for c in range(longest):
        active = order[: np.searchsorted(-lengths, -c, side="left")]
        at = first_chunk[active] + c
        entry[at] = state[active]
        state[active] = (state[active][:, :, None] + through[at]).max(1)

    stays = np.empty((CHUNK, total, n_langs), dtype=bool)
    rival = np.empty((CHUNK, total), dtype=np.int32)
    now = entry
    for t in range(CHUNK):
        now, stays[t], rival[t] = _step(now, penalty)
        now = now + padded[:, t]
    # Backwards from each exit language; path[t] is the label of word t.
    path = np.empty((CHUNK, total, n_langs), dtype=np.int32)
    at = np.broadcast_to(np.arange(n_langs, dtype=np.int32), (total, n_langs))
    for t in range(CHUNK - 1, -1, -1):
        path[t] = at
        at = np.where(np.take_along_axis(stays[t], at.astype(np.int64), 1), at, rival[t][:, None])
    leaves = np.empty(total, dtype=np.int32)
    exit_now = state.argmax(1).astype(np.int32)
    for c in range(longest - 1, -1, -1):
        active = order[: np.searchsorted(-lengths, -c, side="left")]
        chunk = first_chunk[active] + c
        leaves[chunk] = exit_now[active]
        exit_now[active] = at[chunk, exit_now[active]]
    labels = path[:, np.arange(total), leaves].T.reshape(-1)
    return labels[place]


def _word_scores(text: str, model: Model) -> tuple[np.ndarray, ...]:
    """First and last letter of each word, its scores and whether any language uses its script."""
    parts = []
    for offset, block in _blocks(text):
        at, bucket, begins = _features(block)
        if not len(at):
            continue
        first = np.flatnonzero(begins)
        sums = np.add.reduceat(model.scores[bucket], first, axis=0)
        fits = model.written_in[_first_scripts(block, at[first])]
        known = fits.any(1)
        sums = np.where(known[:, None], sums + np.where(fits, 0, FOREIGN), 0)
        last = np.append(first[1:], len(at)) - 1
        parts.append((at[first] + offset, at[last] + offset + 1, sums, known))
    if not parts:
        return np.zeros(0, int), np.zeros(0, int), np.zeros((0, len(model.langs))), np.zeros(0, bool)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def label(texts: list[str | None], model: Model, spans: bool) -> list[tuple]:
    """``(lang, score, spans)`` of each text."""
    words = [_word_scores(t or "", model) if model.langs else None for t in texts]
    out: list[tuple] = [(UNDETERMINED, 0.0, [])] * len(texts)
    live = [k for k, w in enumerate(words) if w is not None and len(w[0])]
    if not live:
        return out
    scores = np.concatenate([words[k][2] for k in live])
    sizes = np.array([len(words[k][0]) for k in live])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    labels = viterbi(scores, starts, model.penalty)
    begin, end, known = (np.concatenate([words[k][i] for k in live]) for i in (0, 1, 3))
    labels = np.where(known, labels, -1)
    letters = end - begin
    n = len(model.langs)
    doc = np.repeat(np.arange(len(live)), sizes)
    of_lang = np.bincount(
        (doc * (n + 1) + labels + 1), weights=letters, minlength=len(live) * (n + 1)
    ).reshape(len(live), n + 1)
    best = of_lang[:, 1:].argmax(1)
    share = of_lang[np.arange(len(live)), best + 1] / of_lang.sum(1)
    # The posterior of the best language over the words that it labels.
    own = np.where((labels == best[doc])[:, None], scores, 0)
    sums = np.add.reduceat(own, starts, axis=0) * TEMPER
    ahead = sums - sums[np.arange(len(live)), best][:, None]
    posterior = 1 / np.exp(np.clip(ahead, -700, 700)).sum(1)
    for i, k in enumerate(live):
        found: list[dict] = []
        if spans:
            at = slice(starts[i], starts[i] + sizes[i])
            runs = np.flatnonzero(np.diff(labels[at])) + 1
            for a, b in zip([0, *runs], [*runs, sizes[i]], strict=True):
                which = labels[starts[i] + a]
                lang = model.langs[which] if which >= 0 else UNDETERMINED
                found.append(
                    {"start": begin[at][a], "end": end[at][b - 1], "lang": lang}
                )
        out[k] = (model.langs[best[i]], float(share[i] * posterior[i]), found)
    return out


def _groups(texts: list[str | None], n_langs: int) -> Iterator[list[str | None]]:
    """Texts that are labelled together: fewer where there are many languages."""
    most = BLOCK_CHARS * 16 // max(16, n_langs)
    group, chars = [], 0
    for text in texts:
        group.append(text)
        chars += len(text or "")
        if chars >= most:
            yield group
            group, chars = [], 0
    if group:
        yield group


def language(text: Column, model: Model, spans: bool = False) -> Column:
    """A struct of ``lang``, ``score`` from 0 to 1 and, if asked for, ``spans``.

    The score is the share of the letters labelled with the language, times its posterior. Spans
    are code points from ``start`` up to ``end``.
    """

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for g in _groups(batch.tolist(), len(model.langs)) for r in label(g, model, spans)]
            yield pd.DataFrame(rows, columns=["lang", "score", "spans"])

    return run(text)
