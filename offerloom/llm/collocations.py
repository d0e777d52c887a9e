"""Phrase collocations by multikey quicksort of suffix pointers.

Texts are cut into pieces at punctuation and line ends, pieces into words. Every word position is a
suffix: the words from there to the end of its piece, ``max_words`` at most. Words that occur fewer
than ``least`` times in their language end a suffix as the end of a piece does, since no phrase
that holds one can be frequent.

Suffixes are routed by their first two words. A route's suffixes are sorted by a three-way quicksort
of pointers that looks at one word at a time: the pointers equal to the pivot go on to the next
word, and their number is the count of the phrase read so far. Partitions with fewer than ``least``
occurrences are abandoned. The routes' sizes are counted together with the words. Where a route
would get more than ``UNEVEN`` times the mean, only the beginnings of its suffixes, which are few,
are counted there, and the suffixes are routed by one more word, up to ``max_words`` of them, so
that no phrase, however common its beginning, is one task's work. Equal suffixes of a task are
combined before they are routed.

Words are known by 64-bit hashes seeded by their language. Up to ``MOST_LISTED`` frequent words are
sent to the tasks as a list, which numbers them the same everywhere, and suffixes travel as sorted
and compressed blocks of these numbers. More words than that are sent as a bitmap of at most
``MOST_BITS`` bits, and each block brings the hashes of its words along. Where the bitmap takes a
rare word for a frequent one, a suffix is longer than need be and the sort abandons it.

Nulls: a null text is empty and a null language ``und``. Rows with equal ids are rows of their own.
An empty table, or one without frequent phrases, gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.llm.store import Workspace, modest_batches

UNDETERMINED = "und"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Ends of pieces, as bytes.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_UPPER + BREAKS, _UPPER.lower() + b"\n" * len(BREAKS))
#: Stands for the end of a piece among words; no byte of UTF-8.
_BREAK = b"\xff"
#: Word positions held by a task before it hands on what it has, and words it numbers at most.
TASK_TOKENS, TASK_WORDS = 1_200_000, 400_000
#: Bytes of text behind a route on average, and the multiple of the mean that a route may get.
ROUTE_BYTES, UNEVEN, LEAST_UNEVEN = 6_000_000, 4, 20_000
#: Frequent words that are sent to tasks as a list of 12 bytes each.
MOST_LISTED = 2_000_000
#: Size of the bitmap of frequent words: so many bits a word, within these limits.
BITS_A_WORD, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26
_NONE = 0

_DEALT = "route long, n long, words binary, suffixes binary, weights binary"
_DEALT_ARROW = pa.schema(
    [("route", pa.int64()), ("n", pa.int64())]
    + [(c, pa.binary()) for c in ("words", "suffixes", "weights")]
)
#: A route's name is the number of words it is known by and its place among those.
_DEPTH = 1 << 32
_SORTED = "phrase array<long>, a long"
_SORTED_ARROW = pa.schema([("phrase", pa.list_(pa.int64())), ("a", pa.int64())])


# --- words ------------------------------------------------------------------------------------


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def word_hash(word: bytes, seed: int) -> int:
    """Hash of a word; 0 is kept for no word."""
    return xxhash.xxh3_64_intdigest(word, seed=seed) or 1


class _Numbers(dict):
    """Numbers of the words of one language; the number of a break is 0."""

    def __init__(self, lang: str, langs: list[str], words: list[bytes], hashes: list[int]) -> None:
        super().__init__({_BREAK: _NONE})
        self.lang, self.langs, self.words, self.hashes = lang, langs, words, hashes
        self.seed = _seed(lang)

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self.words)
        self.langs.append(self.lang)
        self.words.append(word)
        self.hashes.append(word_hash(word, self.seed))
        return value


class Reader:
    """Numbers the words of a task's texts and hands on a stretch of them when it is long enough."""

    def __init__(self) -> None:
        self._begin()

    def _begin(self) -> None:
        self.langs: list[str] = [""]
        self.words: list[bytes] = [b""]
        self.hashes: list[int] = [0]
        self.numbers: dict[str, _Numbers] = {}
        self.stretches: list[np.ndarray] = []
        self.held = 0

    def add(self, lang: str, texts: list[bytes]) -> None:
        numbers = self.numbers.get(lang)
        if numbers is None:
            numbers = _Numbers(lang, self.langs, self.words, self.hashes)
            self.numbers[lang] = numbers
        plain = b"\n".join([*texts, b""]).translate(_PLAIN)
        tokens = plain.replace(b"\n", b" " + _BREAK + b" ").split()
        self.stretches.append(
            np.fromiter(map(numbers.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        )
        self.held += len(tokens)

    def stretch(self, last: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, list, list]]:
        """``(numbers, hashes, langs, words)`` when enough is held; number 0 is a break."""
        if self.held and (last or self.held >= TASK_TOKENS or len(self.words) >= TASK_WORDS):
            numbers = np.concatenate([*self.stretches, np.zeros(1, dtype=np.int32)])
            held = numbers, np.array(self.hashes, dtype=np.uint64), self.langs, self.words
            self._begin()
            yield held

    def read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """All stretches of the batches' texts (``lang``, ``text``)."""
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                if text:
                    by_lang.setdefault(lang, []).append(text)
            for lang, group in by_lang.items():
                self.add(lang, group)
                yield from self.stretch()
        yield from self.stretch(last=True)


_COUNTED = "lang string, word binary, n long"
_COUNTED_ARROW = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])


def _counted(
    lang: pa.Array | None, word: list[bytes] | None, n: np.ndarray | pa.Array
) -> pa.RecordBatch:
    size = len(n)
    columns = [
        pa.nulls(size, pa.string()) if lang is None else lang,
        pa.nulls(size, pa.binary()) if word is None else pa.array(word, pa.binary()),
        pa.array(n, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_COUNTED_ARROW)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their hashes (``lang``, ``word``, ``n``)."""
    for batch in batches:
        langs, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        hashes = np.array(
            [word_hash(word, _seed(lang)) for lang, word in zip(langs, words, strict=True)],
            dtype=np.uint64,
        )
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(hashes.view(np.int64))], ["lang", "word", "n", "h"]
        )


def _count_words(max_words: int, routes: int) -> Callable:
    """Words with their counts; under no word, the words of a language altogether; under no
    language, how many suffixes each route would get."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, hashes, langs, words in Reader().read(batches):
            counts = np.bincount(numbers, minlength=len(words))[1:]
            langs = pa.array(langs[1:], pa.string())
            yield _counted(langs, words[1:], counts)
            sums = pa.table({"lang": langs, "n": counts}).group_by("lang").aggregate([("n", "sum")])
            yield _counted(sums["lang"].combine_chunks(), None, sums["n_sum"].combine_chunks())
            columns = _suffixes(numbers, max_words)
            mixed = _mixed([hashes[c] for c in columns[:2]])
            for depth in range(2, max_words):
                sizes = np.bincount((mixed % np.uint64(routes)).astype(np.int64), minlength=routes)
                at = np.flatnonzero(sizes)
                yield _counted(None, [b"%d" % (depth * _DEPTH + i) for i in at], sizes[at])
                longer = columns[depth] != _NONE
                columns = [c[longer] for c in columns]
                mixed = _mixed([hashes[columns[depth]]], mixed[longer])

    return run


def _bitmap(words: DataFrame) -> np.ndarray:
    """Bits of the frequent words' hashes, one byte each."""
    size = LEAST_BITS
    n = words.count()
    while size < min(n * BITS_A_WORD, MOST_BITS):
        size *= 2
    place = F.col("h").bitwiseAND(F.lit(size - 1)) + 1
    blocks = (
        words.groupBy(F.bitmap_bucket_number(place).alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        .collect()
    )
    bits = np.zeros(size // 8, dtype=np.uint8)
    for r in blocks:
        at = (r["block"] - 1) * 4096
        part = np.frombuffer(r["bits"], dtype=np.uint8)[: len(bits) - at]
        bits[at : at + len(part)] = part
    return bits


def _listed(words: DataFrame) -> np.ndarray:
    """Hashes of the frequent words, the most frequent first, after that of no word."""
    found = words.select("h", "n").toPandas()
    h, n = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    return np.concatenate([np.zeros(1, dtype=np.uint64), h[np.lexsort((h, -n))]])


def _by_bitmap(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Numbers as they are; 0 for words that are not frequent."""
    place = hashes & np.uint64(len(bits) * 8 - 1)
    known = (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7))) & 1
    return np.where(known.astype(bool), np.arange(len(hashes)), _NONE)


def _by_list(hashes: np.ndarray, listed: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers in the list; 0 for words that are not frequent. ``order`` sorts the list."""
    at = order[np.minimum(np.searchsorted(listed, hashes, sorter=order), len(order) - 1)]
    return np.where(listed[at] == hashes, at, _NONE)


# --- routing ----------------------------------------------------------------------------------


def _mixed(columns: list[np.ndarray], out: np.ndarray | None = None) -> np.ndarray:
    """A hash of each row of the columns, or of the columns after those hashed already."""
    if out is None:
        out = np.full(len(columns[0]), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for c in columns:
        out = (out ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(32)
    return out


def _suffixes(numbers: np.ndarray, max_words: int) -> list[np.ndarray]:
    """The words of all suffixes of two words or more by place; 0 ends a suffix."""
    n = len(numbers)
    padded = np.concatenate([numbers, np.zeros(max_words, dtype=numbers.dtype)])
    at = np.flatnonzero((padded[:n] != _NONE) & (padded[1 : n + 1] != _NONE))
    columns = [padded[at], padded[at + 1]]
    for k in range(2, max_words):
        columns.append(np.where(columns[-1] != _NONE, padded[at + k], _NONE))
    return columns


def _combined(
    columns: list[np.ndarray], weights: np.ndarray
) -> tuple[list[np.ndarray], np.ndarray]:
    """Suffixes in order of their words' numbers, equal ones as one with the sum of weights."""
    if not len(weights):
        return columns, weights
    bits = max(1, int(max(c.max() for c in columns)).bit_length())
    together = max(1, 63 // bits)
    keys = []
    for k in range(0, len(columns), together):
        key = np.zeros(len(weights), dtype=np.int64)
        for c in columns[k : k + together]:
            key = (key << bits) | c
        keys.append(key)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for key in keys:
        held = key[order]
        new[1:] |= held[1:] != held[:-1]
    first = np.flatnonzero(new)
    at = order[first]
    return [c[at] for c in columns], np.add.reduceat(weights[order], first)


def _packed(numbers: np.ndarray) -> bytes:
    """Non-negative numbers, all their lowest bytes first."""
    return pa.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, n * 4, "zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _blocks(
    columns: list[np.ndarray],
    weights: np.ndarray,
    hashes: np.ndarray,
    route: np.ndarray,
    own_words: bool,
) -> Iterator[dict]:
    """The suffixes of each route as one block, with the words it needs if they are its own."""
    order = np.argsort(route, kind="stable")
    route = route[order]
    begin = 0
    for end in [*(np.flatnonzero(np.diff(route)) + 1), len(route)] if len(route) else []:
        at = order[begin:end]
        numbers = np.concatenate([c[at] for c in columns])
        used = np.zeros(0, dtype=np.int64)
        if own_words:
            used, numbers = np.unique(np.append(numbers, _NONE), return_inverse=True)
            numbers = numbers[:-1]
        yield {
            "route": int(route[begin]),
            "n": len(at),
            "words": hashes[used].tobytes(),
            "suffixes": _packed(numbers),
            "weights": _packed(weights[at]),
        }
        begin = end


def _opened(
    n: int, words: bytes, suffixes: bytes, weights: bytes, max_words: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes, the suffixes as a matrix of word numbers, and their weights."""
    matrix = _unpacked(suffixes, n * max_words).reshape(max_words, n)
    return np.frombuffer(words, np.uint64), matrix, _unpacked(weights, n)


def _deal(
    frequent: np.ndarray, listed: bool, max_words: int, routes: int, wide: frozenset[int]
) -> Callable:
    """Suffixes of at least two frequent words, in blocks by route. ``frequent`` is the list of
    words or their bitmap."""

    def dealt(columns: list, weights: np.ndarray, hashes: np.ndarray) -> Iterator[dict]:
        for depth in range(2, max_words + 1):
            if not len(weights):
                return
            mixed = _mixed([hashes[c] for c in columns[:depth]])
            route = (mixed % np.uint64(routes)).astype(np.int64) + depth * _DEPTH
            on = np.isin(route, [r for r in wide if r // _DEPTH == depth])
            rest = [c[~on] for c in columns]
            yield from _blocks(rest, weights[~on], hashes, route[~on], not listed)
            # Of suffixes that go on by one more word, the beginnings are counted here.
            none = np.full(int(on.sum()), _NONE, dtype=columns[0].dtype)
            begun, n = _combined(
                [c[on] if k < depth else none for k, c in enumerate(columns)], weights[on]
            )
            if len(n):
                mixed = _mixed([hashes[c] for c in begun[:depth]])
                route = (mixed % np.uint64(routes)).astype(np.int64) + depth * _DEPTH
                yield from _blocks(begun, n, hashes, route, not listed)
            if depth < max_words:
                on &= columns[depth] != _NONE
            columns, weights = [c[on] for c in columns], weights[on]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(frequent) if listed else None
        for numbers, hashes, _, _ in Reader().read(batches):
            if listed:
                kept, hashes = _by_list(hashes, frequent, order)[numbers], frequent
            else:
                kept = _by_bitmap(hashes, frequent)[numbers]
            columns = _suffixes(kept, max_words)
            columns, weights = _combined(columns, np.ones(len(columns[0]), dtype=np.int64))
            held: list[dict] = []
            for row in dealt(columns, weights, hashes):
                held.append(row)
                if len(held) >= 256:
                    yield pa.RecordBatch.from_pylist(held, schema=_DEALT_ARROW)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=_DEALT_ARROW)

    return run


# --- sorting ----------------------------------------------------------------------------------


def frequent_prefixes(
    columns: np.ndarray, weights: np.ndarray, least: int, shortest: int
) -> Iterator[tuple[int, int, int]]:
    """``(pointer, words, count)`` of every beginning of ``shortest`` words or more that ``least``
    suffixes have. ``columns[k]`` are the suffixes' words of place ``k``, 0 after the last."""
    depth_end = len(columns)
    stack = [(np.arange(len(weights)), 0)]
    while stack:
        pointers, depth = stack.pop()
        if int(weights[pointers].sum()) < least:
            continue
        key = columns[depth][pointers]
        pivot = key[len(key) // 2]
        below, above = key < pivot, key > pivot
        if below.any():
            stack.append((pointers[below], depth))
        if above.any():
            stack.append((pointers[above], depth))
        if pivot == _NONE:
            continue
        equal = pointers[key == pivot]
        count = int(weights[equal].sum())
        if count < least:
            continue
        if depth + 1 >= shortest:
            yield int(equal[0]), depth + 1, count
        if depth + 1 < depth_end:
            stack.append((equal, depth + 1))


def _sort_route(listed: np.ndarray | None, least: int, max_words: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        blocks = table.select(["n", "words", "suffixes", "weights"]).to_pylist()
        opened = [_opened(**r, max_words=max_words) for r in blocks]
        known, parts, at = listed, [matrix for _, matrix, _ in opened], 0
        if known is None:
            known, numbers = np.unique(np.concatenate([o[0] for o in opened]), return_inverse=True)
            # Hash 0 is that of number 0 in every block, and the smallest there is.
            for k, (hashes, matrix, _) in enumerate(opened):
                parts[k] = numbers[at : at + len(hashes)][matrix]
                at += len(hashes)
        columns, weights = np.concatenate(parts, 1), np.concatenate([o[2] for o in opened])
        depth = key[0].as_py() // _DEPTH
        found = list(frequent_prefixes(columns, weights, least, depth))
        phrases = [known[columns[:n, p]].view(np.int64).tolist() for p, n, _ in found]
        return pa.table(
            [pa.array(phrases, pa.list_(pa.int64())), pa.array([c for *_, c in found], pa.int64())],
            schema=_SORTED_ARROW,
        )

    return run


def phrase_counts(
    docs: DataFrame, space: Workspace, least: int = 100, max_words: int = 5
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words ``lang, word, h, n``, languages ``lang, n`` and phrases ``phrase, a``.

    A phrase is the array of its words' hashes, two at least; ``a`` counts its occurrences.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNDETERMINED)).alias("lang"), "text"
    )
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    routes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // ROUTE_BYTES))
    counted = space.keep(
        texts.mapInArrow(_count_words(max_words, routes), _COUNTED)
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
        .where(F.col("word").isNull() | F.col("lang").isNull() | (F.col("n") >= least)),
        "counted",
    )
    lang, word = F.col("lang"), F.col("word")
    words = space.keep(
        counted.where(lang.isNotNull() & word.isNotNull()).mapInArrow(
            _hashed, "lang string, word binary, n long, h long"
        ),
        "words",
    )
    langs = counted.where(word.isNull()).select("lang", "n")
    sizes = counted.where(lang.isNull()).select(word.cast("string").cast("long").alias("h"), "n")
    total = sizes.where(F.col("h") < 3 * _DEPTH).agg(F.sum("n")).first()[0] or 0
    limit = max(LEAST_UNEVEN, total * UNEVEN // routes)
    # At most routes / UNEVEN at each depth.
    wide = frozenset(r["h"] for r in sizes.where(F.col("n") > limit).select("h").collect())
    listed = words.count() <= MOST_LISTED
    frequent = _listed(words) if listed else _bitmap(words)
    phrases = (
        texts.mapInArrow(_deal(frequent, listed, max_words, routes, wide), _DEALT)
        .groupBy("route")
        .applyInArrow(_sort_route(frequent if listed else None, least, max_words), _SORTED)
    )
    return words, langs, space.keep(phrases, "phrases")


# --- scores -----------------------------------------------------------------------------------


def exact_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """``floor(1000 a n / (l r))``: products of up to 38 digits."""
    a, n, left, right = (c.cast("decimal(38,0)") for c in (a, n, left, right))
    return F.call_function("div", F.lit(1000).cast("decimal(38,0)") * a * n, left * right)


def collocations(
    docs: DataFrame,
    least: int = 100,
    max_words: int = 5,
    top: int = 2000,
    contained_percent: int = 100,
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase of two words or more that occurs ``a >= least`` times among ``n`` words is scored at
    its weakest cut into parts that occur ``l`` and ``r`` times, the first of equal ones. It is left
    out where a longer phrase that holds it occurs ``contained_percent`` % as often.
    """
    space = Workspace(docs.sparkSession, "collocations")
    words, langs, phrases = phrase_counts(docs, space, least, max_words)
    size = F.size("phrase")

    inside = F.expr(
        "flatten(transform(sequence(2, size(phrase) - 1), m -> "
        "transform(sequence(1, size(phrase) - m + 1), i -> slice(phrase, i, m))))"
    )
    holders = (
        phrases.where(size > 2)
        .select(F.explode(F.array_distinct(inside)).alias("phrase"), F.col("a").alias("_longer"))
        .groupBy("phrase")
        .agg(F.max("_longer").alias("_longer"))
    )
    kept = (
        phrases.join(holders, "phrase", "left")
        .where(
            F.col("_longer").isNull()
            | (F.col("_longer") * 100 < F.col("a") * contained_percent)
        )
        .drop("_longer")
    )
    parts = phrases.select("phrase", "a").unionByName(
        words.select(F.array("h").alias("phrase"), F.col("n").alias("a"))
    )
    left = parts.select(F.col("phrase").alias("_left"), F.col("a").alias("l"))
    right = parts.select(F.col("phrase").alias("_right"), F.col("a").alias("r"))
    of_lang = words.select(F.col("h").alias("_h"), "lang").join(langs, "lang")
    cut = (
        kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
        .withColumn("_left", F.slice("phrase", F.lit(1), F.col("k")))
        .withColumn("_right", F.slice("phrase", F.col("k") + 1, size))
        .join(left, "_left")
        .join(right, "_right")
        .join(of_lang, F.col("phrase")[0] == F.col("_h"))
        .withColumn("score", exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    )
    scored = (
        cut.groupBy("lang", "n", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
        .select("lang", "n", "phrase", "a", "_cut.score", "_cut.l", "_cut.r")
    )
    spelled = (
        scored.select("*", F.posexplode("phrase").alias("_at", "_h"))
        .join(words.select(F.col("h").alias("_h"), F.col("word").cast("string")), "_h")
        .groupBy("lang", "n", "phrase", "a", "score", "l", "r")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "word"))).alias("_words"))
        .withColumn("phrase", F.array_join(F.col("_words.word"), " "))
    )
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        spelled.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
    )
