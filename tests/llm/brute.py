"""Plain versions of the operators, and the odd rows that every operator is tried on."""

import random
from collections import defaultdict

import xxhash

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACES = " \t\n\x0b\f\r"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "_id long, _row string, _doc int, size double, kept_text string, component int, `class` int"
)


def documents(seed=3, n=60):
    """Documents with copies, near copies, shared lines, nulls, empty and long texts and ties."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeäñ") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    shared = "This very line is found in Several documents"
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 4 and i > 6:
            texts.append(texts[i - 4])
        elif kind == 5 and i > 6:
            changed = texts[i - 5].split(" ")
            changed[rng.randrange(len(changed))] = "changed"
            texts.append(" ".join(changed))
        else:
            lines = [" ".join(rng.choices(words, k=rng.randint(5, 40))) for _ in range(3)]
            if kind == 1:
                lines.insert(1, "  " + (shared if i % 4 else shared.upper()) + "\t")
            texts.append("\n".join(lines))
    texts += [None, "", "   \n\t ", "one", "Two words", "12 34 !!", "\n\n", " ".join(words * 60)]
    rows = [(i, t, "de" if i % 3 else "en", f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, texts[3], None, None), (None, None, None, None)]
    rows += [(200 + i, "tie tie tie tie tie tie", None, None) for i in range(3)]
    return rows


def frame(spark, rows):
    """The rows with further columns whose names the operators use themselves."""
    return spark.createDataFrame(
        [(*r, len(r[1] or ""), 1, "x", 2, 0.5, "y", 3, 4) for r in rows], SCHEMA
    )


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def deduped_lines(rows, min_chars=20, min_docs=3):
    """(doc_id, text) -> (n_lines, n_dropped, kept) by the rule for lines."""
    low = -(2**63)

    def key(line):
        return line.strip(SPACES).encode().translate(LOWER).decode()

    holders = defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(low if d is None else d)
    out = {}
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        me = low if d is None else d
        kept = [
            x
            for x in lines
            if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == me
        ]
        out[(d, t)] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def shingles(text, k):
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return set()
    if len(words) < k:
        return {tuple(words)}
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def jaccard(rows, k, percent):
    """(doc_id, text) -> (set size, component)."""
    nodes = sorted({(d is None, d or 0, t or "") for d, t, *_ in rows})
    sets = [shingles(t, k) for _, _, t in nodes]
    parent = list(range(len(nodes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and 100 * shared >= percent * (len(a) + len(sets[j]) - shared):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (missing, d, _) in enumerate(nodes):
        if not missing:
            least[root(i)] = min(least.get(root(i), d), d)
    return {
        (None if missing else d, t): (len(sets[i]), least.get(root(i)))
        for i, (missing, d, t) in enumerate(nodes)
    }


def winnowed(text, k, w):
    """Chosen (hash, position) pairs, window by window."""
    data = (text or "").encode()
    if not data:
        return []

    def hashed(x):
        return (xxhash.xxh64_intdigest(x, seed=42) ^ (2**64 - 1) ^ 2**63) >> 9

    if len(data) < k:
        grams = [hashed(data)]
    else:
        grams = [hashed(data[i : i + k]) for i in range(len(data) - k + 1)]
    chosen = []
    for i in range(max(1, len(grams) - w + 1)):
        window = list(enumerate(grams[i : i + w], i))
        least = min(h for _, h in window)
        pair = ((least ^ 2**54) >> 23, max(p for p, h in window if h == least))
        if pair not in chosen[-w:]:
            chosen.append(pair)
    return chosen


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0
