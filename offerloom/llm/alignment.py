"""Alignment of two tokenizers' tokens by interval coalescing.

Tokenizer A is a byte-level one, B has pieces with byte fallback. Both cover the same bytes, a space
and the text. The tokens of many documents are laid end to end as byte ranges and sorted by start,
A before B. Where a start reaches the running maximum of the ends before it, a new group begins: the
tokens of a group cover the same bytes in both tokenizations and no part of it does. Within a group
each distinct start is the first byte that the latest A and the latest B token share: one link of
two tokens that overlap.

An id pair counts once for each document in which it is linked. Documents are read once, in blocks
of bounded size. A block's distinct pairs go to the global counts, with their number of documents;
the links of its documents are kept as places in that list. When the counts are known, each block
gets those of its own pairs and its documents are summed up. What is shuffled is one row for each
pair of a block and the blocks themselves; no pair of ids is one task's work, as a block sends it
once.

Long texts are read in steps that end before a space between two ASCII letters or digits, where no
token of either kind reaches across.

Nulls: a null or empty text has no tokens, nor has one that either tokenizer does not give back byte
for byte; its numbers are 0 and its list of groups is ``''``. Rows of one ``doc_id`` are documents
of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.packing import encoder
from offerloom.llm.store import Workspace, modest_batches

#: Texts are encoded in steps of about this many characters.
STEP_CHARS = 100_000
#: A block of documents ends beyond so many tokens, one of the steps of a long text as well.
BLOCK_TOKENS = 400_000
_SAFE_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
_SHIFT = np.int64(32)

_READ = (
    "block long, doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, links binary, pair long, n long"
)
_READ_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("block", "doc_id", "row", "n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("links", pa.binary()), ("pair", pa.int64()), ("n", pa.int64())]
)


# --- tokenizers -------------------------------------------------------------------------------


class Tokenizers:
    """Both tokenizers of a task: ids and byte lengths of the tokens of texts."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = encoder(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.a.n_vocab
        self.bytes_a = [b""] * n
        for i in range(n):
            try:
                self.bytes_a[i] = self.a.decode_single_token_bytes(i)
            except KeyError:
                continue
        self.bytes_b = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i in range(self.b.vocab_size())
            for piece in (self.b.id_to_piece(i),)
        ]
        self.sizes_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text without its leading space, or none where bytes are not given back."""
        whole = (" " + text).encode()
        a = self.a.encode_to_numpy(" " + text, allowed_special=set(), disallowed_special=())
        b = self.b.encode(text)
        if b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != whole:
            return None
        return a.astype(np.int64), np.array(b, dtype=np.int64)


@cache
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def steps(text: str, chars: int = STEP_CHARS) -> Iterator[str]:
    """Cut a text at single spaces that both tokenizers begin a token with; those are left out."""
    at = 0
    while len(text) - at > chars:
        cut = _SAFE_CUT.search(text, at + chars)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


# --- alignment --------------------------------------------------------------------------------


def align(
    a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coalesce two tokenizations of the same bytes.

    Returns the order of all tokens, A's numbered before B's, by group, tokenizer and place; the
    group of each token in that order; and the places in ``a`` and ``b`` of each link's tokens.
    """
    ends = np.concatenate([np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])])
    starts = ends - np.concatenate([sizes_a[a], sizes_b[b]])
    is_b = np.arange(len(ends)) >= len(a)
    order = np.lexsort((is_b, starts))
    start, reach = starts[order], np.maximum.accumulate(ends[order])
    begins = np.ones(len(order), dtype=bool)
    begins[1:] = start[1:] >= reach[:-1]
    group = np.cumsum(begins) - 1
    # The latest token of each kind at every distinct start.
    last = np.ones(len(order), dtype=bool)
    last[:-1] = start[1:] != start[:-1]
    kind = is_b[order]
    link_a = np.maximum.accumulate(np.where(kind, -1, order))[last]
    link_b = np.maximum.accumulate(np.where(kind, order - len(a), -1))[last]
    grouped = np.lexsort((order, group))
    return order[grouped], group[grouped], link_a, link_b


@cache
def _spelled(n: int) -> np.ndarray:
    """``,i``, ``;i`` and ``|i`` of every id below ``n``, padded with zero bytes."""
    return np.array([f"{mark}{i}" for mark in ",;|" for i in range(n)], dtype="S")


def spell_groups(
    a: np.ndarray, b: np.ndarray, order: np.ndarray, group: np.ndarray, n_ids: int
) -> bytes:
    """``;a1,a2|b1;a3|b2,b3``: every group with a mark before it."""
    is_b = order >= len(a)
    new = np.ones(len(order), dtype=bool)
    new[1:] = group[1:] != group[:-1]
    mark = np.where(new, 1, 0)
    mark[1:][is_b[1:] & ~is_b[:-1] & ~new[1:]] = 2
    ids = np.concatenate([a, b])[order]
    return _spelled(n_ids)[mark * n_ids + ids].tobytes().replace(b"\0", b"")


class _Document:
    """What is known of a document whose steps have been read so far."""

    def __init__(self, doc_id: int | None) -> None:
        self.doc_id = doc_id
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.digest = hashlib.sha256()
        self.links: list[np.ndarray] = []

    def add(self, a: np.ndarray, b: np.ndarray, both: Tokenizers) -> None:
        order, group, link_a, link_b = align(a, b, both.sizes_a, both.sizes_b)
        n_ids = max(len(both.bytes_a), len(both.bytes_b))
        spelled = spell_groups(a, b, order, group, n_ids)
        self.digest.update(spelled if self.n_a else spelled[1:])
        self.n_a += len(a)
        self.n_b += len(b)
        self.n_groups += int(group[-1]) + 1
        self.n_links += len(link_a)
        self.links.append((a[link_a] << _SHIFT) | b[link_b])


class _Block:
    """Documents of a task whose distinct pairs are counted together."""

    def __init__(self, number: int) -> None:
        self.number, self.rows, self.links, self.tokens = number, [], [], 0

    def add(self, doc: _Document | None, doc_id: int | None) -> None:
        done = doc is not None and doc.n_a > 0
        self.rows.append(
            {
                "block": self.number,
                "doc_id": doc_id,
                "row": len(self.rows),
                "n_a": doc.n_a if done else 0,
                "n_b": doc.n_b if done else 0,
                "n_groups": doc.n_groups if done else 0,
                "n_links": doc.n_links if done else 0,
                "groups_sha256": doc.digest.hexdigest() if done else "",
            }
        )
        links = np.concatenate(doc.links) if done else np.zeros(0, dtype=np.int64)
        self.links.append(links)
        self.tokens += len(links)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The documents, their links as places in the block's pairs, and those pairs."""
        if not self.rows:
            return
        pairs, place = np.unique(np.concatenate(self.links), return_inverse=True)
        place = place.astype("<u4")
        held = np.zeros(len(pairs), dtype=np.int64)
        at = 0
        for row, links in zip(self.rows, self.links, strict=True):
            own = place[at : at + len(links)]
            at += len(links)
            held[np.unique(own)] += 1
            row["links"] = own.tobytes()
        yield pa.RecordBatch.from_pylist(self.rows, schema=_READ_ARROW)
        for first in range(0, len(pairs), 50_000):
            part = slice(first, first + 50_000)
            n = len(pairs[part])
            columns = {
                "block": pa.array(np.full(n, self.number)),
                "row": pa.array(np.arange(first, first + n)),
                "pair": pa.array(pairs[part]),
                "n": pa.array(held[part]),
            }
            yield pa.RecordBatch.from_arrays(
                [columns.get(f.name, pa.nulls(n, f.type)) for f in _READ_ARROW],
                schema=_READ_ARROW,
            )


def _read(path_a: str, path_b: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(path_a, path_b)
        block = _Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc = _Document(doc_id)
                for step in steps(text.as_py() or ""):
                    tokens = both.read(step) if step else None
                    if tokens is None:
                        doc = None
                        break
                    doc.add(*tokens, both)
                block.add(doc, doc_id)
                if block.tokens >= BLOCK_TOKENS or len(block.rows) >= 4096:
                    yield from block.batches()
                    block = _Block(block.number + 1)
        yield from block.batches()

    return run


_SUMMED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string"
)


def _sum_up(documents: pa.Table, pairs: pa.Table) -> pa.Table:
    """Counts of a block's pairs added up along the links of its documents."""
    row = pairs["place"].to_numpy()
    count = np.zeros(len(row), dtype=np.int64)
    best = np.zeros(len(row), dtype=np.int64)
    count[row], best[row] = pairs["count"].to_numpy(), pairs["best"].to_numpy()
    n_best, count_sum = [], []
    for links in documents["links"]:
        at = np.frombuffer(links.as_py(), dtype="<u4")
        n_best.append(int(best[at].sum()))
        count_sum.append(int(count[at].sum()))
    kept = documents.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return (
        kept.append_column("n_best", pa.array(n_best, pa.int64()))
        .append_column("count_sum", pa.array(count_sum, pa.int64()))
        .select([c.split()[0] for c in _SUMMED.split(", ")])
    )


def pair_counts(read: DataFrame, space: Workspace) -> DataFrame:
    """``pair, count, best``: the documents that hold a pair linked, and whether no other pair of
    its A id is held by more."""
    counts = space.keep(
        read.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("n").alias("count")),
        "counts",
    )
    of_a = F.shiftright("pair", int(_SHIFT)).alias("_a")
    highest = counts.groupBy(of_a).agg(F.max("count").alias("_highest"))
    return (
        counts.select("*", of_a)
        .join(highest, "_a")
        .select("pair", "count", (F.col("count") == F.col("_highest")).cast("long").alias("best"))
    )


def align_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Of each document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best`` are the links whose pair is the most frequent of its A id, ties included, and
    ``count_sum`` adds up the pairs' counts over the links. The tokenizer files must be at the same
    place on every executor.
    """
    modest_batches(docs.sparkSession)
    space = Workspace(docs.sparkSession, "align")
    read = space.keep(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            _read(path_a, path_b), _READ
        ),
        "read",
    )
    is_pair = F.col("pair").isNotNull()
    counts = pair_counts(read, space)
    of_block = (
        read.where(is_pair)
        .select(F.col("block").alias("of_block"), F.col("row").alias("place"), "pair")
        .join(counts, "pair")
        .select("of_block", "place", "count", "best")
    )
    return (
        read.where(~is_pair)
        .drop("pair", "n", "row")
        .groupBy("block")
        .cogroup(of_block.groupBy("of_block"))
        .applyInArrow(_sum_up, _SUMMED)
    )
