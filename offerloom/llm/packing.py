"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document is tokenised and cut at window
length; what is left of it goes to the open window it fits best, the one it leaves the least room
in. When it fits nowhere and no window is free, the fullest is topped up with the head of the piece,
which fills it to the last token, and emitted. At the end of a partition its open windows are
merged into full ones, with less than one window left over. The leftovers of all partitions are
merged in the same way, group by group, until one is left; that is cut into lengths that are powers
of two, which need no padding.

Nulls: a null text is an empty one: only the end token. Rows with equal ``doc_id`` are packed one
after the other, each with ids of its own from 0. An empty table gives an empty result. Texts of any
length are encoded whole, in steps that end where no token can cross.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.store import Workspace, modest_batches

SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "closed boolean, ids binary"
)
_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")]
    + [("closed", pa.bool_()), ("ids", pa.binary())]
)
#: The pre-tokenizer of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are encoded in steps of about this many characters.
STEP_CHARS = 100_000
#: Leftovers of so many partitions are merged in one task.
MERGE_PARTS = 512
#: A sequence id is the level of merging, the task and a count within it.
_LEVEL_SHIFT, _PART_SHIFT = 58, 36
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_ENCODERS: dict[str, object] = {}


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves,
    the others numbered from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(path: str):
    """An encoder for a byte-level tokenizer file whose ids follow the order of its merges.

    Special tokens of the file are recognised in texts, as its own library does.
    """
    if path not in _ENCODERS:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {
            bytes(letters[c] for c in token): i
            for token, i in file["model"]["vocab"].items()
            if token not in special
        }
        _ENCODERS[path] = tiktoken.Encoding(
            "byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
    return _ENCODERS[path]


def steps(text: str, chars: int = STEP_CHARS) -> Iterator[str]:
    """Cut a text before single spaces between words: no token reaches across those."""
    at = 0
    while len(text) - at > chars:
        cut = _SAFE_CUT.search(text, at + chars)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str, path: str, end_id: int) -> np.ndarray:
    enc = encoder(path)
    parts = [enc.encode_to_numpy(s, allowed_special="all").astype("<u4") for s in steps(text)]
    return np.concatenate([*parts, np.array([end_id], dtype="<u4")])


class Packer:
    """Open windows of one task. A piece is ``(doc_id, start, doc_tokens, ids)``."""

    def __init__(self, first_id: int, window: int, most_open: int) -> None:
        self.window, self.most_open = window, most_open
        self.next_id = first_id
        self.open: list[tuple[int, list]] = []  # (filled, pieces)
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while len(ids) - at >= self.window:
            self._emit([(doc_id, at, len(ids), ids[at : at + self.window])])
            at += self.window
        if at < len(ids):
            self._place((doc_id, at, len(ids), ids[at:]))

    def _place(self, piece: tuple) -> None:
        doc_id, start, total, ids = piece
        fits = [
            (filled, k)
            for k, (filled, _) in enumerate(self.open)
            if filled + len(ids) <= self.window
        ]
        if fits:
            filled, k = max(fits)
            self.open[k][1].append(piece)
            self.open[k] = (filled + len(ids), self.open[k][1])
            if self.open[k][0] == self.window:
                self._emit(self.open.pop(k)[1])
        elif len(self.open) < self.most_open:
            self.open.append((len(ids), [piece]))
        else:
            k = max(range(len(self.open)), key=lambda i: self.open[i][0])
            filled, pieces = self.open.pop(k)
            room = self.window - filled
            self._emit([*pieces, (doc_id, start, total, ids[:room])])
            self._place((doc_id, start + room, total, ids[room:]))

    def merge(self, last: bool) -> None:
        """Join the open windows end to end; ``last`` closes the rest in powers of two."""
        pieces = [p for _, group in self.open for p in group]
        self.open = []
        rest = sum(len(p[3]) for p in pieces)
        while rest >= self.window:
            pieces = self._cut(pieces, self.window)
            rest -= self.window
        while last and rest:
            size = 1 << (rest.bit_length() - 1)
            pieces = self._cut(pieces, size)
            rest -= size
        # Less than a window is left over; ids are cut so that the next merge can go on.
        if pieces:
            self._emit(pieces, closed=False)

    def _cut(self, pieces: list, size: int) -> list:
        """Emit the first ``size`` ids of the pieces as one sequence and return what follows."""
        taken = []
        for k, (doc_id, start, total, ids) in enumerate(pieces):
            if len(ids) >= size:
                self._emit([*taken, (doc_id, start, total, ids[:size])])
                rest = [(doc_id, start + size, total, ids[size:])] if len(ids) > size else []
                return rest + pieces[k + 1 :]
            taken.append((doc_id, start, total, ids))
            size -= len(ids)
        raise ValueError("fewer ids than asked for")

    def _emit(self, pieces: list, closed: bool = True) -> None:
        offset = 0
        for doc_id, start, total, ids in pieces:
            self.out.append(
                (doc_id, start, len(ids), total, self.next_id, offset, closed, ids.tobytes())
            )
            offset += len(ids)
        self.next_id += 1

    def batch(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        """What was emitted so far, once it is more than ``least`` pieces."""
        if len(self.out) > least:
            columns = zip(*self.out, strict=True)
            self.out = []
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW
            )


def _pack_texts(path: str, end_id: int, window: int, most_open: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << _PART_SHIFT, window, most_open)
        for batch in batches:
            for doc_id, text in zip(
                batch.column(0).to_pylist(), batch.column(1), strict=True
            ):
                packer.add(doc_id, encode(text.as_py() or "", path, end_id))
                yield from packer.batch(512)
        packer.merge(last=False)
        yield from packer.batch()

    return run


def _merge_rest(level: int, window: int, last: bool) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        packer = Packer((level << _LEVEL_SHIFT) | (key[0].as_py() << _PART_SHIFT), window, 1)
        pieces = [
            (r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], dtype="<u4"))
            for r in table.to_pylist()
        ]
        packer.open = [(0, pieces)]
        packer.merge(last)
        return pa.Table.from_batches(list(packer.batch()), schema=_ARROW)

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    window: int = 2048,
    most_open: int = 64,
    digest: dict[str, Column] | None = None,
) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are little-endian unsigned 32-bit numbers. ``tokenizer`` is a file that every executor
    has. ``digest`` names columns, expressions of a piece, to keep instead of ``ids``, so that the
    ids of finished sequences need not be written.
    """
    kept = digest or {"ids": F.col("ids")}
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
    modest_batches(docs.sparkSession)
    space = Workspace(docs.sparkSession, "pack")

    def written(pieces: DataFrame, level: int) -> DataFrame:
        rest = F.when(~F.col("closed"), F.col("ids")).alias("_rest")
        columns = [c.alias(name) for name, c in kept.items()]
        return space.keep(pieces.select(*names, "closed", *columns, rest), f"level-{level}")

    now = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(
            _pack_texts(tokenizer, end_id, window, most_open), SCHEMA
        ),
        0,
    )
    level, done = 0, now.where("closed")
    part = F.shiftright(F.shiftleft("sequence_id", 6), 6 + _PART_SHIFT)
    while True:
        rest = now.where(~F.col("closed")).select(*names, "closed", F.col("_rest").alias("ids"))
        last_part = rest.agg(F.max(part)).first()[0]
        if last_part is None:
            break
        level += 1
        merge = _merge_rest(level, window, last=last_part < MERGE_PARTS)
        groups = rest.groupBy(F.floor(part / MERGE_PARTS).alias("_group"))
        now = written(groups.applyInArrow(merge, SCHEMA), level)
        done = done.unionByName(now.where("closed"))
    return done.select(*names, *kept)
