"""Token alignment against a walk over bytes with the tokenizers' own libraries."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from brute import documents, empty, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from offerloom.llm import alignment

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
TOK = Tokenizer.from_file(A)
TOK.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=B)
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
LETTERS = {chr(b): b for b in _SHOWN}
LETTERS |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def tokens(text):
    """[(id, start, end)] of both tokenizers, or none."""
    out = []
    a = TOK.encode(" " + text, add_special_tokens=False).ids
    b = PIECES.encode(text)
    for ids, spelled in (
        (a, lambda i: bytes(LETTERS[c] for c in TOK.id_to_token(i))),
        (
            b,
            lambda i: bytes([int(PIECES.id_to_piece(i)[3:5], 16)])
            if PIECES.is_byte(i)
            else PIECES.id_to_piece(i).replace("▁", " ").encode(),
        ),
    ):
        parts = [spelled(i) for i in ids]
        if b"".join(parts) != (" " + text).encode():
            return None
        ends = np.cumsum([len(p) for p in parts]).tolist()
        out.append(list(zip(ids, [0, *ends], ends, strict=False)))
    return out


def aligned(rows):
    docs = []
    for doc_id, text, *_ in rows:
        both = tokens(text) if text else None
        if both is None:
            docs.append((doc_id, 0, 0, 0, [], ""))
            continue
        a, b = both
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for cut in cuts:
            parts = [",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in both]
            groups.append("|".join(parts))
            low = cut
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        docs.append((doc_id, len(a), len(b), len(groups), links, digest))
    counts = Counter(pair for d in docs for pair in set(d[4]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return [
        (
            doc_id,
            n_a,
            n_b,
            n_groups,
            len(links),
            sum(counts[p] == best[p[0]] for p in links),
            sum(counts[p] for p in links),
            digest,
        )
        for doc_id, n_a, n_b, n_groups, links, digest in docs
    ]


ODD = [
    "a <|endoftext|> b <s> </s> <unk> <0x41>",
    "▁ is no space",
    " x",
    "tab\tand\r\n\n two   spaces ",
    "日本語 и кириллица é ﬁ ½ 👩‍👩‍👧",
    "\x00\x01 \x7f",
    "x" * 3000,
]


def test_alignment(spark, monkeypatch):
    monkeypatch.setattr(alignment, "STEP_CHARS", 300)
    monkeypatch.setattr(alignment, "BLOCK_TOKENS", 900)
    rows = [(i, (t or "")[:1500] if t else t, None, None) for i, (_, t, *_) in enumerate(documents())]
    rows += [(500 + i, t, None, None) for i, t in enumerate(ODD)]
    rows += [(7, "the same id", None, None), (None, rows[0][1], None, None)]
    docs = frame(spark, rows).repartition(3)
    got = alignment.align_tokens(docs, A, B).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
    assert Counter(map(tuple, got.collect())) == Counter(aligned(rows))


def test_empty(spark):
    assert alignment.align_tokens(empty(spark), A, B).count() == 0
    nulls = frame(spark, [(1, None, None, None), (2, "", None, None)])
    rows = alignment.align_tokens(nulls, A, B).collect()
    assert sorted((r.doc_id, r.n_a, r.count_sum, r.groups_sha256) for r in rows) == [
        (1, 0, 0, ""),
        (2, 0, 0, ""),
    ]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300) | st.text(alphabet="ab ▁.\n1é", max_size=400))
def test_steps_do_not_change_tokens(text):
    both = alignment.tokenizers(A, B)
    whole = both.read(text)
    parts = [both.read(s) for s in alignment.steps(text, 20) if s]
    if whole is None or any(p is None for p in parts):
        assert whole is None or not text
        assert any(p is None for p in parts) or not text
    elif parts:
        for side in (0, 1):
            assert np.concatenate([p[side] for p in parts]).tolist() == whole[side].tolist()
