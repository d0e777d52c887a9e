"""The pipeline against plain versions of its stages."""

import struct
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from brute import deduped_lines, jaccard
from test_documents import sized
from tokenizers import Tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the weather of north was with them and that is what they thought when ship came home",
    "de": "das wetter ist nicht schön und die straße wird von den leuten über den berg gebaut",
}


def corpus():
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        words = WORDS[lang].split()
        text = " ".join(words[(i * j + j * j) % len(words)] + ("" if j % 4 else str(i)) for j in range(40))
        if i % 5 == 0:
            text += "\nThis line stands in many of the documents"
        rows.append((i, text, lang if i % 7 else None, f"s{i % 3}"))
    rows += [(100, rows[10][1], "en", "s0"), (101, rows[11][1] + " more", "de", "s1")]
    rows += [(102, "123 456 !", None, "s0"), (103, None, None, None), (104, "", "en", "s1")]
    rows += [(105, "Ελληνικά κείμενα μόνο εδώ", None, "s2")]
    return rows


def test_stages(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    outs, now = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        outs.append(now.collect())
        if k < 4:
            assert now.columns == docs.columns
    known, lined, distinct, mixed, packed = outs

    assert {r.doc_id for r in known} == {r[0] for r in rows} - {102, 103, 104, 105}
    assert all(r.lang for r in known)
    kept = deduped_lines([(r.doc_id, r.text) for r in known])
    assert {(r.doc_id, r.text) for r in lined} == {
        (d, text) for (d, _), (_, _, text) in kept.items()
    }
    assert all(r.n_chars == len(r.text) for r in lined)
    components = jaccard([(r.doc_id, r.text) for r in lined], 5, 80)
    assert {r.doc_id for r in distinct} == {d for (d, _), (_, c) in components.items() if c in (d, None)}
    assert len(distinct) == len({r.doc_id for r in distinct}) < len(lined)

    copies = Counter((r.doc_id, r.text) for r in mixed)
    assert max(copies.values()) <= 3 and set(copies) <= {(r.doc_id, r.text) for r in distinct}
    total, taken = defaultdict(int), defaultdict(int)
    for r in distinct:
        total[r.source] += sized(r.text)
    for r in mixed:
        taken[r.source] += sized(r.text)
    everything = sum(total.values())
    for s, weight in (("s0", 1), ("s1", 2), ("s2", 3)):
        assert abs(taken[s] - min(3 * total[s], everything * weight / 6)) <= 40

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for (d, text), n in copies.items():
        want[d] += n * (len(tokenizer.encode(text, add_special_tokens=False).ids) + 1)
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == want


def test_packed_ids_are_the_tokens_of_the_documents(spark, tmp_path):
    texts = [r[1] or "" for r in corpus()] + ["long text " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(found[r.doc_id])
        ids = struct.unpack(f"<{r.length}I", r.ids)
        assert zlib.crc32(r.ids) == r.ids_crc32
        found[r.doc_id] += ids
    assert found == {
        i: [*tokenizer.encode(text, add_special_tokens=False).ids, 1] for i, text in enumerate(texts)
    }


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
