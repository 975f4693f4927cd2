"""SentencePiece codec: against the library on texts and on made-up strings, round trips, a unigram model by hand."""

import random

import numpy as np
import pytest
import sentencepiece

from leafwise.llm import sentencepiece_codec as C
from tests.llm.conftest import SF, docs_frame


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=C.default_model())


def ids_of(encoder, texts, batch=300):
    return [np.frombuffer(b, "<i4").tolist() for i in range(0, len(texts), batch) for b in encoder(texts[i:i + batch])]


def test_against_the_library(library):
    rng = random.Random(3)
    letters = "abcehinorst ▁  ñéßöü你好😀0123-_.\n\tx"
    texts = ["", "a", " ", "  a  b\tc\n ﬁ d", "\0x\0", "▁▁a", " " * 40 + "b", "a" * 3000, "́é", "aaaaa bbbb 1111111 ......  ----------====",
             "日本語のテキスト 執筆", "🙂🙃", "x" * 20_000 + " y"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    assert ids_of(C.Encoder(C.default_model()), texts) == library.encode(texts)


def test_forgets_at_the_bound(library, monkeypatch):
    monkeypatch.setattr(C, "CACHED_SEGMENTS", 20)
    texts = [f"some words {i} that change {i * 7} all the time" for i in range(60)]
    assert ids_of(C.Encoder(C.default_model()), texts, 5) == library.encode(texts)


def test_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import hashlib
    rows = C.op2_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_ids == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_inputs(spark):
    df = docs_frame(spark, [(1, None), (2, ""), (3, "é" * 100_000), (4, "same"), (4, "same"), (None, " x\n")]).selectExpr("*", "1 as ids")
    rows = C.decode_documents(C.encode_documents(df)).collect()
    assert sorted((r.text or "")[:5] for r in rows) == ["", "", " x\n", "same", "same", "ééééé"]
    assert [r.ids for r in rows if r.doc_id in (1, 2)] == [[], []]
    assert C.encode_documents(df.limit(0)).count() == 0


def test_suffix_index_finds_every_occurrence():
    rng = np.random.default_rng(5)
    codes = rng.integers(1, 4, 400).astype(np.uint16)
    index = C.SuffixIndex(codes, 8)
    for size in (1, 2, 3, 5, 8):
        for _ in range(20):
            word = rng.integers(1, 4, size).astype(np.uint16)
            low, high = np.zeros((1, 8), np.uint16), np.full((1, 8), 0xFFFF, np.uint16)
            low[0, :size] = high[0, :size] = word
            a, b = index.bound(C.pack(low), False)[0], index.bound(C.pack(high), True)[0]
            want = [i for i in range(400 - size + 1) if (codes[i:i + size] == word).all()]
            assert sorted(index.order[a:b].tolist()) == want


def test_unigram_relaxation_keeps_the_best_path(monkeypatch):
    """The same vocabulary read as a unigram model: best sum of scores, by plain dynamic programming."""
    v = C.Vocabulary(C.default_model(), "unigram")
    v.scores = np.where(v.scores < -1e8, -1e5, v.scores)
    words = ["▁the", "▁internationalization", "▁xyzzy", "▁a", "▁prices1234"]
    got = C.encode_segments(words, v)
    for w, ids in zip(words, got):
        best = [0.0] + [-np.inf] * len(w)
        for e in range(1, len(w) + 1):
            for s in range(e):
                i = v.id_of.get(w[s:e])
                if i is not None:
                    best[e] = max(best[e], best[s] + v.scores[i])
        assert "".join(v.pieces[i] for i in ids) == w and v.scores[ids].sum() == pytest.approx(best[-1])
