"""Quality classifier: table scoring against the embeddings themselves, held-out accuracy, odd inputs."""

import random
import zlib

import numpy as np
import pytest

from leafwise.llm import quality_classifier as C
from tests.llm.conftest import docs_frame


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows = []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(15, 90))]
        kind = i % 6
        if kind == 0:
            text = [w + "###" for w in text]
        elif kind == 1:
            text = [w for w in text[:8] for _ in range(9)]
        rows.append((i, " ".join(text), int(kind > 1)))
    return rows


def test_scores_equal_the_network(corpus):
    sample = [(t, y) for _, t, y in corpus[:200]]
    vectors, out, bias = C.train(sample, epochs=3)
    scorer = C.Scorer((vectors @ (out[:, 1] - out[:, 0])).astype(float), float(bias[1] - bias[0]), 0.5)
    texts = [t for t, _ in sample[:40]] + ["", None, "one", "same same same"]
    got = scorer.score(texts)
    for text, p in zip(texts, got):
        ids, share = C.text_features(text, {})
        z = (share @ vectors[ids] if len(ids) else np.zeros(8)) @ out + bias
        assert p == pytest.approx(float(np.exp(z[1]) / np.exp(z).sum()), abs=1e-4)


def test_held_out_accuracy(spark, corpus):
    docs = docs_frame(spark, [(i, t) for i, t, _ in corpus])
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in corpus] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r.score for r in C.score_documents(docs, C.fit(docs, labels)).collect()}
    held = [(i, y) for i, _, y in corpus if zlib.crc32(str(i).encode()) % 5 == 0]
    wrong = [i for i, y in held if (rows[i] >= 0.3) != bool(y)]
    assert len(held) > 120 and len(wrong) <= 0.02 * len(held)


def test_odd_inputs(spark, corpus):
    model = C.fit_sample([(t, y) for _, t, y in corpus[:300]])
    odd = docs_frame(spark, [(1, None), (2, ""), (3, "x"), (4, "la " * 50_000), (4, "mi"), (4, "mi"), (None, "ü" * 100_000)])
    odd = odd.selectExpr("*", "1 as score")
    rows = C.score_documents(odd, model).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert C.score_documents(odd.limit(0), model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in C.score_documents(odd, C.fit(odd, labels)).collect()} == {0.0}


def test_forgets_at_the_bound(monkeypatch, corpus):
    model = C.fit_sample([(t, y) for _, t, y in corpus[:200]])
    texts = [t for _, t, _ in corpus[:120]]
    whole = model.score(texts)
    monkeypatch.setattr(C, "CACHED_WORDS", 40)
    model.reset()
    assert [model.score([t])[0] for t in texts] == pytest.approx(whole)


def test_ascii_words_are_hashed_together_like_one_by_one():
    words = ["a", "Ab", "<x>", "hello", "Q" * C.LONG_WORD, "q_-1", ">", "\x00\x7f"]
    buckets, counts = C.ascii_features(words)
    assert np.split(buckets, np.cumsum(counts)[:-1])[3].tolist() == C.word_features("hello")
    assert buckets.tolist() == [b for w in words for b in C.word_features(w)]
    odds = np.random.default_rng(3).normal(size=C.BUCKETS)
    scorer = C.Scorer(odds, 0.1, 0.5)
    every = [*words, "Été", "İx", "w" * (C.LONG_WORD + 1)]
    scorer.learn(set(every[:4]))
    scorer.learn(set(every[4:]))
    for w in every:
        i, f = scorer.known[w], C.word_features(w)
        assert [t[i] for t in scorer.tables] == [odds[f].sum(), len(f), C.mark(w)]
