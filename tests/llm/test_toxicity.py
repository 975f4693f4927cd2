"""Toxicity: marginals against enumeration, gradient against differences, held-out accuracy, odd inputs."""

import itertools
import random

import numpy as np
import pytest

from leafwise.llm import toxicity as T
from tests.llm.conftest import docs_frame

TRANS = np.array([[0.4, -0.7], [-0.2, 0.9]])


def enumerate_marginals(e, trans, first):
    total, p = 0.0, np.zeros(len(e))
    for tags in itertools.product([0, 1], repeat=len(e)):
        w = np.exp(first * tags[0] + sum(x for x, t in zip(e, tags) if t) + sum(trans[a, b] for a, b in zip(tags, tags[1:])))
        total += w
        p += w * np.array(tags)
    return p / total


@pytest.mark.parametrize("block", [2, 3, 32])
def test_marginals(monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK", block)
    rng = np.random.default_rng(1)
    sizes = np.array([1, 7, 0, 4, 10])
    e = rng.normal(size=sizes.sum()) * 2
    got = T._marginals(e, sizes, TRANS, -0.8)
    at = 0
    for n in sizes[sizes > 0]:
        assert got[at:at + n] == pytest.approx(enumerate_marginals(e[at:at + n], TRANS, -0.8))
        at += n


def test_gradient_matches_differences_of_the_likelihood():
    rng = np.random.default_rng(2)
    real = np.array([[True] * 4, [True] * 2 + [False] * 2])
    e, tags = np.where(real, rng.normal(size=(2, 4)), 0.0), np.array([[0, 1, 1, 0], [1, 0, 0, 0]])

    def loss(e, trans, first):
        out = 0.0
        for row, t, r in zip(e, tags, real):
            row, t = row[r], t[r]
            score = lambda s: first * s[0] + sum(x for x, y in zip(row, s) if y) + sum(trans[a, b] for a, b in zip(s, s[1:]))
            out += np.log(sum(np.exp(score(s)) for s in itertools.product([0, 1], repeat=len(row)))) - score(t)
        return out
    miss, pairs, head = T._gradient(e, tags, real, TRANS, -0.3)
    step = 1e-5
    for i, j in zip(*np.nonzero(real)):
        d = np.zeros_like(e)
        d[i, j] = step
        assert miss[i, j] == pytest.approx((loss(e + d, TRANS, -0.3) - loss(e - d, TRANS, -0.3)) / 2 / step, abs=1e-6)
    for a, b in itertools.product([0, 1], repeat=2):
        d = np.zeros((2, 2))
        d[a, b] = step
        assert pairs[a, b] == pytest.approx((loss(e, TRANS + d, -0.3) - loss(e, TRANS - d, -0.3)) / 2 / step, abs=1e-6)
    assert head == pytest.approx((loss(e, TRANS, -0.3 + step) - loss(e, TRANS, -0.3 - step)) / 2 / step, abs=1e-6)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(1200):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randrange(len(text)), rng.choice(["vilescum", "grossoaf", "meanbrute"]))
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_held_out_accuracy_and_spans(spark, corpus):
    docs = docs_frame(spark, [(i, t) for i, t, _ in corpus])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in corpus] + [(3, 1, None), (None, 1, 1), (0, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in T.score_documents(docs, T.fit(docs, labels)).collect()}
    import zlib
    held = [(i, t, y) for i, t, y in corpus if zlib.crc32(str(i).encode()) % 3 == 1]
    wrong = [i for i, _, y in held if (rows[i].score >= 0.7) != bool(y)]
    assert len(held) > 300 and len(wrong) <= 0.02 * len(held)
    for i, t, y in held:
        if y and rows[i].score >= 0.7:
            assert {w for s in rows[i].spans for w in t[s.start:s.end].split()} <= {"vilescum", "grossoaf", "meanbrute"}


def test_odd_inputs(spark, corpus):
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in corpus], "doc_id long, quality int, toxic int")
    model = T.fit(docs_frame(spark, [(i, t) for i, t, _ in corpus]), labels)
    odd = docs_frame(spark, [(1, None), (2, ""), (3, "!"), (4, "vilescum " * 30_000), (4, "ha"), (4, "ha"), (None, "ha")])
    odd = odd.selectExpr("*", "1 as score", "2 as spans")
    rows = T.score_documents(odd, model).collect()
    score = {r.doc_id: r.score for r in rows}
    assert len(rows) == 7 and score[1] == score[2] == score[3] < 0.7 and max(r.score for r in rows) > 0.7
    assert all(0 <= r.score <= 1 for r in rows)
    assert T.score_documents(odd.limit(0), model).count() == 0
    none = T.fit(odd, labels.limit(0))
    assert [r.score for r in T.score_documents(odd, none).collect()] == [0.0] * 7


def test_sample_is_the_same_in_every_run(spark):
    """Several texts under one id: the one with the smallest hash, however the rows are dealt."""
    from leafwise.llm.common import labelled_sample
    rows = [(i % 40, f"text {i} of many") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(40)], "doc_id long, toxic boolean")
    got = [labelled_sample(docs_frame(spark, some).repartition(n), labels, "toxic", 3, 1, 30, 100)
           for some, n in ((rows, 1), (rows[::-1], 7), (rows[::2] + rows[1::2], 3))]
    assert got[0] == got[1] == got[2] and len(got[0]) > 10
