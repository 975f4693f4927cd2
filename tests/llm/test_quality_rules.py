"""Quality rules: counts against a plain loop, planted outliers, odd inputs."""

import random
import re

import numpy as np
import pytest

from leafwise.llm import quality_rules as Q
from tests.llm.conftest import DOCS, SF, docs_frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    t = text or ""
    words = WORD.findall(t)
    n = len(words)
    windows = {}
    for i in range(n - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t", "one", "a b c d e f g h " * 3, "a a a a a a a a a", "x y\nx y\n\n x y\n", "é|ñ # $5 <b>\x0b\x0cz w",
         "w " * 4000, "line one\nline two\nline one", " a\u0085b c"]


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    assert Q.text_statistics(text)[:5] == plain(text)


def test_query_against_plain_loop(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.op9_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, *rest = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 20 or 100 * rest[3] > 30 * n)
        assert not (r.base_failed and r.kept)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_outliers_of_a_group_go_and_its_bulk_stays(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, rng.randint(30, 200)), "en", "hot" if i % 3 else f"s{i % 7}", 0) for i in range(600)]
    rows += [(1000 + i, " | ".join(sentence(rng, 40).split()), "en", "hot", 0) for i in range(12)]
    rows += [(2000 + i, " ".join(w + "###" for w in sentence(rng, 40).split()), None, None, 0) for i in range(5)]
    got = {r.doc_id: r.kept for r in Q.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i] for i in range(600)) and not any(got[1000 + i] for i in range(12)) and not any(got[2000 + i] for i in range(5))


def test_odd_inputs(spark):
    df = docs_frame(spark, [*enumerate(TEXTS), (3, "one"), (None, "b " * 30)]).selectExpr("*", "1 as n_words", "2 as mu", "3 as key")
    got = Q.quality_rules(df).collect()
    assert len(got) == len(TEXTS) + 2 and all(not r.kept for r in got if r.n_words < 20)
    assert Q.quality_rules(df.limit(0)).count() == 0


def concentrated(x, mu, prec, support):
    d = np.einsum("ij,jk,ik->i", x - mu, prec, x - mu)
    near = x[d <= np.sort(d)[int(np.ceil(support * len(x))) - 1]]
    cov = np.cov(near.T, bias=True) + np.diag(np.square(Q.SPREAD_FLOOR))
    return near.mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]


def descent(x, mu, prec, support, least=np.inf):
    for _ in range(100):
        mu, prec, det = concentrated(x, mu, prec, support)
        if det >= least - 1e-9:
            return least
        least = det
    return least


def test_models_against_numpy(spark):
    """Two clouds, the smaller one dense and far: medians start between them; the smallest determinant is sought."""
    rng = np.random.default_rng(5)
    p, support = len(Q.FEATURES), 0.6
    clouds = [rng.normal(0, 2.0, (420, p)), rng.normal(5, 0.3, (380, p))]
    x = np.concatenate(clouds)
    rows = [(i, i * 7, "en", "a", 30, 1, 0, 0, 0, *map(float, v)) for i, v in enumerate(x)]
    got = {r.key: r for r in Q.mcd_models(spark.createDataFrame(rows, Q.STATS_SCHEMA), support).collect()}
    one = got["all"]
    assert len(got) == 3 and one.n == len(x)
    mu, prec = np.array(one.mu), np.array(one.prec).reshape(p, p)
    assert abs(one.log_det + np.linalg.slogdet(prec)[1]) < 1e-6
    assert one.log_det - concentrated(x, mu, prec, support)[2] < 2e-3                     # no step lowers it any more
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    floor = np.square(Q.SPREAD_FLOOR)
    assert one.log_det <= descent(x, q[1], np.diag(1 / (((q[2] - q[0]) / 1.349) ** 2 + floor)), support) + 0.02
    others = []
    for _ in range(30):
        part = x[rng.choice(len(x), 50, replace=False)]
        others.append(descent(x, part.mean(0), np.linalg.inv(np.cov(part.T, bias=True) + np.diag(floor)), support))
    assert one.log_det <= min(others) + 0.05


def test_distances_against_numpy(spark):
    rng = random.Random(3)
    texts = docs_frame(spark, [(i, sentence(rng, rng.randint(25, 90))) for i in range(70)])
    model = next(r for r in Q.mcd_models(Q.document_statistics(texts)).collect() if r.key == "all")
    mu, prec = np.array(model.mu), np.array(model.prec).reshape(len(model.mu), -1)
    words = {r.doc_id: np.array(Q.text_statistics(r.text)[5:]) - mu for r in texts.collect()}
    for r in Q.quality_rules(texts, min_group=100).collect():
        z = words[r.doc_id]
        assert abs(r.distance - z @ prec @ z / model.scale) < 1e-6 * max(1, r.distance)
