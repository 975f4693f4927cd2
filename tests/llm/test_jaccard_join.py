"""Jaccard join: classes and link counts against brute force over all pairs, hot groups, odd inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwise.llm import jaccard_join as J
from tests.llm.conftest import SF, docs_frame


def plain(rows, threshold=0.8):
    """doc_id -> (class, links), over all pairs of texts."""
    sets = []
    for _, text in rows:
        words = (text or "").split()
        size = min(5, len(words))
        sets.append({tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if words else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            c = len(sets[a] & sets[b])
            if c >= threshold * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[max(top(a), top(b))] = min(top(a), top(b))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(d)
    smallest = {k: None if None in v else min(v) for k, v in groups.items()}
    return [(rows[i][0], smallest[top(i)], links[i]) for i in range(len(rows))]


def joined(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in J.jaccard_join(df).collect()), key=str)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in J.op7_jaccard_join(spark, SF).collect())
    assert got == sorted(plain(rows))


def near_group(rng, n, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(200)] = f"v{rng.randrange(10 ** 6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [16, 512])
def test_groups_at_the_threshold(spark, monkeypatch, block):
    """Near copies on both sides of 0.8, exact copies, and a passage that unlike documents share."""
    monkeypatch.setattr(J, "BLOCK_SETS", block)
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = near_group(rng, 90, 6) + near_group(rng, 20, 3) + ["the same text of a few words"] * 40
    texts += [" ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(100)) + " " + passage for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert joined(docs_frame(spark, rows).repartition(7)) == sorted(plain(rows), key=str)


def test_odd_inputs(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "two words"), (5, "two words"), (5, "two words"), (6, "x " * 50_000), (7, "x " * 60_000),
            (None, "a b c d e f"), (8, "a b c d e f")]
    df = docs_frame(spark, rows).withColumns({"set_id": F.lit(1), "root": F.lit(2), "node": F.lit(3), "sig": F.lit(4)})
    assert joined(df) == sorted(plain(rows), key=str)
    assert J.jaccard_join(df.limit(0)).count() == 0


def test_depth_is_the_longest_that_meets_the_target():
    d = J.trie_depth()
    assert 1 - (1 - 0.8 ** d) ** J.TREES >= J.TARGET_RECALL > 1 - (1 - 0.8 ** (d + 1)) ** J.TREES


def test_pivot_links_span_every_close_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (5, J.POSITIONS), np.uint8)
    rows = base[rng.integers(0, 5, 300)].copy()
    for r in rows:
        at = rng.integers(0, J.POSITIONS, rng.integers(0, 20))
        r[at] = rng.integers(0, 256, len(at))
    links, _ = J.pivots(rows, np.arange(300))
    root = list(range(300))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in links:
        root[top(a)] = top(b)
    assert len(links) <= 299
    for a, b in itertools.combinations(range(300), 2):
        if J.similarity(rows[a:a + 1], rows[b])[0] >= 0.8:
            assert top(a) == top(b)


def test_recall_at_the_threshold_with_the_positions_that_trees_share():
    """Pairs agree at each position with 0.8; the trees' own orders decide whether they meet."""
    rng, depth, met, n = np.random.default_rng(3), J.trie_depth(), 0, 200_000
    for _ in range(10):
        equal = rng.random((n // 10, J.POSITIONS)) < 0.8
        met += int(np.logical_or.reduce([equal[:, J._ORDERS[t, :depth]].all(1) for t in range(J.TREES)]).sum())
    assert met / n >= J.TARGET_RECALL
