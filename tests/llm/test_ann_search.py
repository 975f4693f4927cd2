"""Nearest neighbours: recall and scores against brute force, ties, unusable vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwise.llm import ann_search as A
from tests.llm.conftest import SF


def brute(ids, x, query, k):
    x = np.asarray(x, float)
    n = np.sqrt((x * x).sum(1))
    q = int(np.nonzero(ids == query)[0][0])
    s = (x * x[q]).sum(1) / (n * n[q])
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != query][:k]
    return [(int(ids[i]), float(s[i])) for i in order]


def test_query_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in A.op1_ann_search(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    queries = [i for i in ids.tolist() if i % 50 == 0]
    hits = 0
    for q in queries:
        found = sorted(got[q])
        want = brute(ids, x, q, 5)
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert [s for _, _, s in found] == sorted((s for _, _, s in found), reverse=True)
        hits += len({v for _, v, _ in found} & {v for v, _ in want})
        exact = dict(brute(ids, x, q, len(ids)))
        assert all(s == pytest.approx(exact[v], abs=1e-12) for _, v, s in found)
    assert hits >= 0.95 * 5 * len(queries)


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(40, 32))
    x = centre[rng.integers(0, 40, 6000)] + 0.7 * rng.normal(size=(6000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    v = A.usable(df)
    rows = A.nearest(v, v.where("vec_id % 50 = 0"), max_shard_rows=1000).collect()
    ids = np.arange(6000)
    hits = sum(len({r.vec_id for r in rows if r.query_id == q} & {i for i, _ in brute(ids, x, q, 5)}) for q in range(0, 6000, 50))
    assert hits >= 0.95 * 5 * 120


def test_ties_unusable_rows_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [4.0, 0.0]), (1, [1.0, 0.0]), (9, [0.0, 0.0]), (10, None), (11, []), (12, [1.0, None]),
            (13, [nan, 1.0]), (14, [inf, 1.0]), (None, [1.0, 0.0]), (15, [1.0, 0.0, 0.0]), (50, [1.0, 1.0]), (100, [0.0, 0.0]),
            (150, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rank": F.lit(1), "dim": F.lit(7)})
    v = A.usable(df)
    got = {}
    for r in A.nearest(v, v.where("vec_id % 50 = 0"), k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 6)))
    assert got == {0: [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)], 50: [(1, 0, 0.707107), (2, 1, 0.707107), (3, 2, 0.707107)],
                   150: [(1, 15, round(1 / 14 ** 0.5, 6))]}
    assert A.nearest(v.limit(0), v.limit(0)).count() == 0


def test_threshold_is_the_lower_tail():
    import math
    p = math.erf(A.HALF_WIDTH / math.sqrt(2))
    need = A.collision_threshold(64, miss=0.02)
    below = sum(math.comb(64, i) * p ** i * (1 - p) ** (64 - i) for i in range(need))
    assert below <= 0.02 < below + math.comb(64, need) * p ** need * (1 - p) ** (64 - need)
