"""Hard negatives: tree bounds, exact arithmetic, the operator against a plain loop and against SQL, odd inputs."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwise.llm import hard_negatives as H
from tests.llm.conftest import SF

ROW = "vec_id long, label int, embedding array<double>"


def plain(rows):
    """Expected rows, one list entry per output row, by full comparison with unbounded integers."""
    ok = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows
          if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in ok:
        if i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for j, m, w in ok if j != i and len(w) == len(v))
        for minus, j, _ in [r for r in scored if r[2] == lab][:5]:
            p = -minus
            hard = [(-s, k) for s, k, m in scored if m != lab and 50 * p <= -100 * s <= 95 * p][:3]
            out += [(i, j, n + 1, k, p, s) for n, (s, k) in enumerate(hard)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_tree_spans_and_is_minimal():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    levels, parent, edge = H.spanning_tree(x)
    assert sorted(np.concatenate(levels).tolist()) == list(range(40))
    for d, level in enumerate(levels[1:], 1):
        assert set(parent[level].tolist()) <= set(levels[d - 1].tolist())
    far = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    pairs, group, total = sorted((far[i, j], i, j) for i in range(40) for j in range(i)), list(range(40)), 0.0
    for d, i, j in pairs:                   # Kruskal's rule as the other way to the same weight
        if group[i] != group[j]:
            old, new, total = group[i], group[j], total + d
            group = [new if g == old else g for g in group]
    assert edge.sum() == pytest.approx(total)


def test_bounds_hold_and_prune_near_anchors(monkeypatch):
    monkeypatch.setattr(H, "TILE_ROWS", 64)
    rng = np.random.default_rng(2)
    centre = rng.integers(-200, 200, size=(1, 16))
    anchors = centre + rng.integers(-2, 3, size=(30, 16))
    rows = rng.integers(-200, 200, size=(500, 16))
    block = H.Block(anchors)
    ids, labels = np.arange(500), rng.integers(0, 3, 500)
    positives = [[150_000, 90_000]] * 30
    found = H.negatives_of(block, np.arange(1000, 1030), np.zeros(30, int), positives, (ids, labels, rows))
    exact = rows @ anchors.T
    for a in range(30):
        for k, p in enumerate(positives[a]):
            want = sorted((-int(exact[i, a]), int(i)) for i in ids if labels[i] and 50 * p <= 100 * exact[i, a] <= 95 * p)[:3]
            assert [(-s, i) for i, s in found[a][k]] == want
    assert block.scored < 0.5 * block.pairs


def test_arithmetic_is_exact_at_every_size():
    for most in (1 << 20, 1 << 28, 1 << 40):
        rng = np.random.default_rng(3)
        a, b = rng.integers(-most, most, size=(9, 5)), rng.integers(-most, most, size=(4, 5))
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        assert [[int(x) for x in r] for r in H.inner(a, b)] == want


@pytest.mark.parametrize("shard,anchors,tile", [(65_536, 512, 4096), (150, 4, 32)])
def test_against_a_plain_loop(spark, monkeypatch, shard, anchors, tile):
    monkeypatch.setattr(H, "SHARD_ROWS", shard)
    monkeypatch.setattr(H, "BLOCK_ANCHORS", anchors)
    monkeypatch.setattr(H, "TILE_ROWS", tile)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 8))
    rows = [(int(i), int(rng.integers(0, 4)), (centre[rng.integers(0, 6)] + 0.3 * rng.normal(size=8)).round(2).tolist()) for i in range(-150, 700)]
    rows += [(i, 1, centre[0].tolist()) for i in range(800, 860)]            # ties
    assert got(H.hard_negatives(H.usable(spark.createDataFrame(rows, ROW)))) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 3, [1.0, 0.5]), (0, 3, [1.0, 0.5]), (50, 3, [0.0, 0.0]), (100, 3, [-1.0, 0.2]), (150, 2, []), (151, 2, []), (152, 4, []),
            (200, None, [1.0, 1.0]), (250, 1, None), (300, 1, [nan, 1.0]), (350, 1, [1.0, inf]), (400, 1, [None, 1.0]),
            (None, 3, [1.0, 1.0]), (450, 3, [4e6, 3e6]), (451, 3, [4e6, 2e6]), (452, 5, [3e6, 2e6 + 0.37]), (500, 3, [1.0, 1.0, 1.0])]
    rows += [(i, i % 4, [i / 20 - 1.0, 1.0]) for i in range(1, 40)] + [(5, 3, [0.9, 0.5]), (5, 3, [0.9, 0.5]), (6, 2, [0.6, 0.4]), (6, 2, [0.6, 0.4])]
    df = spark.createDataFrame(rows, ROW).withColumns({"dim": F.lit("x"), "vector": F.lit(1), "scores": F.lit(2), "anchor_id": F.lit(3)})
    assert got(H.hard_negatives(H.usable(df))) == plain(rows)
    assert got(H.hard_negatives(H.usable(df.limit(0)))) == []
    huge = spark.createDataFrame([(0, 1, [1e300]), (1, 1, [1e300]), (2, 2, [5e17]), (3, 1, [-1e300])], ROW)
    assert [r[:4] for r in got(H.hard_negatives(H.usable(huge)))] == []


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    names = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    want = sorted(con.execute(f"SELECT {names} FROM ({H.SQL['op11_hard_negatives']})").fetchall())
    assert len(want) > 50 and got(H.op11_hard_negatives(spark, SF)) == want
