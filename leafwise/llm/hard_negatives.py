"""Operator 11, hard negatives by anchor spanning-tree bounds.

Components become the integers floor(256 x); a row's score is its inner product with an anchor.  An anchor's
positives are its first rows of the same label by (score descending, id); a positive's negatives are the first rows
of other labels whose score lies in its window, from half to 95 hundredths of the positive's score.

Rows are dealt to shards of bounded size, and all anchors stream past each shard in blocks.  A block's anchors are
joined by a minimum spanning tree.  The root's scores are computed; a child's score of a row lies within (edge
distance) x (norm of the row) of its parent's, so level by level every anchor has a lower and an upper bound for
every row, and only rows whose interval meets what the anchor asks for are scored again: for positives, scores no
worse than the worst of the best found so far; for negatives, the union of the anchor's windows.  Rows scored
again hand exact values down the tree, the others their interval.  Rows outside the interval are proved to be
outside, so results are exact and nothing is capped.  The best of all shards are merged by one window per step.

Arithmetic is exact: products are summed in double where every partial sum fits 53 bits, in 64-bit integers where
it fits 63, in unbounded integers beyond; scores that do not fit a long are held at its ends.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part; only vectors
of one dimension meet; rows with an anchor's own id are neither its positives nor its negatives; an anchor row that
occurs several times gives its rows as often; other repeated rows count as often as they occur; equal scores go to
the smaller id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwise.llm.common import saved
from leafwise.sources.tables import table

SCALE, LABELS, FLIP_EVERY, ANCHOR_EVERY = 256, 10, 7, 50
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95          # a negative's score in hundredths of the positive's
SHARD_ROWS, BLOCK_ANCHORS, TILE_ROWS = 65_536, 512, 4096
LONG = np.iinfo(np.int64)
#: Integer components beyond this keep their sign and are held here, so that they fit a long.
MOST = float(1 << 62)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, vector as array<long>) of the rows that take part, labels flipped."""
    v = F.col("vector")
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(x * F.lit(float(SCALE)), F.lit(-MOST)), F.lit(MOST))).cast("long"))
    label = F.when(F.col("vec_id") % FLIP_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                           F.col("embedding").cast("array<double>").alias("vector"))
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull())
            .where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
            .select("vec_id", label.alias("label"), F.size(v).alias("dim"), whole.alias("vector")))


def inner(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, rows x anchors; float64 or int64 or object, whichever holds them."""
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(anchors).max(initial=0)) * max(1, rows.shape[1])
    if most < 1 << 53:
        return rows.astype(np.float64) @ anchors.astype(np.float64).T
    if most < 1 << 63:
        return rows @ anchors.T
    return rows.astype(object) @ anchors.astype(object).T


def spanning_tree(points: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Minimum spanning tree by Prim's rule: anchors by level from the root 0, parents, edge lengths."""
    n = len(points)
    parent, edge, depth = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    edge[0] = 0.0
    for _ in range(n):
        at = int(np.argmin(np.where(open_, edge, np.inf)))
        open_[at] = False
        depth[at] = depth[parent[at]] + 1 if at else 0
        far = np.sqrt(((points - points[at]) ** 2).sum(1))
        near = open_ & (far < edge)
        edge[near], parent[near] = far[near], at
    return [np.nonzero(depth == d)[0] for d in range(int(depth.max()) + 1)] if n else [], parent, edge


class Block:
    """Anchors of one dimension with their spanning tree; keeps the best rows per anchor and slot."""

    def __init__(self, anchors: np.ndarray):
        self.anchors = anchors
        self.levels, self.parent, self.edge = spanning_tree(anchors.astype(np.float64))
        self.scored = self.pairs = 0

    def levels_of(self, rows: np.ndarray, asked, label: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, rows it scored, their scores) for one tile of rows.  ``asked(anchor, low, high)`` marks the
        rows whose interval meets what the anchor asks for."""
        exact = inner(rows[:1], self.anchors[:1]).dtype
        norm = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
        slack = 1.0 + 1e-9 * norm * np.sqrt((self.anchors.astype(np.float64) ** 2).sum(1).max(initial=0))
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for depth, level in enumerate(self.levels):
            bounds, meets = [], []
            for a in level.tolist():
                if depth == 0:
                    low, high = np.full(len(rows), -np.inf), np.full(len(rows), np.inf)
                else:
                    low, high = kept[int(self.parent[a])]
                    reach = self.edge[a] * norm + slack
                    low, high = low - reach, high + reach
                bounds.append((low, high))
                meets.append(np.ones(len(rows), bool) if depth == 0 else asked(a, low, high))
            some = np.logical_or.reduce(meets)
            picked = np.nonzero(some)[0]
            scores = inner(rows[picked], self.anchors[level]) if len(picked) else np.zeros((0, len(level)), exact)
            self.scored += scores.size
            self.pairs += len(rows) * len(level)
            following = {}
            for k, a in enumerate(level.tolist()):
                low, high = bounds[k]
                low[picked] = high[picked] = scores[:, k].astype(np.float64)
                following[a] = (low, high)
                yield a, picked, scores[:, k]
            kept = following


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k by (score descending, id)."""
    if len(ids) > 4 * k and scores.dtype != object:
        worst = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.nonzero(scores >= worst)[0]
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def positives_of(block: Block, own: np.ndarray, labels: np.ndarray, rows) -> list[list[tuple[int, int]]]:
    """First ``POSITIVES`` rows of each anchor's label in a shard: [(id, score)] per anchor."""
    ids, label, vectors = rows
    found = [(np.zeros(0, np.int64), np.zeros(0, object)) for _ in own]
    for t in range(0, len(ids), TILE_ROWS):
        i, lab = ids[t:t + TILE_ROWS], label[t:t + TILE_ROWS]

        def asked(a, low, high):
            held = found[a][1]
            worst = float(held[-1]) if len(held) == POSITIVES else -np.inf
            return (lab == labels[a]) & (i != own[a]) & (high >= worst)

        for a, picked, scores in block.levels_of(vectors[t:t + TILE_ROWS], asked, lab):
            fits = (lab[picked] == labels[a]) & (i[picked] != own[a])
            if fits.any():
                near, s = i[picked[fits]], scores[fits]
                first = best(near, s, POSITIVES)
                near, s = np.concatenate([found[a][0], near[first]]), np.concatenate([found[a][1], whole(s[first])])
                first = best(near, s, POSITIVES)
                found[a] = near[first], s[first]
    return [list(zip(i.tolist(), s.tolist())) for i, s in found]


def whole(scores: np.ndarray) -> np.ndarray:
    """Scores as Python integers."""
    return np.array([int(s) for s in scores.tolist()], object)


def window(positive: int) -> tuple[int, int]:
    """Least and greatest score that a negative of this positive may have."""
    return -(-LOW * positive // 100), HIGH * positive // 100


def negatives_of(block: Block, own: np.ndarray, labels: np.ndarray, scores: list[list[int]], rows) -> list[list[list[tuple[int, int]]]]:
    """First ``NEGATIVES`` rows of other labels in each positive's window: [(id, score)] per anchor and positive."""
    ids, label, vectors = rows
    spans = [[window(p) for p in ps] for ps in scores]
    least = np.array([min((lo for lo, hi in s if lo <= hi), default=math.inf) for s in spans], float)
    most = np.array([max((hi for lo, hi in s if lo <= hi), default=-math.inf) for s in spans], float)
    found: list[list[list[tuple[int, int]]]] = [[[] for _ in s] for s in spans]
    for t in range(0, len(ids), TILE_ROWS):
        i, lab = ids[t:t + TILE_ROWS], label[t:t + TILE_ROWS]

        def asked(a, low, high):
            return (lab != labels[a]) & (i != own[a]) & (high >= least[a]) & (low <= most[a])

        for a, picked, s in block.levels_of(vectors[t:t + TILE_ROWS], asked, lab):
            fits = (lab[picked] != labels[a]) & (i[picked] != own[a])
            near, s = i[picked[fits]], s[fits]
            for k, (lo, hi) in enumerate(spans[a]):
                inside = np.nonzero((s >= lo) & (s <= hi))[0]
                if len(inside):
                    first = inside[best(near[inside], s[inside], NEGATIVES)]
                    all_ = found[a][k] + list(zip(near[first].tolist(), map(int, s[first].tolist())))
                    found[a][k] = sorted(all_, key=lambda r: (-r[1], r[0]))[:NEGATIVES]
    return found


def held(score: int) -> int:
    return min(max(int(score), LONG.min), LONG.max)


def against_shards(rows: DataFrame, anchors: DataFrame, schema: str, step, count: bool = False) -> DataFrame:
    """Lets all ``anchors`` (anchor_id, anchor_row, label, dim, vector, scores) pass every shard of ``rows`` in
    blocks; ``step(block, ids, labels, scores, shard)`` yields output tuples after (anchor_id, anchor_row)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    spark = rows.sparkSession
    n = rows.count()
    shards = max(1, math.ceil(n / min(SHARD_ROWS, max(2048, n // spark.sparkContext.defaultParallelism))))
    parsed = _parse_datatype_string(schema)
    target = to_arrow_schema(parsed)
    none = F.lit(None).cast("array<long>")
    left = rows.select(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int").alias("shard"), "dim", F.lit(0).alias("side"),
                       F.lit(0).alias("place"), F.col("vec_id").alias("id"), F.lit(0).alias("row"), "label", "vector", none.alias("scores"))
    # Anchors whose first components have the same signs are more likely to be near each other.
    place = F.aggregate(F.transform(F.slice("vector", 1, 12), lambda x: (x < 0).cast("int")), F.lit(0), lambda a, x: 2 * a + x)
    right = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", F.lit(1).alias("side"),
                           place.alias("place"), F.col("anchor_id").alias("id"), F.col("anchor_row").alias("row"), "label", "vector", "scores")
    dealt = left.unionByName(right).repartitionById(shards, "shard").sortWithinPartitions("dim", "side", "place", "id", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, waiting, current = None, [], [], None

        def flush():
            nonlocal waiting
            ids, numbers, labels, vectors, scores = (list(c) for c in zip(*waiting))
            waiting = []
            if shard is None or not len(shard[0]):
                return
            block = Block(np.array(vectors, np.int64).reshape(len(ids), -1))
            out = [(ids[a], numbers[a], *r) for a, r in step(block, np.array(ids), np.array(labels), scores, shard)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

        for batch in batches:
            dims, sides = np.array(batch.column(1)), np.array(batch.column(2))
            cuts = np.concatenate([[0], np.nonzero((dims[1:] != dims[:-1]) | (sides[1:] != sides[:-1]))[0] + 1, [len(dims)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                dim = int(dims[a])
                if dim != current:
                    if waiting:
                        yield from flush()
                    current, shard, parts = dim, None, []
                part = batch.slice(a, b - a)
                vectors = np.array(part.column(7).flatten(), np.int64).reshape(b - a, dim)
                if sides[a] == 0:
                    parts.append((np.array(part.column(4)), np.array(part.column(6)), vectors))
                    continue
                if parts:
                    shard, parts = tuple(np.concatenate(c) for c in zip(*parts)), []
                for row in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), part.column(6).to_pylist(), vectors,
                               part.column(8).to_pylist()):
                    waiting.append(row)
                    if len(waiting) == BLOCK_ANCHORS:
                        yield from flush()
        if waiting:
            yield from flush()

    return dealt.select("shard", "dim", "side", "place", "id", "row", "label", "vector", "scores").mapInArrow(run, parsed)


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``vectors`` as from ``usable``."""
    rows = saved(vectors, "vectors")
    same = W.partitionBy("vec_id").orderBy("dim", "label", "vector")
    anchors = (rows.where(F.col("vec_id") % ANCHOR_EVERY == 0).withColumn("anchor_row", F.row_number().over(same))
               .withColumnRenamed("vec_id", "anchor_id"))

    def near(block, ids, labels, _, shard):
        for a, found in enumerate(positives_of(block, ids, labels, shard)):
            for i, s in found:
                yield a, (i, held(s))

    def hard(block, ids, labels, scores, shard):
        for a, by_positive in enumerate(negatives_of(block, ids, labels, scores, shard)):
            for k, found in enumerate(by_positive):
                for i, s in found:
                    yield a, (k + 1, i, held(s))

    first = W.partitionBy("anchor_id", "anchor_row").orderBy(F.desc("positive_score"), "positive_id")
    positives = saved(
        against_shards(rows, anchors.withColumn("scores", F.lit(None).cast("array<long>")),
                       "anchor_id long, anchor_row int, positive_id long, positive_score long", near)
        .withColumn("place", F.row_number().over(first)).where(F.col("place") <= POSITIVES), "positives")
    asked = positives.groupBy("anchor_id", "anchor_row").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("scores"))
    third = W.partitionBy("anchor_id", "anchor_row", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = (against_shards(rows, anchors.join(asked, ["anchor_id", "anchor_row"]),
                            "anchor_id long, anchor_row int, place int, negative_id long, negative_score long", hard)
             .withColumn("rank", F.row_number().over(third)).where(F.col("rank") <= NEGATIVES))
    return (found.join(positives, ["anchor_id", "anchor_row", "place"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(usable(table(spark, sf_dir, "embeddings")))


Q = {"op11_hard_negatives": op11_hard_negatives}
SQL = {"op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS u
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_inner_product(a.u, b.u) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""}
