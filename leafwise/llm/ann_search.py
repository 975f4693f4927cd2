"""Operator 1, approximate nearest neighbours by collision counting.

Vectors are scaled to length one and projected on random lines.  A shard keeps, for every line, its vectors'
projections in sorted order.  A query opens a window around its own projection on every line and counts how
often each vector falls inside; virtual rehashing widens all windows in step with a radius R.  At each radius,
vectors whose collisions reach a threshold are verified by their exact cosine.  The threshold is the lower
tail of the binomial count that a vector at distance R has, so a vector within R is missed with probability
``miss`` at most, and a query stops as soon as its k-th verified vector lies within R.  There is no cap on
candidates; a window that covers everything verifies everything.

Shards have a bounded number of rows.  Shard rows come first in a task, queries stream past them in batches,
and a query's best k of all shards are merged by one window.

Defined results: vectors that are null, empty, all zero or that hold null or non-finite components, and rows
with a null id, take no part; vectors are compared with vectors of the same dimension only; rows with the
query's own id are not its candidates; equal scores go to the smaller id; repeated rows are found as often as
they occur; an empty table gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwise.sources.tables import table

LINES = 64
HALF_WIDTH = 1.35           # half window at radius 1, in units of a projection's standard deviation
FIRST_RADIUS, GROWTH = 0.3, 1.2
SEED = 97
FOUND = "query_id long, vec_id long, score double"


def collision_threshold(lines: int = LINES, half_width: float = HALF_WIDTH, miss: float = 0.02) -> int:
    """Largest count that a vector at distance R reaches with probability 1 - miss when windows have radius R."""
    p = math.erf(half_width / math.sqrt(2))
    below, tail = 0, 0.0
    while below <= lines:
        tail += math.comb(lines, below) * p ** below * (1 - p) ** (lines - below)
        if tail > miss:
            return below
        below += 1
    return lines


class Shard:
    """Sorted projections of one shard's vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: int, miss: float):
        self.ids, self.raw = ids, vectors.astype(np.float64)
        self.norm = np.sqrt((self.raw * self.raw).sum(1))
        self.lines = np.random.default_rng(SEED).standard_normal((lines, vectors.shape[1]))
        at = (self.raw / self.norm[:, None]) @ self.lines.T
        self.order = np.argsort(at, axis=0, kind="stable").T.ravel()       # line after line
        # All lines in one ascending array, each shifted into a range of its own, for one binary search of all.
        self.reach = float(np.abs(at).max()) + 1.0
        self.shift = np.arange(lines) * 3 * self.reach
        self.sorted = (np.sort(at, axis=0).T + self.shift[:, None]).ravel()
        self.need = collision_threshold(lines, miss=miss)

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, float]]:
        """The k nearest found in this shard: (id, cosine), nearest first."""
        q = query.astype(np.float64)
        length = np.sqrt((q * q).sum())
        here = self.lines @ (q / length)
        n = len(self.ids)
        counts = np.zeros(n, np.int64)
        here = np.clip(here, -self.reach, self.reach)
        lo = np.searchsorted(self.sorted, here + self.shift)
        hi = lo.copy()
        score = np.full(n, -np.inf)
        seen = self.ids == query_id                        # the query's own rows are never candidates
        radius, kth = FIRST_RADIUS, -np.inf
        while True:
            whole = radius > 2.0                           # no two unit vectors lie farther apart
            if whole:
                new = np.nonzero(~seen)[0]
            else:
                w = HALF_WIDTH * radius
                left = np.searchsorted(self.sorted, np.maximum(here - w, -self.reach) + self.shift)
                right = np.searchsorted(self.sorted, np.minimum(here + w, self.reach) + self.shift, "right")
                fresh = [self.order[a:b] for a, b in zip(np.concatenate([left, hi]).tolist(), np.concatenate([lo, right]).tolist())
                         if a < b]
                lo, hi = np.minimum(left, lo), np.maximum(right, hi)
                if fresh:
                    counts += np.bincount(np.concatenate(fresh), minlength=n)
                new = np.nonzero((counts >= self.need) & ~seen)[0]
            if len(new):
                seen[new] = True
                score[new] = (self.raw[new] * q).sum(1) / (self.norm[new] * length)
            if whole:
                break
            if len(new):
                found = score[score > -np.inf]
                kth = np.partition(found, len(found) - k)[len(found) - k] if len(found) >= k else -np.inf
            if kth > -np.inf and 2 - 2 * kth <= radius * radius:
                break
            radius *= GROWTH
        hits = np.nonzero(score > -np.inf)[0]
        best = hits[np.lexsort((self.ids[hits], -score[hits]))[:k]]
        return [(int(self.ids[i]), float(score[i])) for i in best]


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding as array<double>, dim) of the rows that take part."""
    v = F.col("embedding")
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
            .where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
            .where(F.exists(v, lambda x: x != 0)).withColumn("dim", F.size(v)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, lines: int = LINES, miss: float = 0.02,
            max_shard_rows: int = 131_072) -> DataFrame:
    """For every query row (as from ``usable``) its k nearest rows of ``vectors``: query_id, rank, vec_id, score."""
    from pyspark.sql.types import _parse_datatype_string
    spark = vectors.sparkSession
    n = vectors.count()
    spread = spark.sparkContext.defaultParallelism
    shards = max(1, math.ceil(n / min(max_shard_rows, max(2048, n // spread))))
    index = vectors.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"),
                           F.lit(0).alias("side"), "vec_id", "embedding")
    asked = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                           F.lit(1).alias("side"), "vec_id", "embedding")
    dealt = (index.unionByName(asked).repartition(shards, "dim", "shard")
             .sortWithinPartitions("dim", "shard", "side", "vec_id"))
    target = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, parts, shard = None, [], [], None
        for batch in batches:
            dim, number, side = (np.array(batch.column(i)) for i in range(3))
            keys = np.stack([dim, number, side], 1)
            cuts = np.concatenate([[0], np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1, [len(keys)]])
            out: tuple[list, list, list] = ([], [], [])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if (dim[a], number[a]) != name:
                    name, ids, parts, shard = (dim[a], number[a]), [], [], None
                rows = np.array(batch.column(4).slice(a, b - a).flatten()).reshape(b - a, -1)
                own = np.array(batch.column(3).slice(a, b - a))
                if side[a] == 0:
                    ids.append(own)
                    parts.append(rows)
                    continue
                if shard is None and ids:
                    shard = Shard(np.concatenate(ids), np.concatenate(parts), lines, miss)
                    ids, parts = [], []
                if shard is not None:
                    for q, v in zip(own.tolist(), rows):
                        for found, score in shard.search(q, v, k):
                            out[0].append(q)
                            out[1].append(found)
                            out[2].append(score)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target)], schema=target)

    found = dealt.select("dim", "shard", "side", "vec_id", "embedding").mapInArrow(run, _parse_datatype_string(FOUND))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


Q = {"op1_ann_search": op1_ann_search}
SQL: dict[str, str] = {}
