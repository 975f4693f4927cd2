"""Operator 7, n-gram Jaccard join: MinHash LSH forest, then exact verification.

1. Every whole text becomes the set of its five-word shingles (64-bit hashes).  Equal sets are one *copy
   class*; all further work is on classes.
2. A class has a signature of 320 min-hash bytes.  Each tree of the forest sorts the signatures by its own
   order of positions; a prefix of that order is a node of the tree's trie.  Matched prefixes are shortened
   from full depth until two sets at the threshold meet in some tree with the target recall (``trie_depth``).
   The first ``OWN`` positions of a tree stand in no other tree, so up to that depth the trees are independent,
   as the recall assumes.  The depth is one for all sets; it follows from the threshold, not from the data.
3. Classes below one node are compared by signature with pivots: a row close to a pivot is linked to it, a row
   very close is also represented by it from then on.  This runs first inside each input partition, so a hot
   group reaches the shuffle as a few pivots, then across partitions.  Links form loose clusters.
4. Within each cluster every pair of sets is verified exactly.  Large clusters are dealt to pairs of blocks of
   bounded size; a task returns link counts and one link to a root per set, never pairs.
5. Verified links form the groups (connected components).

By the triangle inequality of the Jaccard distance a represented row loses no partner: partners of a row
within 0.1 of a pivot are within 0.3 of that pivot, twice that slack across the two rounds, and the pivots
take everything estimated at 0.5 or more.

Defined results: null, empty and blank texts have no shingles, are similar to nothing and form classes of one
row; texts under five words have one shingle, all their words; ties for a group's representative go to the
smallest doc_id (null first), then the smallest text hash; repeated rows are copies of each other; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwise.llm.common import documents, map_columns, saved

WORDS = 5
THRESHOLD = 0.8
TREES = 40
OWN = 8                          # positions of a tree that no other tree has
POSITIONS = TREES * OWN
FULL_DEPTH = 16
TARGET_RECALL = 0.999
NEAR, SAME = 0.5, 0.92           # signature estimates: linked to a pivot, represented by it
BLOCK_SETS, BLOCK_SHINGLES = 512, 2_000_000
CACHED_WORDS = 500_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def trie_depth(threshold: float = THRESHOLD, target: float = TARGET_RECALL, trees: int = TREES,
               full: int = FULL_DEPTH) -> int:
    """Longest matched prefix, shortened from ``full``, at which a pair at the threshold is found with ``target``."""
    depth = full
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < target:
        depth -= 1
    return depth


class _Words(dict):
    """Word -> 64-bit hash; forgets all when it holds too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(text: str | None, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a text."""
    found = text.split() if text else []
    n = len(found)
    if n == 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    size = min(WORDS, n)
    m = n - size + 1
    w = np.zeros(m, np.uint64)
    for k in range(size):
        w = (w ^ h[k:k + m]) * MIX
        w ^= w >> np.uint64(31)
    return np.unique(w)


_RNG = np.random.default_rng(20240607)
_MUL = (_RNG.integers(0, 1 << 32, POSITIONS, np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, POSITIONS, np.uint64).astype(np.uint32)
_ORDERS = np.stack([np.concatenate([own, _RNG.permutation(np.setdiff1d(np.arange(POSITIONS), own))[:FULL_DEPTH - OWN]])
                    for own in _RNG.permutation(POSITIONS).reshape(TREES, OWN)])


def signature(hashes: np.ndarray) -> np.ndarray:
    """One byte per position: hash of the smallest permuted shingle."""
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        part = low[at:at + 4096]
        for k in range(0, POSITIONS, 32):
            least[k:k + 32] = np.minimum(least[k:k + 32],
                                         (part[None, :] * _MUL[k:k + 32, None] + _ADD[k:k + 32, None]).min(1))
    return ((least * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8)


def similarity(signatures: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity, corrected for bytes that are equal by chance."""
    return ((signatures == one).mean(1) - 1 / 256) / (1 - 1 / 256)


def keys_of(signatures: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """64-bit name of each signature's node at ``depth`` in a tree."""
    h = np.full(len(signatures), (tree * 0x632BE59BD9B4E019 + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for c in _ORDERS[tree, :depth]:
        h = (h ^ signatures[:, c].astype(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def pivots(signatures: np.ndarray, label: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links (row, pivot) among the rows of one node, and the rows that stay (represented rows are left out).

    ``label`` numbers the clusters so far and is brought up to date; a link is made only where it joins two
    clusters, so a node of n rows gives n - 1 links at most, however many of its rows resemble each other."""
    links, stay = [], np.ones(len(signatures), bool)
    for p in range(len(signatures)):
        if not stay[p]:
            continue
        rest = np.nonzero(stay[p + 1:])[0] + p + 1
        if not len(rest):
            break
        near = similarity(signatures[rest], signatures[p])
        close = rest[near >= NEAR]
        other, first = np.unique(label[close], return_index=True)
        for old, at in zip(other.tolist(), first.tolist()):
            if old != label[p]:
                links.append((int(close[at]), p))
                label[label == old] = label[p]
        stay[rest[near >= SAME]] = False
    return links, stay


def text_classes(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_hash, set_id (null without words), n_shingles, sig."""
    def start():
        words = _Words()

        def step(ids, texts, marks):
            out = {"doc_id": ids, "text_hash": marks, "set_id": [], "n_shingles": [], "sig": []}
            for t in texts:
                s = shingles(t, words)
                out["n_shingles"].append(len(s))
                out["set_id"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out["sig"].append(signature(s).tobytes() if len(s) else None)
            return out
        return step
    return map_columns(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")),
                       ["doc_id", "text", "text_hash"],
                       "doc_id long, text_hash long, set_id binary, n_shingles long, sig binary", start)


def forest_rows(sets: DataFrame, depth: int) -> DataFrame:
    """Rows (key, set_id, null) of the forest, and links (null, set_id, other) found inside input partitions."""
    def start():
        def step(ids, sigs):
            m = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, POSITIONS)
            keys, left, right = [], [], []
            for tree in range(TREES):
                k = keys_of(m, tree, depth)
                order = np.argsort(k, kind="stable")
                s = k[order]
                stay = np.ones(len(k), bool)
                starts = np.nonzero(np.concatenate([[True], s[1:] != s[:-1]]))[0]
                sizes = np.diff(np.concatenate([starts, [len(s)]]))
                for a, n in zip(starts[sizes > 1], sizes[sizes > 1]):
                    rows = order[a:a + n]
                    links, kept = pivots(m[rows], np.arange(n))
                    stay[rows[~kept]] = False
                    for x, p in links:
                        keys.append(None)
                        left.append(ids[rows[x]])
                        right.append(ids[rows[p]])
                at = np.nonzero(stay)[0]
                keys += k[at].tolist()
                left += [ids[i] for i in at]
                right += [None] * len(at)
            return {"key": keys, "set_id": left, "other": right}
        return step
    return map_columns(sets, ["set_id", "sig"], "key long, set_id binary, other binary", start)


def node_links(rows: DataFrame) -> DataFrame:
    """Links (set_id, other) among rows (key, set_id, sig) that share a key, sorted by key."""
    from pyspark.sql.types import _parse_datatype_string
    target = pa.schema([("set_id", pa.binary()), ("other", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held_ids, held, held_label = None, [], None, None
        for batch in batches:
            ks = np.array(batch.column(0))
            ids = batch.column(1).to_pylist()
            m = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, POSITIONS)
            cuts = np.concatenate([[0], np.nonzero(ks[1:] != ks[:-1])[0] + 1, [len(ks)]])
            left, right = [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                own, sigs, label = ids[a:b], m[a:b], np.arange(b - a)
                if key == ks[a]:                       # the node began in the batch before: its pivots go on
                    own, sigs = held_ids + own, np.concatenate([held, sigs])
                    label = np.concatenate([held_label, label + held_label.max(initial=-1) + 1])
                links, stay = pivots(sigs, label)
                left += [own[x] for x, _ in links]
                right += [own[p] for _, p in links]
                key, held_ids, held, held_label = ks[a], [own[i] for i in np.nonzero(stay)[0]], sigs[stay], label[stay]
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], schema=target)

    return rows.mapInArrow(run, _parse_datatype_string("set_id binary, other binary"))


def spanning(links: DataFrame) -> DataFrame:
    """(a, b): the links of each input partition reduced to one per node, to the smallest node it is connected to in
    that partition.  ``links`` should be a stored table, so that a partition holds a bounded number of bytes."""
    target = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[bytes, bytes] = {}

        def top(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = root.setdefault(up, up)
                x = root[x]
            return x
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = top(x), top(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
        nodes = [x for x in root if top(x) != x]
        for at in range(0, len(nodes), 50_000):
            part = nodes[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([top(x) for x in part], pa.binary())], schema=target)

    return links.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root): every node of an undirected edge list and the smallest node it is connected to.

    Links are first reduced to stars inside stored partitions.  Then smallest labels travel along the edges and
    jump to their label's label, until nothing changes; the number of rounds grows with the logarithm of the
    longest path, and the paths between stars are short."""
    edges = saved(spanning(saved(links.toDF("a", "b").where("a <> b").distinct(), f"{name}-links")).distinct(), f"{name}-edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), name)
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
                .withColumnRenamed("a", "node"))
        moved = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("beyond"))
        new = saved(moved.join(jump, "to", "left").select(
            "node", F.least("to", F.coalesce("beyond", "to")).alias("root"),
            (F.least("to", F.coalesce("beyond", "to")) < F.col("old")).alias("changed")), name)
        labels = new.select("node", "root")
        if new.where("changed").limit(1).count() == 0:
            return labels


def verified(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """members: cluster, block, of (low, high blocks), set_id, copies, hashes.  Every pair of sets of one task
    (cluster, low, high) is compared exactly; returns set_id, links (rows linked by these pairs), root."""
    from pyspark.sql.types import _parse_datatype_string
    target = pa.schema([("set_id", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            for r in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
                if r[:3] != group:
                    if rows:
                        yield _verify(rows, threshold, target)
                    group, rows = r[:3], []
                if not rows or rows[-1][1] != r[4]:    # a repeated row brings its set again
                    rows.append(r[3:])
        if rows:
            yield _verify(rows, threshold, target)

    return members.mapInArrow(run, _parse_datatype_string("set_id binary, links long, root binary"))


def _verify(rows: list, threshold: float, target: pa.Schema) -> pa.RecordBatch:
    """rows: (block, set_id, copies, hashes) of one task; pairs inside one block, or across its two blocks."""
    rows.sort(key=lambda r: (r[0], r[1]))
    n = len(rows)
    block = np.array([r[0] for r in rows])
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    size = np.array([len(s) for s in sets])
    copies = np.array([r[2] for r in rows])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    shared = ~(first & np.concatenate([first[1:], [True]]))       # shingles of one set only cannot be in common
    term = (np.cumsum(first) - 1)[shared]
    owner = owner[shared]
    common = np.zeros((n, n), np.float32)
    if len(term):
        term = np.cumsum(np.concatenate([[0], (term[1:] != term[:-1]).astype(np.int64)]))
        for at in range(0, int(term[-1]) + 1, 8192):
            a, b = np.searchsorted(term, [at, at + 8192])
            dense = np.zeros((n, min(8192, int(term[-1]) + 1 - at)), np.float32)
            dense[owner[a:b], term[a:b] - at] = 1.0
            common += dense @ dense.T
    union = size[:, None] + size[None, :] - common
    linked = common >= threshold * union - 1e-6
    np.fill_diagonal(linked, False)
    if block[0] != block[-1]:
        linked &= block[:, None] != block[None, :]
    links = (linked * copies[None, :]).sum(1)
    root = np.arange(n)
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], n).min(1, initial=n))
        new = new[new]
        if (new == root).all():
            break
        root = new
    ids = [r[1] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(links.astype(np.int64)),
                                       pa.array([ids[i] for i in root], pa.binary())], schema=target)


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """One row per document row: doc_id, text_hash, n_shingles, copy_id (smallest doc_id with the same set),
    class_id (smallest doc_id of the group), kept_text (text hash of that document), n_links (other rows at the
    threshold or above, copies included)."""
    rows = saved(text_classes(docs), "texts")
    first = F.min(F.struct("doc_id", "text_hash")).alias("rep")
    sets = saved(rows.where("set_id is not null").groupBy("set_id").agg(
        F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), first), "sets")
    forest = saved(forest_rows(sets, trie_depth(threshold, target_recall)), "forest")
    met = (forest.where("key is not null").withColumn("n", F.count("*").over(W.partitionBy("key")))
           .where("n > 1").select("key", "set_id").join(sets.select("set_id", "sig"), "set_id")
           .select("key", "set_id", "sig").repartition("key").sortWithinPartitions("key", "set_id"))
    loose = components(forest.where("key is null").select("set_id", "other").unionByName(node_links(met)), "loose")

    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sized = sets.join(loose, F.col("set_id") == F.col("node")).select("root", "set_id", "copies", "n", "rep")
    split = sized.join(sized.groupBy("root").agg(blocks.alias("blocks")), "root").withColumn(
        "block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    # The representatives' texts are read again rather than kept: shingle sets are larger than the texts.
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    wanted = split.select("root", "blocks", "block", "set_id", "copies", F.col("rep.doc_id").alias("rep_id"),
                          F.col("rep.text_hash").alias("rep_text"))
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_text")))

    def start():
        words = _Words()

        def step(roots, blocks, block, ids, copies, texts):
            return {"root": roots, "blocks": blocks, "block": block, "set_id": ids, "copies": copies,
                    "hashes": [shingles(t, words).tobytes() for t in texts]}
        return step
    hashed = map_columns(found, ["root", "blocks", "block", "set_id", "copies", "text"],
                         "root binary, blocks int, block int, set_id binary, copies long, hashes binary", start)
    dealt = (hashed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("root", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"),
                     "block", "set_id", "copies", "hashes")
             .repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "set_id"))
    links = saved(verified(dealt, threshold), "links")
    counts = links.groupBy("set_id").agg(F.sum("links").alias("links"))
    groups = components(links.select("set_id", "root").where("set_id <> root"), "groups")
    member = (sets.join(groups, F.col("set_id") == F.col("node"), "left")
              .withColumn("group", F.coalesce("root", "set_id")).join(counts, "set_id", "left")
              .select("set_id", "group", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    heads = member.groupBy("group").agg(F.min("rep").alias("head"))
    done = member.join(heads, "group").select("set_id", "rep", "head", "n_links")
    alone = F.struct("doc_id", "text_hash")
    return rows.join(done, "set_id", "left").select(
        "doc_id", "text_hash", "n_shingles", F.coalesce("rep", alone)["doc_id"].alias("copy_id"),
        F.coalesce("head", alone)["doc_id"].alias("class_id"),
        F.coalesce("head", alone)["text_hash"].alias("kept_text"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join(documents(spark, sf_dir, "doc_id", "text"))
    return joined.select("doc_id", "class_id", "copy_id", "n_links", "n_shingles")


Q = {"op7_jaccard_join": op7_jaccard_join}
SQL: dict[str, str] = {}
