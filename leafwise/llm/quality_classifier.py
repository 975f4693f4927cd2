"""Operator 8, quality classifier: supervised subword embeddings.

A text's features are its words, their character n-grams and its word pairs, each hashed to a learned vector.
The vectors are averaged per document and go through a softmax over two classes; embeddings and output layer
are trained together by numpy stochastic gradient descent on a bounded sample of labelled texts.

Between average and softmax all is linear, so for scoring every bucket becomes one number (its vector's share
of the class-1 log odds); whole texts are scored from those, with a bounded cache of word sums per task.

Defined results: null and empty texts have no features and get the output layer's bias alone; labels, language,
source and doc_id never enter a score; a null doc_id is never learnt from; repeated rows get equal scores;
without training rows, or with one class only, the score is the share of class 1; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.llm.common import documents, held_out, labelled_sample, map_columns
from leafwise.sources.tables import table

BUCKETS = 1 << 18
PRIOR = 20                  # zero features added to every text, so that one-word texts stay near the bias
REPEAT = 0                  # bucket of a word that follows itself
CACHED_WORDS = 400_000
TEXT_CHARS = 1_000_000
LONG_WORD = 1_000           # longer words, and those that are not ASCII, are hashed one by one


def bucket(name: str) -> int:
    return 1 + zlib.crc32(name.encode("utf-8", "surrogatepass")) % (BUCKETS - 1)


def word_features(word: str, low: int = 3, high: int = 4) -> list[int]:
    """Buckets of the word and of the character n-grams of ``<word>``; very long words keep all of theirs."""
    w = f"<{word.lower()}>"
    return [bucket("w" + w)] + [bucket(w[i:i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def ascii_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``word_features`` of ASCII words, one after another, and the number of each word's features: the CRC of every
    n-gram of all words at once, a byte at a time."""
    data = ("<" + "><".join(words) + ">").lower().encode()
    held = np.frombuffer(data, np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    at = np.cumsum(size) - size
    state, grams = np.full(len(held), 0xFFFFFFFF, np.uint32), []
    for k in range(4):                          # those that reach over their word's end are not used
        state = state[:len(held) - k]
        state = _CRC[(state ^ held[k:]) & 0xFF] ^ state >> 8
        if k >= 2:
            grams.append(1 + (~state % np.uint32(BUCKETS - 1)).astype(np.int64))
    ends = (at + size).tolist()
    whole = [1 + zlib.crc32(data[a:b], _WORD) % (BUCKETS - 1) for a, b in zip(at.tolist(), ends)]
    counts = 2 * size - 4                       # the word, size - 2 and size - 3 n-grams
    first = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int64)
    out[first] = whole
    begin = first + 1
    for found, n in zip(grams, (size - 2, size - 3)):
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(begin, n) + step] = found[np.repeat(at, n) + step]
        begin = begin + n
    return out, counts


_WORD = zlib.crc32(b"w")


def pair_buckets(marks: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, from one 64-bit mark per word."""
    a, b = marks[:-1], marks[1:]
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h >> np.uint64(33)) % np.uint64(BUCKETS - 1) + np.uint64(1)
    return np.where(a == b, REPEAT, h.astype(np.int64))


def mark(word: str) -> int:
    w = word.lower().encode("utf-8", "surrogatepass")
    return zlib.crc32(w) << 32 | zlib.crc32(b"#" + w)


def text_features(text: str | None, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    for w in words:
        if w not in known:
            known[w] = (np.array(word_features(w)), mark(w))
    ids = np.concatenate([known[w][0] for w in words] + [pair_buckets(np.array([known[w][1] for w in words], np.uint64))])
    ids, n = np.unique(ids, return_counts=True)
    return ids, n / (n.sum() + PRIOR)


def train(sample: list[tuple[str, int]], dim: int = 8, epochs: int = 8, rate: float = 1.5, seed: int = 11):
    """Embeddings (buckets x dim), output layer (dim x 2) and bias, by one-text SGD steps with falling rate."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2)), np.zeros(2)
    known: dict = {}
    rows = [(*text_features(t, known), y) for t, y in sample]
    known.clear()
    step, steps = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share, y = rows[i]
            lr = rate * (1 - step / steps)
            step += 1
            hidden = share @ vectors[ids] if len(ids) else np.zeros(dim)
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1.0
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= 0.1 * lr * p
            if len(ids):
                vectors[ids] -= np.float32(lr * 10) * np.outer(np.sqrt(share / len(ids)), back).astype(np.float32)
    return vectors, out, bias


class Scorer:
    """Class-1 log odds of whole texts from one number per bucket."""

    def __init__(self, odds: np.ndarray | None, bias: float, share: float):
        self.odds, self.bias, self.share = odds, bias, share
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.tables = (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def learn(self, words: set[str]) -> None:
        plain = [w for w in words if len(w) <= LONG_WORD and w.isascii()]
        others = [w for w in words if len(w) > LONG_WORD or not w.isascii()]
        sums, sizes = [], []
        if plain:
            buckets, counts = ascii_features(plain)
            # A zero before each word's numbers: so their sum is, to the last bit, the one that ndarray.sum gives.
            numbers, nth = np.zeros(len(buckets) + len(plain)), np.arange(len(plain))
            numbers[np.arange(len(buckets)) + np.repeat(nth + 1, counts)] = self.odds[buckets]
            sums.append(np.add.reduceat(numbers, np.cumsum(counts) - counts + nth))
            sizes.append(counts)
        for w in others:
            f = word_features(w)
            sums.append([self.odds[f].sum()])
            sizes.append([len(f)])
        every = plain + others
        self.known.update(zip(every, range(len(self.known), len(self.known) + len(every))))
        new = (np.concatenate(sums), np.concatenate(sizes), np.fromiter(map(mark, every), np.uint64, len(every)))
        self.tables = tuple(np.concatenate(t) for t in zip(self.tables, new))

    def score(self, texts: list[str | None]) -> list[float]:
        if self.odds is None:
            return [self.share] * len(texts)
        split = [t.split() if t else [] for t in texts]
        every = set().union(*split)
        new = every.difference(self.known)
        if len(self.known) + len(new) > CACHED_WORDS:
            self.reset()
            new = every
        if new:
            self.learn(new)
        scores = []
        for words in split:
            if not words:
                scores.append(1 / (1 + float(np.exp(-self.bias))))
                continue
            sums, sizes, marks = self.tables
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            pairs = self.odds[pair_buckets(marks[at])]
            z = (sums[at].sum() + pairs.sum()) / (sizes[at].sum() + len(pairs) + PRIOR) + self.bias
            scores.append(1 / (1 + float(np.exp(-np.clip(z, -30, 30)))))
        return scores


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, max_docs: int = 4000,
        max_chars: int = 20_000) -> Scorer:
    """Learns from at most ``max_docs`` labelled texts of at most ``max_chars`` characters outside the fold."""
    return fit_sample(labelled_sample(docs, labels, "quality", folds, fold, max_docs, max_chars))


def fit_sample(sample: list[tuple[str, int]]) -> Scorer:
    share = sum(y for _, y in sample) / len(sample) if sample else 0.0
    if share in (0.0, 1.0):
        return Scorer(None, 0.0, share)
    vectors, out, bias = train(sample)
    return Scorer((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]), share)


def score_documents(docs: DataFrame, model: Scorer) -> DataFrame:
    """Columns doc_id, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.odds, model.bias, model.share))

    def start():
        scorer = Scorer(*shared.value)

        def step(ids, texts):
            scores, at = [], 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (held == 0 or held + len(texts[to] or "") <= TEXT_CHARS):
                    held += len(texts[to] or "")
                    to += 1
                scores += scorer.score(texts[at:to])
                at = to
            return {"doc_id": ids, "score": scores}
        return step
    return map_columns(docs, ["doc_id", "text"], "doc_id long, score double", start)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


Q = {"op8_quality_classifier": op8_quality_classifier}
SQL: dict[str, str] = {}
