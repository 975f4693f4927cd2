"""Operator 5, toxicity: a linear-chain conditional random field tags toxic tokens.

Training (numpy, on a bounded sample of labelled texts): tokens of toxic texts whose words occur mostly in
toxic texts are labelled toxic, all others clean; a two-state chain with hashed word, prefix, suffix and shape
features is fitted to these tokens by AdaGrad on the exact log likelihood (forward-backward).  A logistic
layer, fitted to the document labels, turns the marginals of a text into its score.

Scoring: every token of every whole text gets its marginal by exact forward-backward over the whole text.
Long texts are handled in two levels (transfer matrices of blocks first, then messages from block to block),
so numpy works on all texts of a batch at once.

Defined results: null and empty texts have no tokens, expected count 0 and the score that the logistic layer
gives to that; labels, language, source and doc_id never enter a score; a null doc_id is never learnt from;
repeated rows get equal scores; without any training rows, or with one class only, the score is the share of
toxic labels; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.llm.common import documents, held_out, labelled_sample, map_columns
from leafwise.sources.tables import table

TOKEN = re.compile(r"[^\W_]+|[^\w\s]{3,}")
BUCKETS = 1 << 18
BLOCK = 32
CACHED_WORDS = 500_000
SCHEMA = "doc_id long, score double, n_toxic long, spans array<struct<start:int,end:int,p:double>>"


def features(word: str) -> list[int]:
    w = word.lower()
    shape = "U" if word.isupper() and len(word) > 1 else "C" if word[:1].isupper() else "d" if word[:1].isdigit() else "l"
    names = (f"w={w}", f"p={w[:4]}", f"s={w[-4:]}", f"h={shape}", f"n={min(len(w), 12)}")
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names]


class Chain:
    """Two-state chain: emission score of a word is the sum of its feature weights (state 1 against 0)."""

    def __init__(self, weights: dict[int, float], bias: float, trans: np.ndarray, first: float):
        self.weights, self.bias, self.trans, self.first = weights, bias, trans, first
        self.known: dict[str, float] = {}

    def emission(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        except KeyError:
            if len(known) > CACHED_WORDS:
                known.clear()
            get = self.weights.get
            for w in set(words).difference(known):
                known[w] = self.bias + sum(get(f, 0.0) for f in features(w))
            return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def marginals(self, emission: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """P(state 1) of every token; ``sizes`` are the lengths of the chains, one after another."""
        if not len(emission):
            return np.zeros(0)
        return _marginals(np.clip(emission, -30, 30), sizes, self.trans, self.first)


def _marginals(e: np.ndarray, sizes: np.ndarray, trans: np.ndarray, first: float) -> np.ndarray:
    """Exact forward-backward in probability space, scaled at every step.

    Chains are laid out in blocks of BLOCK tokens (identity steps fill the last block).  Level one multiplies
    each block's matrices, level two passes messages from block to block, level three goes through the blocks
    with known messages at both ends."""
    sizes = sizes[sizes > 0]
    blocks = -(-sizes // BLOCK)
    total = int(blocks.sum())
    first_block = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    token_chain = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(e)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    row, col = first_block[token_chain] + within // BLOCK, within % BLOCK
    psi = np.exp(trans)
    odds = np.zeros((BLOCK, total))
    odds[col, row] = e
    real = np.zeros((BLOCK, total), bool)
    real[col, row] = True
    grow = np.exp(odds / 2)                                      # state 1 gets exp(e/2), state 0 exp(-e/2)
    shrink = 1.0 / grow
    head = np.zeros(total, bool)
    head[first_block] = True

    def step(f0, f1, k):
        """Messages after token k of every block (columns where the token is missing stay)."""
        g0 = (f0 * psi[0, 0] + f1 * psi[1, 0]) * shrink[k]
        g1 = (f0 * psi[0, 1] + f1 * psi[1, 1]) * grow[k]
        if k == 0:                                               # a chain's first token has no step before it
            g0, g1 = np.where(head, f0 * shrink[0], g0), np.where(head, f1 * grow[0], g1)
        g0, g1 = np.where(real[k], g0, f0), np.where(real[k], g1, f1)
        s = g0 + g1
        return g0 / s, g1 / s, s

    long = int(blocks.max())
    start0, start1 = np.full(total, 1.0), np.full(total, float(np.exp(first)))
    end0, end1 = np.ones(total), np.ones(total)
    if long > 1:
        maps = []
        for s0, s1 in ((1.0, 0.0), (0.0, 1.0)):                  # rows of each block's transfer matrix
            f0, f1, log = np.full(total, s0), np.full(total, s1), np.zeros(total)
            for k in range(BLOCK):
                f0, f1, s = step(f0, f1, k)
                log += np.log(s)
            maps.append((f0, f1, log))
        (a0, a1, la), (b0, b1, lb) = maps
        top = np.maximum(la, lb)
        la, lb = np.exp(la - top), np.exp(lb - top)
        m00, m01, m10, m11 = a0 * la, a1 * la, b0 * lb, b1 * lb
        for k in range(1, long):
            at = first_block[blocks > k] + k
            f0 = start0[at - 1] * m00[at - 1] + start1[at - 1] * m10[at - 1]
            f1 = start0[at - 1] * m01[at - 1] + start1[at - 1] * m11[at - 1]
            start0[at], start1[at] = f0 / (f0 + f1), f1 / (f0 + f1)
        last_block = first_block + blocks - 1
        for k in range(1, long):
            at = last_block[blocks > k] - k
            g0 = m00[at + 1] * end0[at + 1] + m01[at + 1] * end1[at + 1]
            g1 = m10[at + 1] * end0[at + 1] + m11[at + 1] * end1[at + 1]
            end0[at], end1[at] = g0 / (g0 + g1), g1 / (g0 + g1)
    forward = np.empty((BLOCK, total, 2))
    f0, f1 = start0, start1
    for k in range(BLOCK):
        f0, f1, _ = step(f0, f1, k)
        forward[k, :, 0], forward[k, :, 1] = f0, f1
    p = np.empty((BLOCK, total))
    g0, g1 = end0, end1
    for k in range(BLOCK - 1, -1, -1):
        x0, x1 = forward[k, :, 0] * g0, forward[k, :, 1] * g1
        p[k] = x1 / (x0 + x1)
        if k:
            h0 = psi[0, 0] * shrink[k] * g0 + psi[0, 1] * grow[k] * g1
            h1 = psi[1, 0] * shrink[k] * g0 + psi[1, 1] * grow[k] * g1
            h0, h1 = np.where(real[k], h0, g0), np.where(real[k], h1, g1)
            g0, g1 = h0 / (h0 + h1), h1 / (h0 + h1)
    return p[col, row]


def toxic_words(sample: list[tuple[str, int]], min_contexts: int = 4) -> set[str]:
    """Words that stand in toxic texts clearly more often than the base share: even 1.5 standard errors below, the
    share lies above the base by 30 % of the way to 1.

    What counts is a word's distinct contexts (the words before and after its first place in a text), at least
    ``min_contexts`` of them: copies of one toxic text count once, so its own words do not pass for toxic."""
    share = sum(y for _, y in sample) / max(1, len(sample))
    counts: Counter = Counter()
    for text, _ in sample:
        counts.update({w.lower() for w in TOKEN.findall(text or "")})
    often = {w for w, n in counts.items() if n >= min_contexts}
    counts.clear()
    contexts: dict[str, dict] = {w: {} for w in often}
    for text, y in sample:
        here = set()
        words = [w.lower() for w in TOKEN.findall(text or "")]
        for i, w in enumerate(words):
            if w in often and w not in here:
                here.add(w)
                around = (words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "")
                contexts[w][around] = max(y, contexts[w].get(around, 0))
    out = set()
    for w, found in contexts.items():
        n = len(found)
        p = (sum(found.values()) + 0.5) / (n + 1)
        if n >= min_contexts and p - 1.5 * np.sqrt(p * (1 - p) / (n + 1)) > share + 0.3 * (1 - share):
            out.add(w)
    return out


def _gradient(emission: np.ndarray, tags: np.ndarray, real: np.ndarray, trans: np.ndarray, first: float):
    """Model minus labels, summed over the padded lines (B x T): unary marginals, pair counts, first tags."""
    lines, steps = emission.shape
    unary = np.stack([np.zeros_like(emission), emission], 2)
    alpha, beta = np.zeros((steps, lines, 2)), np.zeros((steps, lines, 2))
    alpha[0] = unary[:, 0] + np.array([0.0, first])
    for t in range(1, steps):
        new = np.logaddexp(alpha[t - 1][:, 0, None] + trans[0], alpha[t - 1][:, 1, None] + trans[1]) + unary[:, t]
        alpha[t] = np.where(real[:, t, None], new, alpha[t - 1])
    for t in range(steps - 2, -1, -1):
        ahead = beta[t + 1] + unary[:, t + 1]
        new = np.logaddexp(trans[:, 0] + ahead[:, 0, None], trans[:, 1] + ahead[:, 1, None])
        beta[t] = np.where(real[:, t + 1, None], new, beta[t + 1])
    log_z = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
    p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - log_z).T
    pairs = np.zeros((2, 2))
    both = real[:, 1:]
    for a in range(2):
        for b in range(2):
            model = np.exp(alpha[:-1, :, a].T + trans[a, b] + unary[:, 1:, b] + beta[1:, :, b].T - log_z[:, None])
            pairs[a, b] = (np.where(both, model, 0.0) - (both & (tags[:, :-1] == a) & (tags[:, 1:] == b))).sum()
    return np.where(real, p1 - tags, 0.0), pairs, float((p1[:, 0] - tags[:, 0]).sum())


def fit_chain(sample: list[tuple[str, int]], epochs: int = 4, rate: float = 0.3, max_lines: int = 8000,
              line_words: int = 40) -> Chain:
    """AdaGrad on batches of lines of ``line_words`` tokens, ``max_lines`` at most: lines with a toxic token (evenly
    spaced ones, where they are more than half of that), then others, evenly spaced as well."""
    lexicon = toxic_words(sample)
    def cut():
        """(line, tags) of every line, text by text: the sample is read twice rather than held as words."""
        for text, y in sample:
            words = TOKEN.findall(text or "")
            for at in range(0, len(words), line_words):
                line = words[at:at + line_words]
                yield line, [int(bool(y) and w.lower() in lexicon) for w in line]
    toxic, n_clean = [], 0
    for line, tags in cut():
        if any(tags):
            toxic.append((line, tags))
        else:
            n_clean += 1
    most = max_lines // 2
    if len(toxic) > most:
        toxic = [toxic[i * len(toxic) // most] for i in range(most)]
    pace = max(1, n_clean // max(1, max_lines - len(toxic)))
    clean = (row for row in cut() if not any(row[1]))
    lines = toxic + [row for i, row in enumerate(clean) if i % pace == 0]
    rng = np.random.default_rng(7)
    weights, square = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    small, small_square = np.array([-3.0, 0.5, -0.5, -0.5, 0.0, -2.0]), np.full(6, 1e-8)   # bias, trans, first
    known: dict[str, list[int]] = {}
    for _ in range(epochs if lines else 0):
        order = rng.permutation(len(lines))
        for at in range(0, len(order), 128):
            batch = [lines[i] for i in order[at:at + 128]]
            steps = max(len(line) for line, _ in batch)
            real = np.array([[t < len(line) for t in range(steps)] for line, _ in batch])
            tags = np.array([ts + [0] * (steps - len(ts)) for _, ts in batch])
            words = [w for line, _ in batch for w in line]
            for w in words:
                if w not in known:
                    known[w] = features(w)
            feats = np.array([known[w] for w in words])
            emission = np.zeros(real.shape)
            emission[real] = weights[feats].sum(1) + small[0]
            miss, pairs, head = _gradient(emission, tags, real, small[1:5].reshape(2, 2), small[5])
            g = np.bincount(feats.ravel(), np.repeat(miss[real], feats.shape[1]), minlength=BUCKETS) / len(batch)
            square += g * g
            weights -= rate * g / np.sqrt(square)
            gs = np.concatenate([[miss.sum()], pairs.ravel(), [head]]) / len(batch)
            small_square += gs * gs
            small -= 0.2 * rate * gs / np.sqrt(small_square)
    index = {int(i): float(weights[i]) for i in np.nonzero(np.abs(weights) > 1e-6)[0]}
    return Chain(index, float(small[0]), small[1:5].reshape(2, 2).copy(), float(small[5]))


def tag(chain: Chain, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
    """Tokens of each text and their toxic marginals."""
    words = [TOKEN.findall(t) if t else [] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = [w for ws in words for w in ws]
    p = chain.marginals(chain.emission(flat), sizes)
    ends = np.cumsum(sizes)
    return [(ws, p[e - n:e]) for ws, e, n in zip(words, ends, sizes)]


def aggregates(p: np.ndarray) -> tuple[float, float, float]:
    """What the document layer sees: constant, log odds of the surest token, log of the expected count."""
    if not len(p):
        return 1.0, -2.0, 0.0
    top = float(np.clip(p.max(), 1e-9, 1 - 1e-9))
    return 1.0, max(-2.0, float(np.log(top / (1 - top))) / 5), float(np.log1p(p.sum()))


def fit_document_layer(chain: Chain, sample: list[tuple[str, int]], steps: int = 60) -> np.ndarray:
    """Logistic regression of the label on the aggregates, by damped Newton steps with a small ridge."""
    x = np.array([aggregates(p) for _, p in tag(chain, [t for t, _ in sample])]).reshape(-1, 3)
    y = np.array([label for _, label in sample], float)
    w = np.zeros(3)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = 1e-2 * np.eye(3)
        w -= 0.7 * np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge, x.T @ (q - y) + ridge @ w)
    return w


def spans_of(text: str, p: np.ndarray, least: float = 0.5) -> list[dict]:
    """Runs of neighbouring tokens with a marginal of ``least`` or more, with the largest marginal of the run."""
    out, open_at = [], None
    if not len(p) or p.max() < least:
        return out
    for i, m in enumerate(TOKEN.finditer(text)):
        if p[i] >= least:
            if open_at is None:
                out.append({"start": m.start(), "end": m.end(), "p": float(p[i])})
                open_at = i
            else:
                out[-1]["end"], out[-1]["p"] = m.end(), max(out[-1]["p"], float(p[i]))
        else:
            open_at = None
    return out


class Model:
    def __init__(self, chain: Chain | None, layer: np.ndarray | None, share: float):
        self.chain, self.layer, self.share = chain, layer, share

    def score(self, texts: list[str | None]):
        """(score, spans) per text."""
        if self.chain is None:
            return [(self.share, []) for _ in texts]
        out = []
        for text, (_, p) in zip(texts, tag(self.chain, texts)):
            z = float(np.dot(aggregates(p), self.layer))
            out.append((1 / (1 + np.exp(-z)), spans_of(text, p) if text else []))
        return out

    def score_all(self, texts: list[str | None]):
        """``score`` for any number of texts, about a million characters at a time."""
        rows, at = [], 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and (held == 0 or held + len(texts[to] or "") <= 1_000_000):
                held += len(texts[to] or "")
                to += 1
            rows += self.score(texts[at:to])
            at = to
        return rows


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, max_docs: int = 5000,
        max_chars: int = 20_000) -> Model:
    """Learns from at most ``max_docs`` labelled texts of at most ``max_chars`` characters outside the fold."""
    sample = labelled_sample(docs, labels, "toxic", folds, fold, max_docs, max_chars)
    share = sum(y for _, y in sample) / len(sample) if sample else 0.0
    if share in (0.0, 1.0):
        return Model(None, None, share)
    chain = fit_chain(sample)
    layer = fit_document_layer(chain, sample)
    chain.known.clear()
    return Model(chain, layer, share)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Columns doc_id, score, n_toxic, spans (start, end, p) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value

        def step(ids, texts):
            rows = m.score_all(texts)
            return {"doc_id": ids, "score": [r[0] for r in rows], "n_toxic": [len(r[1]) for r in rows],
                    "spans": [r[1] for r in rows]}
        return step
    return map_columns(docs, ["doc_id", "text"], SCHEMA, start)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_toxic")


Q = {"op5_toxicity": op5_toxicity}
SQL: dict[str, str] = {}
