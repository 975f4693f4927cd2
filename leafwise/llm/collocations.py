"""Operator 12, phrase collocations by weighted acyclic automata.

A count transducer accepts n-grams of one to three words and gives each its count.  It is acyclic and
deterministic: arcs carry words, a state is a prefix, and a state of the last level is nothing but its weight.
States stand in sorted arrays, one level per word; a state's arcs are one run of the next level.

1. Every task cuts its texts into shards of bounded size, sorts a shard's n-grams and builds, per language and
   prefix range, a transducer from the sorted n-grams, level by level.
2. Transducers are dealt by prefix range (ranges of sorted one- and two-word prefixes).  A range unites what it gets:
   weights of equal n-grams are summed.  Then n-grams under ``min_count`` go; what is left is stored.
3. Parts of phrases lie in other ranges.  A range sends each other range one transducer of the parts that it
   needs, weighted with the largest count of a longer candidate that they lie in; the owner composes it with its
   own counts and sends the result back.  The weights also tell the owner which of its own two-word phrases
   are covered by a longer one.  A part is asked for once per range however many phrases contain it.
4. Ranges score their phrases with unbounded integers; the best of a language are merged in two steps.

The boundaries of the ranges are quantiles of the prefixes in a bounded sample of texts (``sample_docs`` texts of at
most ``sample_chars`` characters, picked by a hash).  They balance the tasks and change no result.

Defined results: null texts are empty, a null language is ``und`` (and one with that name); repeated rows count as
often as they occur; ties go to the smaller phrase in UTF-8 byte order; languages without candidates have no row; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwise.llm.common import documents, saved

MIN_COUNT, TOP = 10, 2000
SCORE_SCALE, COVER = 1_000_000, 50      # COVER: hundredths of a phrase's count that a longer one must reach
SHARD_BYTES = 16 << 20
UNITE_STATES = 2_000_000                # states that wait, at least, before a range unites them
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 20_000
MERGE_GROUPS = 64
KINDS, KIND_LIMITS = ["<u1", "<u2", "<u4", "<i8"], [1 << 8, 1 << 16, 1 << 32]      # of stored numbers
#: Lower-cases A-Z; piece ends become line feeds, the tab a space.
FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 9 + b" ")
FRAGMENT = "range int, side int, lang string, sender int, data binary, words long"
SCORED = "range int, lang string, phrase string, a long, l long, r long, score long"


def distinct(keys: np.ndarray, weights: np.ndarray, how=np.add) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys; weights of equal keys are summed (or reduced by ``how``)."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    starts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1])
    return keys[starts], how.reduceat(weights, starts)


def positions(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key stands among sorted keys, -1 if it does not."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Transducer:
    """words: sorted words (large_binary array).  Level k has, per state, the state it continues (``parent``, below
    level 1), the word of the arc into it (``label``, ascending within a parent) and the weight of its n-gram; 0 is a
    state that only leads on."""

    def __init__(self, words: pa.Array, parent: list[np.ndarray], label: list[np.ndarray], weight: list[np.ndarray]):
        self.words, self.parent, self.label, self.weight = words, parent, label, weight

    @classmethod
    def empty(cls) -> "Transducer":
        none = [np.zeros(0, np.int64)] * 3
        return cls(pa.array([], pa.large_binary()), none, none, none)

    @property
    def states(self) -> int:
        return sum(map(len, self.label))

    def keys(self, level: int) -> np.ndarray:
        """States of a level as numbers that sort like their n-grams: (parent, label)."""
        return self.parent[level] * len(self.words) + self.label[level]

    @classmethod
    def build(cls, words: pa.Array, grams: list[tuple[list[np.ndarray], np.ndarray]], how=np.add) -> "Transducer":
        """From n-grams per length: columns of word numbers (``words`` sorted) and weights; they need not be distinct,
        and a prefix that is not among them becomes a state of weight 0."""
        n = max(1, len(words))
        parent, label, weight = [], [], []
        states = [np.zeros(len(c[0]), np.int64) for c, _ in grams]       # state that each n-gram has reached so far
        for k in range(3):
            if k >= len(grams):
                for column in (parent, label, weight):
                    column.append(np.zeros(0, np.int64))
                continue
            arcs = [s * n + c[k] for s, (c, _) in zip(states[k:], grams[k:])]
            ends = [grams[k][1]] + [np.zeros(len(a), np.int64) for a in arcs[1:]]
            keys, weights = distinct(np.concatenate(arcs), np.concatenate(ends), how)
            parent.append(keys // n)
            label.append(keys % n)
            weight.append(weights)
            for j, a in enumerate(arcs, k):
                states[j] = np.searchsorted(keys, a)
        return cls(words, parent, label, weight)

    def grams(self, level: int) -> list[np.ndarray]:
        """Word numbers of every state of a level, one column per word."""
        columns, at = [], np.arange(len(self.label[level]))
        for k in range(level, -1, -1):
            columns.append(self.label[k][at])
            at = self.parent[k][at]
        return columns[::-1]

    def least(self, count: int) -> "Transducer":
        """Only the n-grams of at least this weight (and what leads to them)."""
        grams = []
        for k in range(3):
            some = self.weight[k] >= count
            grams.append(([c[some] for c in self.grams(k)], self.weight[k][some]))
        return self.of(self.words, grams)

    @classmethod
    def of(cls, words: pa.Array, grams: list[tuple[list[np.ndarray], np.ndarray]], how=np.add,
           number: np.ndarray | None = None) -> "Transducer":
        """As ``build``, keeping only words that occur; ``number`` is working space, one long per word."""
        used = np.unique(np.concatenate([c for columns, _ in grams for c in columns]))
        number = np.zeros(len(words), np.int64) if number is None else number
        number[used] = np.arange(len(used))
        return cls.build(words.take(pa.array(used)), [([number[c] for c in columns], w) for columns, w in grams], how)

    @classmethod
    def union(cls, parts: list["Transducer"], how=np.add) -> "Transducer":
        """Accepts what any part accepts; weights are summed (or reduced by ``how``)."""
        if len(parts) == 1:
            return parts[0]
        words, number = sorted_words(pa.concat_arrays([p.words for p in parts]))
        first = np.concatenate([[0], np.cumsum([len(p.words) for p in parts])])
        grams = []
        for k in range(3):
            columns = [p.grams(k) for p in parts]
            some = [p.weight[k] > 0 for p in parts]
            grams.append(([np.concatenate([number[a + c[j][s]] for a, c, s in zip(first, columns, some)]) for j in range(k + 1)],
                          np.concatenate([p.weight[k][s] for p, s in zip(parts, some)])))
        return cls.build(words, grams, how)

    def compose(self, asked: "Transducer") -> list[np.ndarray]:
        """For every state of ``asked`` the state of this transducer that its n-gram ends in, -1 if there is none."""
        number = pc.index_in(asked.words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        n, out, at = len(self.words), [], None
        for k in range(3):
            label = number[asked.label[k]]
            before = at[asked.parent[k]] if k else np.zeros(len(label), np.int64)
            at = np.where((label >= 0) & (before >= 0), positions(self.keys(k), before * n + label), -1)
            out.append(at)
        return out

    def text(self, columns: list[np.ndarray]) -> list[str]:
        """n-grams with spaces between their words."""
        spelt = [w.decode() for w in self.words.to_pylist()]
        return [" ".join(map(spelt.__getitem__, g)) for g in zip(*[c.tolist() for c in columns])]

    def to_bytes(self) -> bytes:
        """Sizes, then per level how many arcs each parent has, labels and weights, then the words."""
        n = [len(self.words), *map(len, self.label)]
        lengths = pc.binary_length(self.words).to_numpy(zero_copy_only=False)
        arcs = [np.bincount(self.parent[k], minlength=n[k]) for k in (1, 2)]
        arrays = [lengths, *arcs, *self.label, *self.weight]
        kinds = [int(np.searchsorted(KIND_LIMITS, a.max(initial=0), "right")) for a in arrays]
        head = np.array([*n, *[len(a) for a in arrays], *kinds], "<i8")
        return b"".join([head.tobytes(), *[a.astype(KINDS[k]).tobytes() for a, k in zip(arrays, kinds)], *self.words.to_pylist()])

    @classmethod
    def from_bytes(cls, data: bytes) -> "Transducer":
        head = np.frombuffer(data, "<i8", 4 + 18).tolist()
        at, arrays = 22 * 8, []
        for size, kind in zip(head[4:13], head[13:22]):
            arrays.append(np.frombuffer(data, KINDS[kind], size, at).astype(np.int64))
            at += size * np.dtype(KINDS[kind]).itemsize
        offsets = np.concatenate([[0], np.cumsum(arrays[0])]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), head[0], [None, pa.py_buffer(offsets), pa.py_buffer(data[at:])])
        parent = [np.zeros(len(arrays[3]), np.int64), *[np.repeat(np.arange(len(a)), a) for a in arrays[1:3]]]
        return cls(words, parent, arrays[3:6], arrays[6:9])


def sorted_words(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Sorted distinct words, and the number of every given word among them."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False)]


def shard(texts: list[bytes]) -> Transducer:
    """Counts of all n-grams of these texts."""
    data = np.frombuffer(b"\n".join(texts).translate(FOLD), np.uint8)
    line = data == 10
    gap = line | (data == 32)
    edges = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    begin, end = np.nonzero(edges == -1)[0], np.nonzero(edges == 1)[0]
    if not len(begin):
        return Transducer.empty()
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    words, number = sorted_words(pa.Array.from_buffers(pa.large_binary(), len(begin),
                                                       [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap])]))
    piece = np.cumsum(line)[begin]
    two = piece[1:] == piece[:-1]
    three = two[1:] & two[:-1]
    n = len(words)
    # n-grams are sorted and counted as numbers before they become states.
    pair, pairs = np.unique((number[:-1] * n + number[1:])[two], return_counts=True)
    place = np.zeros(len(number), np.int64)
    place[:-1][two] = np.searchsorted(pair, (number[:-1] * n + number[1:])[two])
    triple, triples = np.unique((place[:-2] * n + number[2:])[three], return_counts=True)
    head = triple // n
    return Transducer(words, [np.zeros(n, np.int64), pair // n, head], [np.arange(n), pair % n, triple % n],
                      [np.bincount(number, minlength=n), pairs, triples])


def splitters(docs: DataFrame, ranges: int, sample_docs: int, sample_chars: int) -> list[tuple[bytes, bytes]]:
    """Boundaries of the prefix ranges: quantiles of the distinct n-grams of the sample by their first two words.

    A hash picks about ``sample_docs`` of all texts, wherever they are stored, so only these are sent."""
    every = docs.count()
    if not every:
        return []
    picked = F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) < sample_docs
    rows = (docs.where(F.length("text").between(1, sample_chars) & picked).select("text").limit(2 * sample_docs).collect())
    found = shard([r.text.encode() for r in rows])
    heads = found.grams(1)
    per = np.bincount(found.parent[2], minlength=len(heads[0])) + 1          # states at and below each two-word prefix
    total = np.cumsum(per)
    if not len(total):
        return []
    at = np.unique(np.searchsorted(total, np.arange(1, ranges) * total[-1] / ranges))
    words = found.words.to_pylist()
    return [(words[heads[0][i]], words[heads[1][i]]) for i in at.tolist()]


def cuts(t: Transducer, bounds: list[tuple[bytes, bytes]]) -> list[np.ndarray]:
    """Per level, where in the sorted states each range begins; a three-word state goes with its first two words."""
    words = t.words.to_pylist()
    out: list[list[int]] = [[0], [0], [0]]
    keys = t.keys(1)
    for one, two in bounds:
        i = bisect_left(words, one)
        there = i < len(words) and words[i] == one
        at = int(np.searchsorted(keys, i * len(words) + (bisect_left(words, two) if there else 0)))
        out[0].append(i + there if two else i)
        out[1].append(at)
        out[2].append(int(np.searchsorted(t.parent[2], at)))
    return [np.array([*o, len(lab)]) for o, lab in zip(out, t.label)]


def by_range(t: Transducer, bounds: list[tuple[bytes, bytes]], how=np.add) -> Iterator[tuple[int, Transducer]]:
    """The transducer of every prefix range that has n-grams.  Level 1 of ``t`` holds every word once."""
    grams = [(t.grams(k), t.weight[k]) for k in range(3)]
    edges, number = cuts(t, bounds), np.zeros(len(t.words), np.int64)
    for r in range(len(bounds) + 1):
        part = []
        for (columns, w), e in zip(grams, edges):
            some = np.nonzero(w[e[r]:e[r + 1]] > 0)[0] + e[r]
            part.append(([c[some] for c in columns], w[some]))
        if any(len(w) for _, w in part):
            yield r, Transducer.of(t.words, part, how, number)


def with_all_words(t: Transducer) -> Transducer:
    """The same transducer with a state of level 1 for every word, as ``cuts`` expects."""
    every = ([np.arange(len(t.words))], np.zeros(len(t.words), np.int64))
    grams = [(t.grams(k), t.weight[k]) for k in range(3)]
    first = ([np.concatenate([grams[0][0][0], every[0][0]])], np.concatenate([grams[0][1], every[1]]))
    return Transducer.build(t.words, [first, *grams[1:]], np.maximum)


def emit(rows: list[tuple], target: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)
        rows.clear()


def schemas(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    schema = _parse_datatype_string(ddl)
    return schema, to_arrow_schema(schema)


def fragments(docs: DataFrame, bounds: list[tuple[bytes, bytes]], shard_bytes: int) -> DataFrame:
    """One row per shard, language and prefix range: the transducer of its n-grams."""
    schema, target = schemas(FRAGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        size = 0

        def flush():
            for lang in sorted(waiting):
                found = shard(waiting[lang])
                for r, t in by_range(found, bounds):
                    yield from emit([(r, 0, lang, -1, t.to_bytes(), int(t.weight[0].sum()))], target)
            waiting.clear()

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for lang, text in zip(batch.column(0).to_pylist(), texts.to_pylist()):
                if size and size + len(text) > shard_bytes:
                    yield from flush()
                    size = 0
                waiting.setdefault(lang, []).append(text)
                size += len(text) + 1
        yield from flush()

    return docs.mapInArrow(run, schema)


def united(rows: DataFrame, ranges: int, min_count: int) -> DataFrame:
    """One row per prefix range and language: the transducer of n-grams of at least ``min_count``; words: all words."""
    schema, target = schemas(FRAGMENT)
    dealt = rows.repartitionById(ranges, "range").sortWithinPartitions("range", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, waiting, words = None, [], 0, 0

        def done():
            if key is not None:
                yield from emit([(key[0], 0, key[1], -1, Transducer.union(parts).least(min_count).to_bytes(), words)], target)

        for batch in batches:
            for i in range(batch.num_rows):
                r, lang, n = batch.column(0)[i].as_py(), batch.column(2)[i].as_py(), batch.column(5)[i].as_py()
                t = Transducer.from_bytes(batch.column(4)[i].as_py())
                if (r, lang) != key:
                    yield from done()
                    key, parts, waiting, words = (r, lang), [], 0, 0
                parts.append(t)
                words += n
                waiting += t.states
                if waiting > max(UNITE_STATES, parts[0].states):
                    parts, waiting = [Transducer.union(parts)], 0
        yield from done()

    return dealt.mapInArrow(run, schema)


def parts_of(t: Transducer) -> Transducer:
    """All parts of the phrases that ``t`` accepts, weighted with the largest count of a phrase of three words that they
    lie in (1 at least).  Only phrases of two and three words are phrases."""
    two, three = t.grams(1), t.grams(2)
    some2, some3 = t.weight[1] > 0, t.weight[2] > 0
    (a, b), (x, y, z) = [c[some2] for c in two], [c[some3] for c in three]
    w, one = t.weight[2][some3], np.ones(int(some2.sum()), np.int64)
    ones = np.concatenate([a, b, x, z])
    return Transducer.of(t.words, [([ones], np.ones(len(ones), np.int64)),
                                   ([np.concatenate([x, y, a[:0]]), np.concatenate([y, z, b[:0]])], np.concatenate([w, w, one[:0]])),
                                   ([a[:0]] * 3, one[:0])], np.maximum)


def asked(counts: DataFrame, bounds: list[tuple[bytes, bytes]]) -> DataFrame:
    """One row per range that asks, language and range that is asked."""
    schema, target = schemas(FRAGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = with_all_words(parts_of(Transducer.from_bytes(row["data"])))
                for r, t in by_range(parts, bounds, np.maximum):
                    yield from emit([(r, 1, row["lang"], row["range"], t.to_bytes(), 0)], target)

    return counts.mapInArrow(run, schema)


def answered(counts: DataFrame, requests: DataFrame, ranges: int) -> DataFrame:
    """Requests composed with the counts of the range that owns the parts: side 1 goes back to the sender, side 2 has the
    owner's two-word phrases with the largest count of a longer candidate."""
    schema, target = schemas(FRAGMENT)
    dealt = (counts.unionByName(requests).repartitionById(ranges, "range")
             .sortWithinPartitions("range", "lang", "side", "sender"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, longer = None, None, None

        def done():
            if own is not None and longer.any():
                covers = Transducer.of(own.words, [([np.zeros(0, np.int64)], np.zeros(0, np.int64)),
                                                   ([c[longer > 0] for c in own.grams(1)], longer[longer > 0])], np.maximum)
                yield from emit([(key[0], 2, key[1], -1, covers.to_bytes(), 0)], target)

        for batch in batches:
            for row in batch.to_pylist():
                t = Transducer.from_bytes(row["data"])
                if (row["range"], row["lang"]) != key:
                    yield from done()
                    key, own, longer = (row["range"], row["lang"]), None, None
                if row["side"] == 0:
                    own, longer = t, np.zeros(len(t.label[1]), np.int64)
                    continue
                at = own.compose(t)          # a part occurs as often as its phrase at least, so it is there
                there = (t.weight[1] > 0) & (at[1] >= 0)
                np.maximum.at(longer, at[1][there], t.weight[1][there])
                counts = [np.where(w > 0, own.weight[k][np.maximum(at[k], 0)] if len(own.weight[k]) else 0, 0)
                          for k, w in enumerate(t.weight)]
                back = Transducer(t.words, t.parent, t.label, counts)
                yield from emit([(row["sender"], 1, row["lang"], row["range"], back.to_bytes(), 0)], target)
        yield from done()

    return dealt.mapInArrow(run, schema)


def score(a: int, parts: list[tuple[int, int]]) -> tuple[int, int, int]:
    """(score, l, r) of the cut that scores lowest, the first of equal ones."""
    scored = [(SCORE_SCALE * a * a // (l * r), l, r) for l, r in parts]
    return min(scored, key=lambda s: s[0])


def scored(counts: DataFrame, answers: DataFrame, ranges: int, min_count: int, top: int) -> DataFrame:
    """Every range's best ``top`` phrases per language."""
    schema, target = schemas(SCORED)
    dealt = (counts.unionByName(answers).repartitionById(ranges, "range")
             .sortWithinPartitions("range", "lang", "side", "sender"))

    def phrases(key, own: Transducer, parts: list[Transducer], longer: list[Transducer]):
        known = Transducer.union(parts) if parts else Transducer.empty()
        spelt = own.words.to_pylist()

        def count_of(columns: list[np.ndarray]) -> list[int]:
            level = len(columns) - 1
            grams = [([np.zeros(0, np.int64)] * (k + 1), np.zeros(0, np.int64)) for k in range(level)]
            one = np.ones(len(columns[0]), np.int64)
            want = Transducer.build(own.words, [*grams, (columns, one)], np.maximum)
            at = known.compose(want)[level]
            numbers = known.weight[level][np.maximum(at, 0)] if len(known.weight[level]) else np.zeros(len(at), np.int64)
            # ``want`` is sorted; back to the order of the phrases.
            n, states = len(own.words), np.zeros(len(one), np.int64)
            for k, c in enumerate(columns):
                states = np.searchsorted(want.keys(k), states * n + c)
            return numbers[states].tolist()

        out = []
        some = own.weight[1] > 0
        if longer:
            for cover in longer:
                at = own.compose(cover)[1]
                real = (cover.weight[1] > 0) & (at >= 0)
                hit = at[real]
                some[hit[100 * cover.weight[1][real] >= COVER * own.weight[1][hit]]] = False
        x, y = [c[some] for c in own.grams(1)]
        l, r = count_of([x]), count_of([y])
        for i, a in enumerate(own.weight[1][some].tolist()):
            out.append((*score(a, [(l[i], r[i])]), a, b" ".join([spelt[x[i]], spelt[y[i]]])))
        some = own.weight[2] > 0
        x, y, z = [c[some] for c in own.grams(2)]
        l1, r1, l2, r2 = count_of([x]), count_of([y, z]), count_of([x, y]), count_of([z])
        for i, a in enumerate(own.weight[2][some].tolist()):
            out.append((*score(a, [(l1[i], r1[i]), (l2[i], r2[i])]), a, b" ".join([spelt[x[i]], spelt[y[i]], spelt[z[i]]])))
        out.sort(key=lambda p: (-p[0], -p[3], p[4]))
        return [(key[0], key[1], p.decode(), a, l, r, s) for s, l, r, a, p in out[:top]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, parts, longer = None, None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                t = Transducer.from_bytes(row["data"])
                if (row["range"], row["lang"]) != key:
                    if own is not None:
                        yield from emit(phrases(key, own, parts, longer), target)
                    key, own, parts, longer = (row["range"], row["lang"]), None, [], []
                if row["side"] == 0:
                    own = t
                else:
                    (parts if row["side"] == 1 else longer).append(t)
        if own is not None:
            yield from emit(phrases(key, own, parts, longer), target)

    return dealt.mapInArrow(run, schema)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, shard_bytes: int = SHARD_BYTES,
                 sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, ranges: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = splitters(docs, ranges, sample_docs, sample_chars)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = saved(united(fragments(texts, bounds, shard_bytes), ranges, min_count), "counts")
    answers = answered(counts, asked(counts, bounds), ranges)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    group = F.pmod(F.xxhash64("range"), F.lit(MERGE_GROUPS))
    some = (scored(counts, answers, ranges, min_count, top).withColumn("group", group)
            .withColumn("rank", F.row_number().over(W.partitionBy("lang", "group").orderBy(*best))).where(F.col("rank") <= top))
    first = (some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top))
    n = counts.groupBy("lang").agg(F.sum("words").alias("n"))
    return (first.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir, "doc_id", "text", "lang"))


Q = {"op12_collocations": op12_collocations}
SQL = {"op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
f1 AS (SELECT lang, x, count(*) AS c FROM (SELECT lang, unnest(ws) AS x FROM w) GROUP BY ALL),
f2 AS (SELECT lang, g.x AS x, g.y AS y, count(*) AS c
       FROM (SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: {'x': ws[i], 'y': ws[i + 1]})) AS g FROM w WHERE len(ws) >= 2)
       GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, g.x AS x, g.y AS y, g.z AS z, count(*) AS c
       FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: {'x': ws[i], 'y': ws[i + 1], 'z': ws[i + 2]})) AS g
             FROM w WHERE len(ws) >= 3)
       GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, x, y, max(c) AS c FROM (SELECT lang, x, y, c FROM f3 UNION ALL SELECT lang, y, z, c FROM f3) GROUP BY ALL),
cuts AS (
  SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, 1 AS k, f2.c AS a, p.c AS l, q.c AS r
  FROM f2 JOIN f1 p ON p.lang = f2.lang AND p.x = f2.x JOIN f1 q ON q.lang = f2.lang AND q.x = f2.y
  LEFT JOIN longer o ON o.lang = f2.lang AND o.x = f2.x AND o.y = f2.y
  WHERE o.c IS NULL OR 100 * o.c < 50 * f2.c
  UNION ALL
  SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, 1, f3.c, p.c, q.c
  FROM f3 JOIN f1 p ON p.lang = f3.lang AND p.x = f3.x JOIN f2 q ON q.lang = f3.lang AND q.x = f3.y AND q.y = f3.z
  UNION ALL
  SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, 2, f3.c, p.c, q.c
  FROM f3 JOIN f2 p ON p.lang = f3.lang AND p.x = f3.x AND p.y = f3.y JOIN f1 q ON q.lang = f3.lang AND q.x = f3.z),
s AS (
  SELECT lang, phrase, a, l, r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score, k FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
n AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f1 GROUP BY lang)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM s JOIN n ON n.lang = s.lang
QUALIFY rank <= 2000"""}
