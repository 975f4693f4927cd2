"""Operator 2, SentencePiece encoding and decoding by suffix-array matching.

Encoding works on batches.  A batch's distinct segments (a segment never shares a piece with its neighbours)
are concatenated and indexed by a suffix array of as many characters as the longest piece has.  Every piece of
the vocabulary is binary-searched for the range of suffixes that start with it, which gives all occurrences as
edges (start, end, piece).  Edges are sorted by end position and relaxed from left to right:

* unigram models keep the edge with the best score of its path;
* byte-pair models keep the one edge whose piece is compatible with the last piece before it.  Two pieces are
  compatible if merging them side by side gives back the two pieces; a text's encoding is the chain whose
  neighbours are all compatible, so each prefix has exactly one last piece.

Decoding joins pieces, turns byte pieces into bytes and blanks the word marks.

Defined results: null and empty texts have no ids and decode to the empty text; characters outside the
vocabulary become byte pieces (models with byte fallback); the word mark itself decodes to a blank; whole
texts of any length are encoded; repeated rows are encoded one by one; an empty table gives an empty result;
only doc_id and text are read.
"""

from __future__ import annotations

import functools
import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.llm.common import documents

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
TEXT_CHARS = 1_000_000      # texts are cut into segments so many characters at a time
INDEX_CHARS = 600_000       # characters of distinct segments per suffix array (one longer segment stands alone)
CACHED_SEGMENTS = 900_000
DECODED_ROWS = 500
NO_PIECE = -1
ENCODED, DECODED = "doc_id long, ids array<int>", "doc_id long, ids array<int>, text string"
ENCODED_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DECODED_ARROW = ENCODED_ARROW.append(pa.field("text", pa.string()))


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, scores and byte ids of a model file; ``kind`` is "bpe" or "unigram"."""

    def __init__(self, path: str, kind: str = "bpe"):
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=path)
        self.kind, n = kind, model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.scores = np.array([model.get_score(i) for i in range(n)])
        special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)])
        self.is_byte = np.array([model.is_byte(i) for i in range(n)])
        self.byte_ids = np.zeros(256, np.int64)
        for i in np.nonzero(self.is_byte)[0]:
            self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        self.normal = np.nonzero(~special & ~self.is_byte)[0]
        self.id_of = {self.pieces[i]: int(i) for i in self.normal}
        self.longest = max(len(self.pieces[i]) for i in self.normal)
        # Characters get small numbers from 2 on; 0 divides segments, 1 is any character outside the vocabulary.
        chars = sorted({c for i in self.normal for c in self.pieces[i]})
        self.code = np.ones(0x110000, np.uint16)
        self.code[[ord(c) for c in chars]] = np.arange(2, len(chars) + 2)
        self.lone = np.zeros(len(chars) + 2, bool)              # characters that are pieces by themselves
        self.lone[self.code[[ord(self.pieces[i]) for i in self.normal if len(self.pieces[i]) == 1]]] = True
        # Marks that no piece has right after a letter: nothing merges across that seam.
        after_letter = {b for p in self.id_of for a, b in zip(p, p[1:]) if a.isalpha()}
        self.closing = "".join(c for c in string.punctuation if c not in after_letter)
        self.cut_inside = any(MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK)) for p in self.id_of)
        self._merges()
        self._search_keys()

    def _merges(self) -> None:
        """Rank of every piece, its last merge, and all pairs of pieces that join to a piece."""
        n = len(self.pieces)
        rank = np.full(n, np.iinfo(np.int64).max // 4)
        order = self.normal[np.lexsort((self.normal, -self.scores[self.normal]))]
        rank[order] = np.arange(len(order))
        self.rank = rank
        pairs, merged = [], []
        self.left, self.right = np.arange(n), np.arange(n)
        self.reachable = np.zeros(n, bool)
        for i in self.normal:
            p = self.pieces[i]
            for cut in range(1, len(p)):
                a, b = self.id_of.get(p[:cut]), self.id_of.get(p[cut:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    merged.append(i)
            if len(p) == 1:
                self.reachable[i] = True
            elif self.kind == "bpe":
                last = self._own_merge(p)
                if last is not None:
                    self.left[i], self.right[i], self.reachable[i] = *last, True
        if self.kind != "bpe":
            self.reachable[self.normal] = True
        order = np.argsort(pairs)
        self.pair, self.pair_rank = np.array(pairs, np.int64)[order], rank[np.array(merged, np.int64)][order]

    def _own_merge(self, piece: str) -> tuple[int, int] | None:
        """The two pieces whose merge makes ``piece`` when it stands alone, or None if merging ends elsewhere."""
        parts, last = list(piece), None
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.rank[i] < best[0]):
                    best = (self.rank[i], k)
            if best is None:
                return None
            k = best[1]
            last = (self.id_of.get(parts[k]), self.id_of.get(parts[k + 1]))
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return last if None not in last else None

    def _search_keys(self) -> None:
        """Pieces as rows of character numbers, filled up with 0 (lowest) and 65535 (highest)."""
        ids = self.normal[self.reachable[self.normal]]
        width = -(-self.longest // 4) * 4
        low = np.zeros((len(ids), width), np.uint16)
        high = np.full((len(ids), width), 0xFFFF, np.uint16)
        for r, i in enumerate(ids):
            codes = self.code[[ord(c) for c in self.pieces[i]]]
            low[r, :len(codes)] = high[r, :len(codes)] = codes
        self.search_ids, self.width = ids, width
        self.sizes = np.array([len(self.pieces[i]) for i in ids])
        self.low, self.high = pack(low), pack(high)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b side by side stay as they are (a or b may be NO_PIECE, which never merges).

        Undoes the merges along the seam, latest first; if at any time the two pieces at the seam could have
        merged before the merge that was undone last, they would not have stayed."""
        ok = np.ones(len(a), bool)
        at = np.nonzero((a >= 0) & (b >= 0))[0]
        x, y = a[at], b[at]
        limit = np.full(len(at), np.iinfo(np.int64).max)
        while len(at):
            key = x << 32 | y
            k = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            clash = (self.pair[k] == key) & (self.pair_rank[k] < limit)
            ok[at[clash]] = False
            can_x, can_y = self.left[x] != x, self.left[y] != y
            rx = np.where(can_x, self.rank[x], -1)
            ry = np.where(can_y, self.rank[y], -1)
            take_x = rx > ry                                     # of equal merges the left one came first
            limit = np.where(take_x, rx, ry + 1)
            go = ~clash & (can_x | can_y)
            x, y = np.where(take_x, self.right[x], x)[go], np.where(take_x, y, self.left[y])[go]
            at, limit = at[go], limit[go]
        return ok


def pack(codes: np.ndarray) -> np.ndarray:
    """Rows of 16-bit numbers as words of four, comparable from left to right."""
    c = codes.reshape(len(codes), -1, 4).astype(np.uint64)
    return c[:, :, 0] << np.uint64(48) | c[:, :, 1] << np.uint64(32) | c[:, :, 2] << np.uint64(16) | c[:, :, 3]


class SuffixIndex:
    """Suffixes of a batch text in the order of their first ``width`` characters."""

    def __init__(self, codes: np.ndarray, width: int):
        n = len(codes)
        padded = np.concatenate([codes, np.zeros(width + 4, np.uint16)]).astype(np.uint64)
        four = padded[:-3] << np.uint64(48) | padded[1:-2] << np.uint64(32) | padded[2:-1] << np.uint64(16) | padded[3:]
        words = [four[4 * k:4 * k + n] for k in range(width // 4)]
        order = np.argsort(words[0], kind="stable")
        # Suffixes that agree in the words so far are put in order by the next word, run by run.
        group = np.zeros(n, np.int64)
        for depth in range(len(words)):
            if depth:
                open_runs = tied[np.cumsum(new) - 1]
                at = np.nonzero(open_runs)[0]
                if not len(at):
                    break
                rows = order[at]
                order[at] = rows[np.lexsort((words[depth][rows], group[at]))]
            w = words[depth][order]
            new = np.concatenate([[True], (w[1:] != w[:-1]) | (group[1:] != group[:-1] if depth else False)])
            group = np.cumsum(new)
            starts = np.nonzero(new)[0]
            tied = np.diff(np.concatenate([starts, [n]])) > 1
        self.order = order
        self.words = [w[order] for w in words]

    def bound(self, keys: np.ndarray, after: bool) -> np.ndarray:
        """Binary search of every key at once: first suffix not below it (or above it).  The first word of four
        characters narrows the range by itself; only keys that go on within it are searched word by word."""
        first = self.words[0]
        lo, hi = np.searchsorted(first, keys[:, 0]), np.searchsorted(first, keys[:, 0], "right")
        out = lo.copy()
        at = np.nonzero(lo < hi)[0]
        lo, hi, rest = lo[at], hi[at], keys[at]
        while True:
            open_ = np.nonzero(lo < hi)[0]
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            less, equal = np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for k in range(1, keys.shape[1]):
                w = self.words[k][mid]
                less |= equal & (w < rest[open_, k])
                equal &= w == rest[open_, k]
            go = less | (equal & after)
            lo[open_] = np.where(go, mid + 1, lo[open_])
            hi[open_] = np.where(go, hi[open_], mid)
        out[at] = lo
        return out


def encode_segments(segments: list[str], v: Vocabulary) -> list[list[int]]:
    """ids of every segment."""
    text = "\0".join(segments) + "\0"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(s) for s in segments])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    codes = v.code[points]
    divider = np.cumsum(sizes + 1) - 1
    codes[divider] = 0
    index = SuffixIndex(codes, v.width)
    first, last = index.bound(v.low, False), index.bound(v.high, True)
    n_found = last - first
    piece = np.repeat(v.search_ids.astype(np.int32), n_found)
    length = np.repeat(v.sizes.astype(np.int32), n_found)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(n_found) - n_found, n_found)
    begin = index.order[np.repeat(first, n_found) + offset]
    lone = np.nonzero((~v.lone[codes]) & (codes > 0))[0]         # single characters that are no pieces
    begin = np.concatenate([begin, lone])
    end = np.concatenate([begin[:len(piece)] + length, lone + 1])
    piece = np.concatenate([piece, np.full(len(lone), NO_PIECE)])
    segment_of = np.repeat(np.arange(len(segments)), sizes + 1)
    depth = end - starts[segment_of[begin]]                      # characters of its segment that an edge reaches
    # By end position within the segment; edges that end at the same place stand together, the longest first.
    order = np.argsort((depth * (len(codes) + 1) + end) * (v.width + 1) + (v.width - (end - begin)))
    begin, end, piece, depth = begin[order], end[order], piece[order], depth[order]
    cuts = np.searchsorted(depth, np.arange(1, int(sizes.max(initial=0)) + 2))
    n = len(codes)
    back, own = np.full(n + 1, -1), np.full(n + 1, NO_PIECE)
    at_start = np.zeros(n + 1, bool)
    at_start[starts] = True
    best = np.full(n + 1, -np.inf)
    best[starts] = 0.0
    for a, b in zip(cuts[:-1], cuts[1:]):
        s, e, p = begin[a:b], end[a:b], piece[a:b]
        if v.kind == "bpe":
            # Of the edges that end at a place just one is compatible, most often the longest: it goes first.
            longest = np.concatenate([[True], e[1:] != e[:-1]])
            tried = np.nonzero(longest)[0]
            while len(tried):
                st, pt = s[tried], p[tried]
                good = at_start[st] | v.compatible(own[st], pt)
                hit = tried[good]
                back[e[hit]], own[e[hit]] = s[hit], p[hit]
                if not longest[tried[0]]:
                    break
                tried = np.nonzero(~longest & ~good[np.cumsum(longest) - 1])[0]
        else:
            total = best[s] + np.where(p >= 0, v.scores[p], v.scores.min() - 10.0)
            worst_first = np.lexsort((-s, total))
            s, e, p, total = s[worst_first], e[worst_first], p[worst_first], total[worst_first]
            best[e], back[e], own[e] = total, s, p
    # Back from every segment's end at once.
    here = starts + sizes
    live = np.nonzero(sizes > 0)[0]
    taken_segment, taken_piece, taken_start = [], [], []
    here = here[live]
    while len(live):
        taken_segment.append(live)
        taken_piece.append(own[here])
        taken_start.append(back[here])
        here = back[here]
        go = here != starts[live]
        live, here = live[go], here[go]
    if not taken_segment:
        return [[] for _ in segments]
    seg, ids, st = map(np.concatenate, (taken_segment, taken_piece, taken_start))
    order = np.argsort(st, kind="stable")
    seg, ids, st = seg[order], ids[order], st[order]
    out_at = np.concatenate([[0], np.cumsum(np.bincount(seg, minlength=len(segments)))])
    ids_list = ids.tolist()
    result = [ids_list[a:b] for a, b in zip(out_at[:-1], out_at[1:])]
    for r in set(seg[ids == NO_PIECE].tolist()):                 # byte fallback
        rows = range(out_at[r], out_at[r + 1])
        whole: list[int] = []
        for k in rows:
            if ids_list[k] != NO_PIECE:
                whole.append(ids_list[k])
            else:
                whole += v.byte_ids[list(text[st[k]].encode("utf-8", "replace"))].tolist()
        result[r] = whole
    return result


@functools.lru_cache(maxsize=1)
def encoder_of(path: str, kind: str) -> "Encoder":
    """The encoder of this worker process; tasks that follow in it find segments already known."""
    return Encoder(path, kind)


class Encoder:
    """ids of whole texts; distinct segments are matched once while they stay in a bounded cache."""

    def __init__(self, path: str, kind: str = "bpe"):
        self.v = Vocabulary(path, kind)
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of every text, as bytes."""
        split = []
        for t in texts:
            body = MARK + t.replace(" ", MARK) if t else ""
            split.append([body] if self.v.cut_inside and body else SEGMENT.findall(body))
        every = set().union(*split)
        new = every.difference(self.known)
        if len(self.known) + len(new) > CACHED_SEGMENTS:
            self.known.clear()
            new = every
        if new:
            self.learn(new)
        return [b"".join(map(self.known.__getitem__, s)) for s in split]


    def learn(self, segments: set[str]) -> None:
        """Encodes unknown segments; a segment that ends in closing marks is its stem's ids, then the marks'."""
        known, closing, marked = self.known, self.v.closing, []
        todo = {w for w in segments if w[-1] not in closing}
        for w in segments.difference(todo):
            stem = w.rstrip(closing)
            if stem[-1:].isalpha():
                marked.append((w, stem, w[len(stem):]))
            else:
                todo.add(w)
        todo.update([x for _, stem, tail in marked for x in (stem, tail)])
        todo = sorted(todo.difference(known))
        at = 0
        while at < len(todo):
            to, held = at, 0
            while to < len(todo) and (held == 0 or held + len(todo[to]) <= INDEX_CHARS):
                held += len(todo[to]) + 1
                to += 1
            for w, ids in zip(todo[at:to], encode_segments(todo[at:to], self.v)):
                known[w] = array("i", ids).tobytes()
            at = to
        for w, stem, tail in marked:
            known[w] = known[stem] + known[tail]


class Decoder:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else
                      b"" if model.is_control(i) else model.id_to_piece(i).replace(MARK, " ").encode()
                      for i in range(model.get_piece_size())]

    def __call__(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode_documents(docs: DataFrame, model: str | None = None, kind: str = "bpe") -> DataFrame:
    """Columns doc_id, ids (array of int) for every row."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, kind)
        for batch in batches:
            yield from encoded(batch, encoder)
    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def encoded(batch: pa.RecordBatch, encoder: Encoder) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) as (doc_id, ids), about ``TEXT_CHARS`` characters at a time."""
    target = ENCODED_ARROW
    texts = batch.column(1).to_pylist()
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (held == 0 or held + len(texts[to] or "") <= TEXT_CHARS):
            held += len(texts[to] or "")
            to += 1
        data = encoder(texts[at:to])
        ends = pa.array(np.concatenate([[0], np.cumsum([len(d) // 4 for d in data])]).astype(np.int32))
        ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(data), "<i4")))
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at).cast(target[0].type), ids.cast(target[1].type)], schema=target)
        at = to


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Columns doc_id, ids, text for every row of (doc_id, ids); ids pass through as they are, a null list is empty."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(path)
        for batch in batches:
            yield from decoded(batch, decoder)
    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED)


def decoded(batch: pa.RecordBatch, decoder: Decoder) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) with the texts, a bounded number of rows at a time."""
    target = DECODED_ARROW
    for at in range(0, batch.num_rows, DECODED_ROWS):
        part = batch.slice(at, DECODED_ROWS)
        ids = part.column(1)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        texts = [decoder(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([part.column(0).cast(target[0].type), ids.cast(target[1].type), pa.array(texts, pa.string())],
                                         schema=target)


def round_trip(docs: DataFrame, model: str | None = None, kind: str = "bpe") -> DataFrame:
    """``decode_documents(encode_documents(docs))`` in one pass: one worker process instead of two per task."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = encoder_of(path, kind), Decoder(path)
        for batch in batches:
            for part in encoded(batch, encoder):
                yield from decoded(part, decoder)
    return docs.select("doc_id", "text").mapInArrow(run, DECODED)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = round_trip(documents(spark, sf_dir, "doc_id", "text"))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids",
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


Q = {"op2_sentencepiece": op2_sentencepiece}
SQL: dict[str, str] = {}
