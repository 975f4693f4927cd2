"""Operator 3, packing by lexical retrieval.

``tokenise`` turns whole texts into ids (ending with an end id) and cuts every document into windows: full
windows stand alone, the last part goes on to retrieval.  Terms are counted over all parts of the corpus, and
parts are sorted across partitions by their rarest shared terms (``ordered``), so that parts from anywhere in
the corpus that share these stand side by side; a partition is read in shards of up to ``shard_docs`` parts
that end, where possible, between two rarest terms.  Each shard builds a BM25 inverted index over its parts,
weighted by the corpus-wide counts; a seed queries it with all its terms, the best unused neighbours fill
the seed's window, and a neighbour that does not fit is cut: its rest seeds the next window.  Windows stay open
from shard to shard, so that only the last window of a partition is padded.

Defined results: null and empty texts are one end id; ties go to the part that sorts first (by doc_id, then
start, then ids); repeated rows are packed as often as they occur; an empty table gives an empty result; other
columns are not read.  A part whose terms nobody shares is followed by the next unused part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.llm.common import documents, saved

WINDOW = 2048
END_ID = 1
CACHED_WORDS = 1_200_000
CLOSING = frozenset((".", ",", ";", ":", "!", "?", ")"))
KEY_TERMS = 8               # rarest shared terms of a part that place it among the others
TEXT_CHARS = 4_000_000      # texts are split into words so many characters at a time
#: Byte-level vocabularies write printable Latin-1 bytes as they are and the other bytes, in order, from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
SPELLING = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
FULL = 1 << 39              # sequence numbers of full windows have this bit, those of other windows do not
PARTS = "doc_id long, start long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> "WordEncoder":
    """The encoder of this worker process; tasks that follow in it find the words already known."""
    return WordEncoder(path)


class WordEncoder:
    """ids of whole texts, by white-space separated words.

    The tokenizer drops white space and no rule of it reaches across, so a text's ids are its words' ids one
    after another; each distinct word is encoded once while it stays in a cache of bounded size."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.model = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.mark = "<|endoftext|>"
        self.mark_id = self.model.token_to_id(self.mark)
        # The same pieces without the rules for text that is not in normal form: for words that are, in one call.
        self.plain = Tokenizer(self.model.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.model.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """One byte string of ids per text (element type ``kind``), without the end id."""
        split = [self.words(t) if t else [] for t in texts]
        new: set[str] = set()
        for words in split:
            new.update(filterfalse(self.known.__contains__, words))
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
            new = set().union(*split)
        self.learn(new)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    @staticmethod
    def words(text: str) -> list[str]:
        """Splits at white space that the tokenizer drops as well; folds case where that cannot matter."""
        if "<|" not in text and text.isascii():
            text = text.lower()
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def learn(self, new: set[str]) -> None:
        """Encodes words that are not known; a letter word with one closing mark is its stem, then the mark."""
        if not new:
            return
        known = self.known
        marked = [w for w in new if w[-1:] in CLOSING and w[:-1].isalpha() and (w.isascii() or w[:-1].lower().isalpha())]
        todo = new.difference(marked)
        todo.update(CLOSING)
        todo.update([w[:-1] for w in marked])
        todo.difference_update(known)
        # A word of Latin-1 letters is one pre-token, in normal form already; its bytes are spelt as the
        # byte-level vocabulary spells them.
        letters = [w for w in todo if w.isalpha()]
        plain = [w for w in letters if w.isascii()]
        latin = [w for w in letters if not w.isascii() and max(w) < "\u0100"]
        self.encode(todo.difference(plain, latin))
        known.update(zip(plain, self.spelt([w.lower() for w in plain])))
        known.update(zip(latin, self.spelt([w.lower().encode().decode("latin-1").translate(SPELLING) for w in latin])))
        for w in marked:
            known[w] = known[w[:-1]] + known[w[-1]]

    def spelt(self, forms: list[str]) -> list[bytes]:
        """ids of words spelt in the vocabulary's letters: one call for all, cut after the pieces that end a word."""
        if not forms:
            return []
        ids = np.array(self.plain.encode_batch_fast([" ".join(forms)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.nonzero(self.ends_word[ids])[0] + 1
        if len(ends) != len(forms):         # a vocabulary without such pieces
            return [np.array([t.id for t in self.model.model.tokenize(f)], self.kind).tobytes() for f in forms]
        data, wide = ids.tobytes(), self.kind.itemsize
        cut = [0, *(ends * wide).tolist()]
        return [data[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def encode(self, words: set[str]) -> None:
        """Encodes unknown words in one text, divided by a special token of the vocabulary."""
        new = words.difference(self.known)
        odd = [w for w in new if "<|" in w]
        plain = list(new.difference(odd))
        for w in odd:
            self.known[w] = np.array(self.model.encode(w, add_special_tokens=False).ids, self.kind).tobytes()
        if plain:
            joined = self.model.encode_batch_fast([self.mark.join(plain)], add_special_tokens=False)[0].ids
            ids = np.array(joined, self.kind)
            data, wide = ids.tobytes(), self.kind.itemsize
            ends = (np.nonzero(ids == self.mark_id)[0] * wide).tolist() + [len(data)]
            at = 0
            for w, e in zip(plain, ends):
                self.known[w] = data[at:e]
                at = e + wide


def tokenise(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per cut of ``window`` ids (the last one shorter): doc_id, start, doc_tokens, ids."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    path = tokenizer or default_tokenizer()
    schema = _parse_datatype_string(PARTS)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        end = np.array([end_id], encode.kind).tobytes()
        wide = encode.kind.itemsize
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(ids):
                to, held = at, 0
                while to < len(ids) and (held == 0 or held + len(texts[to] or "") <= TEXT_CHARS):
                    held += len(texts[to] or "")
                    to += 1
                rows: tuple[list, list, list, list] = ([], [], [], [])
                for doc, data in zip(ids[at:to], encode(texts[at:to])):
                    data += end
                    n = len(data) // wide
                    for a in range(0, n, window):
                        for column, v in zip(rows, (doc, a, n, data[a * wide:(a + window) * wide])):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, target)], schema=target)
                at = to

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def id_kind(path: str) -> np.dtype:
    from tokenizers import Tokenizer
    return np.dtype("<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4")


def term_counts(parts: DataFrame, kind: np.dtype, window: int) -> tuple[int, np.ndarray]:
    """Number of parts under ``window`` ids, and by id the number of them that contain it.  Every task counts into
    one array over the vocabulary, so what is collected grows with the vocabulary and not with the corpus."""
    target = pa.schema([("term", pa.int64()), ("parts", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(1 << 16, np.int64), 0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                ids = np.unique(np.frombuffer(data, kind))
                if len(counts) <= ids[-1]:
                    counts = np.concatenate([counts, np.zeros(int(ids[-1]) + 1 - len(counts), np.int64)])
                counts[ids] += 1
                n += 1
        terms = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], terms])),
                                          pa.array(np.concatenate([[n], counts[terms]]))], schema=target)

    short = parts.where(F.length("ids") < window * kind.itemsize).select("ids")
    rows = short.mapInArrow(run, "term long, parts long").groupBy("term").agg(F.sum("parts").alias("parts")).collect()
    found = {r.term: r.parts for r in rows}
    n = found.pop(-1, 0)
    df = np.zeros(max(found, default=0) + 1, np.int64)
    df[list(found)] = list(found.values())
    return n, df


def ranks(df: np.ndarray) -> np.ndarray:
    """Rank of every id, the rarest that two parts share first; ids of one part only have the highest number."""
    out = np.full(len(df), 0xFFFFFFFF, np.uint32)
    shared = np.nonzero(df > 1)[0]
    out[shared[np.argsort(df[shared], kind="stable")]] = np.arange(len(shared))
    return out


def part_key(ids: np.ndarray, rank: np.ndarray) -> bytes:
    """A part's rarest shared terms, rarest first, as bytes that sort like the ranks."""
    r = np.unique(rank[ids])[:KEY_TERMS]
    return r[r < 0xFFFFFFFF].astype(">u4").tobytes()


def ordered(parts: DataFrame, rank: np.ndarray, kind: np.dtype, window: int) -> DataFrame:
    """Parts under ``window`` ids in the order of their rarest shared terms, by ranges.  Many parts of one key are told
    apart by ``deal``, so a range can end between them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    shared = parts.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(b, kind) for b in batch.column(3).to_pylist()]
            key = [part_key(ids, shared.value) for ids in held]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.binary())],
                                             names=[*batch.schema.names, "key"])

    keyed = parts.where(F.length("ids") < window * kind.itemsize).mapInArrow(run, f"{PARTS}, deal long, key binary")
    return keyed.repartitionByRange("key", "deal").sortWithinPartitions("key", "deal", "doc_id", "start", "ids")


def term_weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


class Shard:
    """BM25 over the parts of one shard; ``weights`` are corpus-wide term weights, by default the shard's own."""

    def __init__(self, parts: list[np.ndarray], query_terms: int | None = None, k1: float = 1.2, b: float = 0.75,
                 weights: np.ndarray | None = None):
        n = len(parts)
        sizes = np.array([len(p) for p in parts], np.int64)
        flat = np.concatenate(parts).astype(np.int64)
        pair, tf = np.unique(np.repeat(np.arange(n), sizes) << 32 | flat, return_counts=True)
        doc, term = pair >> 32, pair & 0xFFFFFFFF
        df = np.bincount(term)
        idf = term_weights(n, df) if weights is None else weights
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[doc] / sizes.mean()))
        self.n, self.first = n, np.searchsorted(doc, np.arange(n + 1))
        self.term, self.strength = term, np.where(df[term] > 1, weight, 0.0)
        order = np.argsort(term.astype(np.uint16) if len(df) <= 1 << 16 else term, kind="stable")
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.post_at = np.concatenate([[0], np.cumsum(df)])
        self.query_terms, self.listed = query_terms, n

    def drop_used(self, unused: np.ndarray) -> None:
        """Takes used parts out of the posting lists, each time that half of the parts listed there are used."""
        left = int(unused.sum())
        if 2 * left > self.listed:
            return
        stay = unused[self.post_doc]
        self.post_at = np.concatenate([[0], np.cumsum(stay)])[self.post_at]
        self.post_doc, self.post_weight, self.listed = self.post_doc[stay], self.post_weight[stay], left

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused parts that share a query term with the seed, best first."""
        a, b = self.first[seed], self.first[seed + 1]
        strength = self.strength[a:b]
        top = np.argsort(-strength, kind="stable")[:self.query_terms]
        terms = self.term[a:b][top[strength[top] > 0]]
        if not len(terms):
            return
        self.drop_used(unused)
        at = list(zip(self.post_at[terms].tolist(), self.post_at[terms + 1].tolist()))
        score = np.bincount(np.concatenate([self.post_doc[x:y] for x, y in at]),
                            np.concatenate([self.post_weight[x:y] for x, y in at]), minlength=self.n)
        score = np.where(unused, score, 0.0)
        near = 8
        while True:
            near = min(near, self.n)
            best = np.argpartition(-score, near - 1)[:near] if near < self.n else np.arange(self.n)
            best = best[np.lexsort((best, -score[best]))]
            for d in best[score[best] > 0]:
                yield int(d)
            if near == self.n or score[best[-1]] <= 0:
                return
            score[best] = 0.0
            near *= 4


class Packer:
    """Fills windows for one partition; ``put`` collects pieces."""

    def __init__(self, partition: int, window: int, query_terms: int | None, kind: np.dtype, weights: np.ndarray | None = None):
        self.weights = weights
        self.next_id, self.window, self.query_terms, self.kind = partition << 40, window, query_terms, kind
        self.sequence, self.room, self.pieces = None, 0, []

    def open(self) -> None:
        self.sequence, self.room, self.next_id = self.next_id, self.window, self.next_id + 1

    def put(self, row, a: int, b: int) -> None:
        doc, start, total, ids = row
        self.pieces.append((doc, start + a, b - a, ids[a:b].astype("<u4").tobytes(), total, self.sequence,
                            self.window - self.room))
        self.room -= b - a

    def pack(self, rows: list) -> list[tuple]:
        """rows: (doc_id, start, doc_tokens, ids).  Returns the pieces of these rows."""
        self.pieces = []
        if rows:
            index = Shard([r[3] for r in rows], self.query_terms, weights=self.weights)
            unused = np.ones(len(rows), bool)
            front = 0
            seed, cut = None, 0
            while True:
                if seed is None:
                    while front < len(rows) and not unused[front]:
                        front += 1
                    if front == len(rows):
                        break
                    seed, cut = front, 0
                    unused[seed] = False
                if self.room == 0:
                    self.open()
                take = min(len(rows[seed][3]) - cut, self.room)
                self.put(rows[seed], cut, cut + take)
                if cut + take < len(rows[seed][3]):
                    cut += take
                    continue
                over = None
                if self.room:
                    for d in index.neighbours(seed, unused):
                        unused[d] = False
                        take = min(len(rows[d][3]), self.room)
                        self.put(rows[d], 0, take)
                        if take < len(rows[d][3]):
                            over = (d, take)
                        if self.room == 0:
                            break
                seed, cut = over or (None, 0)
        return self.pieces


def full_windows(parts: DataFrame, kind: np.dtype, window: int) -> DataFrame:
    """Parts of ``window`` ids are sequences as they are and need no neighbours: straight from the stored parts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    schema = _parse_datatype_string(PIECES)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 40 | FULL
        for batch in batches:
            n = batch.num_rows
            ids = [np.frombuffer(b, kind).astype("<u4").tobytes() for b in batch.column(3).to_pylist()]
            length, sequence = np.full(n, window, np.int64), np.arange(number, number + n)
            number += n
            columns = [batch.column(0), batch.column(1), length, ids, batch.column(2), sequence, np.zeros(n, np.int64)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, target)],
                                             schema=target)

    whole = parts.where(F.length("ids") == window * kind.itemsize)
    return whole.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID,
                   shard_docs: int = 2048, query_terms: int | None = None) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids (little-endian unsigned 32 bit), doc_tokens, sequence_id,
    offset.  ``query_terms`` bounds a seed's query to its strongest terms; None asks for all.  A partition's rows are sorted first, so a task that runs again makes the same sequences."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    path = tokenizer or default_tokenizer()
    kind = id_kind(path)
    schema = _parse_datatype_string(PIECES)
    target = to_arrow_schema(schema)
    # Kept, as three passes read them: terms counted, ranges sampled, ranges dealt.
    parts = saved(tokenise(docs, path, window, end_id).withColumn("deal", F.xxhash64("doc_id", "start", F.crc32("ids"))), "parts")
    n, df = term_counts(parts, kind, window)
    dealt = ordered(parts, ranks(df), kind, window).select("doc_id", "start", "doc_tokens", "ids", "key")
    weights = docs.sparkSession.sparkContext.broadcast(term_weights(n, df))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        packer = Packer(TaskContext.get().partitionId(), window, query_terms, kind, weights.value)

        def emit(rows):
            cols = list(zip(*packer.pack(rows)))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target)], schema=target)

        short, rarest = [], None
        for batch in batches:
            for doc, start, total, ids, key in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if len(short) == shard_docs or 2 * len(short) >= shard_docs and key[:4] != rarest:
                    yield emit(short)
                    short = []
                short.append((doc, start, total, np.frombuffer(ids, kind)))
                rarest = key[:4]
        if short:
            yield emit(short)

    return dealt.mapInArrow(run, schema).unionByName(full_windows(parts, kind, window))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack_documents(documents(spark, sf_dir, "doc_id", "text")))


Q = {"op3_packing": op3_packing}
SQL: dict[str, str] = {}
