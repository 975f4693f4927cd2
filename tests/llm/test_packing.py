"""Packing: word-wise ids against the tokenizer, exact cover of every document, little padding, odd inputs."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafwise.llm import packing as P
from tests.llm.conftest import SF, docs_frame


def whole(texts):
    model = Tokenizer.from_file(P.default_tokenizer())
    return [[*e.ids, 1] for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, ids, window=P.WINDOW):
    """rows: (doc, start, length, crc, total, sequence, offset); ids: doc -> all its ids, each doc once."""
    by_doc, by_sequence = {}, {}
    for doc, start, length, crc, total, sequence, offset in rows:
        assert 0 < length <= window and total == len(ids[doc])
        assert crc == zlib.crc32(np.array(ids[doc][start:start + length], "<u4").tobytes())
        by_doc.setdefault(doc, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length))
    assert by_doc.keys() == ids.keys()
    for pieces, total in [(sorted(p), len(ids[d])) for d, p in by_doc.items()] + [(sorted(p), None) for p in by_sequence.values()]:
        at = 0
        for start, length in pieces:
            assert start == at
            at += length
        assert at == total if total is not None else at <= window
    return 1 - sum(r[2] for r in rows) / window / len(by_sequence)


def test_words_one_by_one_equal_whole_texts():
    r = random.Random(5)
    letters = "aBcÉßñÀÿµªº'.,<|endoftext|> ΣςİŸĀ日本12½　\x1c\x85́ !?)(\n\t\r"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["a<|endoftext|>b <|ENDOFTEXT|>", "don't we'll I'm", "", "café, é.", "x" * 50_000]
    encoder = P.WordEncoder(P.default_tokenizer())
    got = [np.frombuffer(b, encoder.kind).tolist() for i in range(0, len(texts), 500) for b in encoder(texts[i:i + 500])]
    assert [[*g, 1] for g in got] == whole(texts)


def test_known_words_are_forgotten_at_the_bound(monkeypatch):
    monkeypatch.setattr(P, "CACHED_WORDS", 50)
    encoder = P.WordEncoder(P.default_tokenizer())
    texts = [" ".join(f"word{i} and{j}." for j in range(30)) for i in range(20)]
    assert [[*np.frombuffer(encoder([t])[0], encoder.kind).tolist(), 1] for t in texts] == whole(texts)


def test_query_covers_every_document(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [tuple(r) for r in P.op3_packing(spark, SF).collect()]
    padding = check(rows, dict(zip(docs, whole(docs.values()))))
    assert padding < 0.05


def test_one_partition_pads_its_last_window_only(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    encoder = P.WordEncoder(P.default_tokenizer())
    packer, rows, total = P.Packer(0, 256, 24, encoder.kind), [], 0
    parts = []
    for d, t in docs.items():
        ids = np.frombuffer(encoder([t])[0] + b"\x01\x00", encoder.kind)
        total += len(ids)
        parts += [(d, a, len(ids), ids[a:a + 256]) for a in range(0, len(ids), 256)]
    full = [p for p in parts if len(p[3]) == 256]
    parts = [p for p in parts if len(p[3]) < 256]
    rows += [(d, a, 256, zlib.crc32(ids.astype("<u4").tobytes()), n, -1 - i, 0) for i, (d, a, n, ids) in enumerate(full)]
    for at in range(0, len(parts), 100):
        rows += [(d, a, n, zlib.crc32(b), t, s, o) for d, a, n, b, t, s, o in packer.pack(parts[at:at + 100])]
    check(rows, dict(zip(docs, whole(docs.values()))), 256)
    assert len({r[5] for r in rows}) == -(-total // 256)


def test_neighbours_share_rare_words():
    parts = [np.array(x) for x in ([5, 6, 7, 8], [9, 10, 11], [5, 6, 7, 12], [13, 14], [5, 20])]
    index = P.Shard(parts, 24)
    assert list(index.neighbours(0, np.array([False, True, True, True, True]))) == [2, 4]
    assert list(index.neighbours(3, np.ones(5, bool))) == []


def test_odd_inputs(spark):
    df = docs_frame(spark, [(1, None), (2, ""), (3, "hello world " * 3000), (4, "same"), (4, "same"), (None, "x")])
    df = df.selectExpr("*", "7 as ids", "8 as start")
    rows = [tuple(r) for r in P.digest(P.pack_documents(df)).collect()]
    assert sorted(r[1:5] for r in rows if r[0] in (1, 2)) == [(0, 1, zlib.crc32(b"\1\0\0\0"), 1)] * 2
    assert sum(r[2] for r in rows if r[0] == 3) == 6001 and len([r for r in rows if r[0] == 4]) == 2
    assert P.pack_documents(df.limit(0)).count() == 0


def test_near_parts_meet_from_anywhere_in_the_corpus(spark):
    """Groups of three among many others, in shards far smaller than the corpus: neighbours come from all parts."""
    r = random.Random(8)
    words = [f"{a}{b}" for a in ("river", "stone", "cloud", "engine", "market", "garden", "paper", "winter") for b in ("ing", "er", "s", "ly", "ness")]
    model = Tokenizer.from_file(P.default_tokenizer())
    rare = sorted((t for t in model.get_vocab() if t.isascii() and t.isalpha() and len(t) > 6))[:600]
    rows = []
    for g in range(200):
        own = r.sample(rare, 6)
        for k in range(3):
            text = [r.choice(words) for _ in range(20)] + own
            r.shuffle(text)
            rows.append((g * 3 + k, " ".join(text)))
    r.shuffle(rows)
    docs = docs_frame(spark, rows).repartition(5)

    def near(shard_docs):
        by_window = {}
        for p in P.pack_documents(docs, window=256, shard_docs=shard_docs).select("doc_id", "sequence_id").distinct().collect():
            by_window.setdefault(p.sequence_id, set()).add(p.doc_id)
        return len({(a, b) for w in by_window.values() for a in w for b in w if a < b and a // 3 == b // 3})

    whole_corpus = near(2048)                       # one index over all 600 parts
    assert whole_corpus > 250 and near(60) > 0.9 * whole_corpus


def test_full_windows_do_not_pass_the_range_shuffle(spark):
    texts = ["the same long text of a hot source " * 600 for _ in range(30)] + ["few words here"] * 20
    kind = P.id_kind(P.default_tokenizer())
    parts = P.tokenise(docs_frame(spark, texts), window=64).withColumn("deal", F.xxhash64("doc_id", "start"))
    n, df = P.term_counts(parts, kind, 64)
    rows = P.ordered(parts, P.ranks(df), kind, 64).collect()
    full = P.full_windows(parts, kind, 64).collect()
    assert n == len(rows) == 50 and all(len(row.key) and len(row.ids) < 64 * kind.itemsize for row in rows)
    assert len(full) > 30 * 60 and len({r.sequence_id for r in full}) == len(full)
    pieces = P.digest(P.pack_documents(docs_frame(spark, texts), window=64)).collect()
    check([tuple(r) for r in pieces], dict(enumerate(whole(texts))), 64)


def test_used_parts_leave_the_postings():
    r = random.Random(9)
    parts = [np.array(r.choices(range(60), k=r.randint(1, 20))) for _ in range(80)]
    index, unused = P.Shard(parts), np.ones(80, bool)
    while unused.sum() > 1:
        seed = int(np.nonzero(unused)[0][0])
        unused[seed] = False
        got = list(index.neighbours(seed, unused))
        fresh = P.Shard(parts)
        fresh.drop_used = lambda _: None
        assert got == list(fresh.neighbours(seed, unused))
        unused[got[:3]] = False
    assert index.listed < 40 and len(index.post_doc) < 40 * 20


def test_neighbours_by_any_shared_term():
    """The seed shares thirty terms with one part, and with another only terms that are weaker than these."""
    seed, weak = np.arange(100, 131), np.arange(500, 504)
    parts = [np.concatenate([np.repeat(seed, 3), weak]), np.repeat(seed, 3), weak, np.array([900, 901])]
    assert list(P.Shard(parts).neighbours(0, np.array([False, True, True, True]))) == [1, 2]
    assert list(P.Shard(parts, 24).neighbours(0, np.array([False, True, True, True]))) == [1]
    assert P.pack_documents.__defaults__[-1] is None
