"""Collocations: transducers against dictionaries, the operator against a plain loop and against SQL, odd inputs."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafwise.llm import collocations as C
from tests.llm.conftest import SF

ROW = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(texts):
    out = Counter()
    for t in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            out.update(tuple(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    return out


def plain(rows, least=10, top=2000):
    """Expected output rows by plain loops."""
    by_lang = {}
    for t, lang in rows:
        by_lang.setdefault("und" if lang is None else lang, []).append(t)
    out = []
    for lang, texts in by_lang.items():
        f = counted(texts)
        n = sum(c for g, c in f.items() if len(g) == 1)
        longest = {}
        for g, c in f.items():
            if len(g) == 3 and c >= least:
                for part in (g[:2], g[1:]):
                    longest[part] = max(longest.get(part, 0), c)
        scored = []
        for g, a in f.items():
            if len(g) < 2 or a < least or len(g) == 2 and 100 * longest.get(g, 0) >= 50 * a:
                continue
            s, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-s, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, r + 1, p.decode(), -a, l, x, n, -s) for r, (s, a, p, l, x) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def as_counter(t):
    words = [w.decode() for w in t.words.to_pylist()]
    return Counter({tuple(words[i] for i in g): int(c) for k in range(3) for *g, c in zip(*[x.tolist() for x in t.grams(k)], t.weight[k].tolist()) if c})


def some_texts(rng, n, vocabulary=("a", "b", "Cc", "é", "zu", "zu-zu", "10", "x\x0by", "q\x1fr")):
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!? "]
    return ["".join(rng.choice(vocabulary) + rng.choice(ends) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_shard_union_pruning_and_storage_against_counters():
    rng = random.Random(1)
    for _ in range(60):
        lots = [some_texts(rng, rng.randint(0, 6)) for _ in range(rng.randint(1, 4))]
        parts = [C.shard([t.encode() for t in texts]) for texts in lots]
        for t, texts in zip(parts, lots):
            assert as_counter(t) == counted(texts)
            assert as_counter(C.Transducer.from_bytes(t.to_bytes())) == counted(texts)
        whole = C.Transducer.union(parts)
        want = counted([t for texts in lots for t in texts])
        assert as_counter(whole) == want
        assert as_counter(whole.least(3)) == Counter({g: c for g, c in want.items() if c >= 3})


def test_arcs_are_sorted_and_deterministic():
    t = C.shard([s.encode() for s in some_texts(random.Random(2), 40)])
    for k in range(3):
        assert (np.diff(t.keys(k)) > 0).all()
    assert t.words.to_pylist() == sorted(set(t.words.to_pylist()))


def test_ranges_split_and_lose_nothing():
    rng = random.Random(3)
    t = C.shard([s.encode() for s in some_texts(rng, 50)])
    for bounds in ([], [(b"b", b"cc")], [(b"a", b"a"), (b"a", b"zz"), (b"aa", b"a"), (b"zu", b"b"), (b"zzz", b"")]):
        parts = list(C.by_range(t, bounds))
        total = Counter()
        for r, part in parts:
            c = as_counter(part)
            assert not set(c) & set(total)
            total.update(c)
            for g in c:
                low = tuple(w for w in (bounds[r - 1] if r else ()) if w)
                head = tuple(w.encode() for w in g[:2])
                assert head >= low and (r == len(bounds) or head < tuple(w for w in bounds[r] if w))
        assert total == as_counter(t)


def test_composition_looks_up_parts():
    rng = random.Random(4)
    a, b = (C.shard([s.encode() for s in some_texts(rng, 15)]) for _ in range(2))
    known = as_counter(a)
    words = [w.decode() for w in b.words.to_pylist()]
    for k, at in enumerate(a.compose(b)):
        for *g, i in zip(*[c.tolist() for c in b.grams(k)], at.tolist()):
            assert (int(a.weight[k][i]) if i >= 0 else 0) == known.get(tuple(words[j] for j in g), 0)


def test_scores_beyond_64_bits_are_exact():
    a, l, r = 3_000_000_000, 4_000_000_000, 5_000_000_001
    assert C.score(a, [(l, r)]) == (1_000_000 * a * a // (l * r), l, r)
    assert C.score(10, [(100, 10), (10, 100)]) == (100_000, 100, 10)


@pytest.mark.parametrize("ranges,shard_bytes", [(1, 1 << 20), (7, 300), (40, 2000)])
def test_against_a_plain_loop(spark, ranges, shard_bytes):
    rng = random.Random(5)
    rows = [(t, rng.choice(["en", "en", "de", None, "und", ""])) for t in some_texts(rng, 400)]
    rows += [(None, "en"), ("", "fr"), ("only here", "it")] + [("hot pair of words, hot pair", "en")] * 200
    rows += [("New York City", "en")] * 12 + [("york city " * 3000, "en"), (" ".join(f"w{i}" for i in range(5000)), "en")]
    df = spark.createDataFrame([(i, t, lang, "s", 1) for i, (t, lang) in enumerate(rows)], ROW).withColumns(
        {"phrase": F.lit(1), "range": F.lit("x"), "words": F.lit(2)}).repartition(5)
    assert got(C.collocations(df, shard_bytes=shard_bytes, ranges=ranges)) == plain(rows)


def test_top_and_empty_table(spark):
    rng = random.Random(6)
    rows = [(t, rng.choice(["en", "de"])) for t in some_texts(rng, 300)]
    df = spark.createDataFrame([(i, t, lang, "s", 1) for i, (t, lang) in enumerate(rows)], ROW)
    assert got(C.collocations(df, min_count=3, top=5, ranges=6)) == plain(rows, 3, 5)
    assert got(C.collocations(df.limit(0))) == []


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({C.SQL['op12_collocations']})").fetchall())
    assert len(want) > 100 and got(C.op12_collocations(spark, SF)) == want
