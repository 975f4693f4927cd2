"""Exact duplicates: the trie against a dictionary, the operator against a plain loop, spills, odd inputs."""

import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from leafwise.llm import exact_dedup as E
from tests.llm.conftest import DOCS, SF, docs_frame


def plain(rows):
    """Expected (doc_id, keep_id, group_size, text_sha256) of every row, sorted, and the number of groups."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", t or ""), []).append(i)
    out = []
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), len(groups)


def check(got, rows):
    want, groups = plain(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == want
    assert sum(r.kept for r in got) == groups and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_trie_against_a_dictionary():
    rng = random.Random(5)
    for _ in range(300):
        trie, seen = E.PatriciaTrie(), {}
        for _ in range(rng.randint(0, 60)):
            key = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 7)))
            node = trie.terminal(key)
            assert (node.end is not None) == (key in seen)
            node.end = seen.setdefault(key, [key])
        assert sorted(k for k, _ in trie.ends(trie.root)) == sorted(seen)
        assert trie.resident == trie.size(trie.root)
        half = trie.resident // 2
        gone = list(trie.spill(half)) if half else []
        left = list(trie.ends(trie.root))
        assert sorted(gone + left) == sorted((k, [k]) for k in seen) and trie.resident == trie.size(trie.root)


def test_plain_loop_with_white_space_ties_nulls_and_repeated_rows(spark):
    rng = random.Random(7)
    texts = ["", None, " ", "\t\n", "a  b", "a b", "a\tb ", "a b\r\n", "a b", "é", "é", "x" * 50_000, "x" * 49_999 + "y",
             "k\x1fb", " "]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts)) for _ in range(600)]
    rows += [(None, "only null ids"), (None, "only  null ids"), (5, "twice"), (5, "twice")]
    df = docs_frame(spark, [(1, "")]).limit(0).unionByName(
        spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)).withColumns(
        {"class_id": F.lit("x"), "size": F.lit(1), "kept": F.lit(None).cast("int"), "rows": F.lit(2)})
    check(E.exact_dedup(df.repartition(7)).collect(), rows)
    check(E.exact_dedup(df.coalesce(1)).collect(), rows)


def test_spilled_subtrees_change_nothing(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 6)))) for i in range(3000)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    check(E.exact_dedup(df.repartition(3), resident_bytes=200).collect(), rows)


def test_equal_hashes_do_not_make_equal_texts(spark):
    rows = [(1, 0, 9, 1, 0, 3, 77, b"abc", "s1"), (2, 0, 4, 2, 1, 3, 77, b"abd", "s2"), (3, 0, 5, 1, 0, 3, 77, b"abc", "s1")]
    df = spark.createDataFrame([(c, p, d, n, lead, s, h, bytearray(t), sha) for c, p, d, n, lead, s, h, t, sha in rows], E.LOCAL)
    got = {r.class_id: (r.keep_id, r.group_size, r.lead) for r in E.owners(df, resident_bytes=1).collect()}
    assert got == {1: (5, 2, None), 2: (4, 2, 1), 3: (5, 2, 0)}


def test_empty_table(spark):
    assert E.exact_dedup(docs_frame(spark, [(1, "")]).limit(0)).count() == 0


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute("SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM (" + E.SQL["op13_exact_dedup"] + ")").fetchall())
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in E.op13_exact_dedup(spark, SF).collect())
    assert got == want
