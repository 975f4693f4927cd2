"""Chat formatting: the query's SQL, reply trees against plain recursion, reversible escapes, odd inputs."""

import random

import duckdb
from pyspark.sql import functions as F

from leafwise.llm import chat_format as C
from tests.llm.conftest import SF

MESSAGES = "tree_id long, message_id long, parent_id long, score double, role string, text string"
NASTY = ["", "</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user<|text|>x", "<\\|end|>", "<\\\\|end|>", "[\\INST]", "<", "<|en", "\\", "é😀\n"]


def test_query_against_sql(spark):
    got = C.op6_chat_format(spark, SF).toPandas().sort_values("conv_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    want = con.execute(C.SQL["op6_chat_format"]).df().sort_values("conv_id").reset_index(drop=True)
    assert (got[sorted(got)] == want[sorted(want)]).all().all() and len(got) == len(want)


def plain_branches(rows):
    """tree -> ranked [(leaf, ids from root)], by recursion over parents."""
    out = {}
    for tree in {r[0] for r in rows}:
        nodes = {r[1]: r for r in rows if r[0] == tree}
        parents = {r[2] for r in nodes.values()}
        found = []
        for leaf in nodes:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in nodes and at not in path:
                path.append(at)
                at = nodes[at][2]
            if at in path:
                continue
            found.append((-sum(nodes[i][3] or 0.0 for i in path) / len(path), leaf, path[::-1]))
        out[tree] = [(leaf, path) for _, leaf, path in sorted(found)]
    return {t: b for t, b in out.items() if b}


def test_trees_against_recursion(spark):
    rng = random.Random(8)
    rows = []
    for tree in [None, 0, 1, 2, 3]:
        for i in range(1, 40):
            parent = rng.choice([None, *range(1, i)]) if tree != 1 else (i - 1 or None)
            rows.append((tree, i, parent, rng.choice([None, 0.5, 1.0]), rng.choice(["user", "assistant"]), f"t{tree} m{i}"))
    rows += [(9, 1, 2, 1.0, "user", "a"), (9, 2, 1, 1.0, "user", "b"), (9, 3, 2, 1.0, "user", "hangs from a cycle"), (9, 4, 77, 1.0, "user", "orphan")]
    want = plain_branches(rows)
    df = spark.createDataFrame(rows, MESSAGES).withColumns({"branch": F.lit(5), "up": F.lit(6), "formatted": F.lit("x")})
    back = C.read_back(C.format_branches(df)).collect()
    got = {}
    for r in sorted(back, key=lambda r: r.branch):
        got.setdefault(r.tree_id, []).append((r.leaf_id, [t.text for t in r.turns]))
    text = {(r[0], r[1]): r[5] for r in rows}
    assert got == {t: [(leaf, [text[t, i] for i in path]) for leaf, path in b] for t, b in want.items()}
    best = C.format_branches(df, keep=2).select("tree_id", "leaf_id", "branch").collect()
    assert {(r.tree_id, r.branch): r.leaf_id for r in best} == {
        (t, k + 1): leaf for t, b in want.items() for k, (leaf, _) in enumerate(b[:2])}


def test_odd_turns(spark):
    rows = [(1, 0, "user", NASTY[1]), (1, 1, "assistant", NASTY[2]), (1, 1, "assistant", NASTY[2]), (1, 2, None, None),
            (1, 3, "<|end|>\n", "<\\|end|>"), (1, 4, "assistant", "y" * 200_000), (None, None, "assistant", "no id"), (2, 5, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.tree_id: r for r in C.read_back(C.format_branches(C.conversation_messages(df))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r or "", t or "") for _, _, r, t in rows[:6]]
    assert back[1].loss_text == NASTY[2] * 2 + "y" * 200_000
    assert [back[1].formatted[s.start:s.end] for s in back[1].loss_spans][2] == "y" * 200_000
    assert back[None].loss_text == "no id" and back[2].loss_text == "" and len(back[2].loss_spans) == 1
    assert C.format_branches(C.conversation_messages(df.limit(0))).count() == 0


def test_escapes_are_reversible(spark):
    rng = random.Random(1)
    parts = ["<", "|", "end", "|>", "\\", "[", "INST", "]", "/", "s>", "turn", "text", "\n", "SYS>>", "ä"]
    texts = NASTY + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", C.escape(F.col("t")).alias("e")).select("t", "e", C.unescape(F.col("e")).alias("u")).collect()
    assert all(r.u == r.t and not any(c in r.e for c in ("<|end|>", "<|turn|>", "<|text|>", "[INST]", "[/INST]", "</s>")) for r in rows)


def test_repeated_message_ids_are_one_message(spark):
    n = 40
    once = [(1, i, i - 1 if i else None, 1.0, "assistant" if i % 2 else "user", f"m{i}") for i in range(n)]
    clash = [(1, 3, 2, 1.0, "assistant", "m3 too"), (None, 0, None, 1.0, "user", "x"), (None, 0, None, None, "user", "x")]
    rows = spark.createDataFrame(once * 2 + clash, MESSAGES).withColumns({"row": F.lit(1), "t": F.lit(2), "begin": F.lit(3), "up": F.lit(4)})
    got = {r.tree_id: r for r in C.read_back(C.format_branches(rows)).collect()}
    assert set(got) == {1, None} and [t.text for t in got[None].turns] == ["x"]
    assert [t.text for t in got[1].turns] == [f"m{i}" for i in range(n)]
    assert got[1].loss_text == "".join(f"m{i}" for i in range(1, n, 2))
    assert C.branches(rows).count() == n + 1
    assert C.format_branches(rows.limit(0)).count() == 0


def test_many_turns(spark):
    rows = [(5, i, i - 1 if i else None, 0.0, "assistant", "é" * (i % 3)) for i in range(6000)]
    back = C.read_back(C.format_branches(spark.createDataFrame(rows, MESSAGES))).first()
    assert len(back.turns) == 6000 and back.loss_text == "".join(r[5] for r in rows)
