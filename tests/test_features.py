"""Exact large samples, published runs, replacing boards, schema faults, batch metrics."""

import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from leafwise.functions import schema_json
from leafwise.operators import prompts, selection
from leafwise.operators.schema import schema_nodes
from leafwise.sources import runs
from leafwise.streaming import incremental


@pytest.mark.parametrize("n", [1, 7, 799, 800, 900, 999, 1000, 2000])
def test_smallest_by_key(spark, monkeypatch, n):
    monkeypatch.setattr(selection, "TAKE_ORDERED", 5)
    rng = random.Random(n)
    big = 1 << 63
    rows = [(f"i{i:04d}", rng.choice([-big, big - 1, 0, -1, 7, 7, 7, rng.randrange(-big, big), rng.randrange(0, 1 << 20)])) for i in range(1000)]
    df = spark.createDataFrame(rows, "id string, k long")
    want = {i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))[:n]}
    got = [r.id for r in selection.smallest_by_key(df, n, F.col("k")).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r.id for r in selection.seeded_sample(df, n, F.col("k")).collect()} == want


def test_large_samples_need_no_single_task(spark):
    df = spark.range(100_000).select(F.col("id").cast("string").alias("id"))
    plan = selection.smallest_by_key(df, 80_000, selection.sample_key(3))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    limits = [int(x) for x in re.findall(r"(?:limit=|Limit )(\d+)", plan)]
    assert limits and max(limits) <= selection.TAKE_ORDERED and "rangepartitioning" not in plan


def test_published_runs(spark, tmp_path):
    root = str(tmp_path / "runs")
    row = "framework string, mode string, n int"
    one, two = spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], row), spark.createDataFrame([("b", "z", 3)], row)
    assert runs.published_runs(spark, root).count() == 0 and runs.read_runs(spark, root, one.schema).count() == 0
    assert runs.write_run(one, root, "r1")["rows"] == 2
    with pytest.raises(PySparkException):
        runs.write_run(one.withColumn("n", F.when(F.col("n") == 2, F.raise_error(F.lit("x")).cast("int")).otherwise(F.col("n"))), root, "r2")
    assert [r.run_id for r in runs.published_runs(spark, root).collect()] == ["r1"]
    runs.write_run(two, root, "r1")                     # replaced in one step
    runs.write_run(one, root, "r3")
    got = sorted(tuple(r) for r in runs.read_runs(spark, root, one.schema).select("_source", "framework", "mode", "n").collect())
    assert got == [("r1", "b", "z", 3), ("r3", "a", "x", 1), ("r3", "a", "y", 2)]
    assert runs.read_runs(spark, root, one.schema, ["r3"]).count() == 2
    assert runs.drop_replaced(spark, root) == 2 and runs.read_runs(spark, root, one.schema).count() == 3
    assert runs.run_name("d", __import__("datetime").datetime(2024, 2, 3, 4, 5, 6)) == "d_20240203_040506"


def test_replacing_board_in_any_order_and_on_retry(spark, tmp_path):
    row = "framework string, mode string, combination string, scored boolean, score_pct double, run int"
    files = [[("f", "m", "A", True, 10.0, 2)], [("f", "m", "A", True, 90.0, 1), ("f", "m", "B", True, 90.0, 1)],
             [("f", "o", "A", False, 0.0, 1)], [("f", "m", "A", True, 20.0, 2), ("f", "m", "C", True, 5.0, 2)], [("f", "o", "A", True, 30.0, 1)]]
    src = tmp_path / "src"
    args = None
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, row).coalesce(1).write.parquet(str(src / f"p={i}"))
        args = (spark, str(src), spark.createDataFrame([], row).schema, str(tmp_path / "sink"), str(tmp_path / "ckpt"))
        got = incremental.replacing_board(*args, files_per_trigger=1)
    board = {(r.framework, r["mode"], r.combination): (r.n_tests, r.n_ok, r.s_ok, r.s_all) for r in got.collect()}
    assert board == {("f", "m", "A"): (2, 2, 300, 300), ("f", "m", "C"): (1, 1, 50, 50), ("f", "o", "A"): (2, 1, 300, 300)}
    assert sorted(incremental.snapshots(spark, args[3])) == list(range(5))


def test_cycles_against_reachability():
    rng = random.Random(2)
    for _ in range(200):
        names = [chr(97 + i) for i in range(rng.randint(1, 7))]
        graph = {x: {y for y in names if rng.random() < 0.25} for x in names}
        starts = {x for x in names if rng.random() < 0.5}

        def reach(x):
            seen, todo = set(), list(graph[x])
            while todo:
                y = todo.pop()
                if y not in seen:
                    seen.add(y)
                    todo += graph[y]
            return seen
        there = starts.union(*[reach(x) for x in starts]) if starts else set()
        want = {tuple(sorted(y for y in names if y in reach(x) and x in reach(y))) for x in there if x in reach(x)}
        assert schema_json.cycles(graph, starts) == [list(c) for c in sorted(want)]


def test_faulty_schemas_do_not_fail_the_job(spark):
    loop = '{"properties":{"a":{"$ref":"#/$defs/A"}},"$defs":{"A":{"items":{"$ref":"#/$defs/B"}},"B":{"anyOf":[{"$ref":"#/$defs/A"}]}}}'
    unused = '{"type":"object","$defs":{"A":{"items":{"$ref":"#/$defs/A"}}}}'
    rows = [("ok", '{"$ref":"#/$defs/A","$defs":{"A":{"$ref":"#/$defs/B"},"B":{"type":"string"}}}'), ("cut", '{"type":'), ("list", "[1]"), ("loop", loop),
            ("unused", unused), ("null", None), ("number", "3")]
    df = spark.createDataFrame(rows, "schema_id string, schema_text string")
    assert {r.schema_id: r.inlined_text for r in prompts.inline_refs(df).collect()} == {"ok": '{"type":"string"}', "unused": '{"type":"object"}'}
    assert {r.schema_id: r.reason for r in prompts.schema_rejects(df).collect()} == {
        "cut": "not JSON", "list": "not an object", "loop": "reference cycle: A, B", "null": "not an object", "number": "not an object"}
    assert {r.schema_id for r in schema_nodes(df).collect()} == {"ok", "loop", "unused"}


def test_batch_metrics_score_nulls_before(spark):
    from leafwise.functions import leaf
    from leafwise.operators import align
    leaf.register_metric("word", lambda a, p: (a.str.len() == p.str.len()).astype(float), arrow=True)
    try:
        nodes = schema_nodes(spark.createDataFrame([("s", '{"type":"object","properties":{"w":{"type":"word"},"l":{"type":"array","items":{"type":"word"}}}}')],
                                                   "schema_id string, schema_text string"))
        docs = [("1", '{"w":"ab","l":["x",null]}', '{"w":"cd","l":["y",null]}'), ("2", '{"w":"ab"}', '{"w":null}'), ("3", '{"w":1}', '{"w":"12"}')]
        df = spark.createDataFrame(docs, "doc_key string, g string, p string").select(
            "doc_key", F.lit("s").alias("schema_id"), F.parse_json("g").alias("gt"), F.parse_json("p").alias("pred"))
        assert {r.doc_key: (r.total, r.max) for r in align.document_scores(df, nodes).collect()} == {"1": (3.0, 3.0), "2": (0.0, 1.0), "3": (0.0, 1.0)}
    finally:
        del leaf.ARROW_METRICS["word"]
