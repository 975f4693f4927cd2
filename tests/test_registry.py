"""Adapters, modes and user metrics; samples by hashed key; invalid corpora fail whatever is asked of them."""

import pytest
from pyspark.sql import functions as F

from leafwise import registry
from leafwise.functions import leaf
from leafwise.operators import align, requests, selection
from leafwise.operators.schema import schema_nodes
from leafwise.sources import dims, jsonl


def test_dataset_adapters(spark):
    load = lambda spark, n=2: spark.range(n).selectExpr("cast(id as string) id", "'t' text")
    registry.register_dataset(registry.DatasetAdapter("tiny", load, lambda s: None, lambda nodes: None))
    assert registry.load_samples(spark, "tiny", n=5).count() == 5
    with pytest.raises(KeyError, match="tiny"):
        registry.dataset("other")
    registry.register_dataset(registry.DatasetAdapter("broken", lambda spark: spark.range(1), lambda s: None, lambda n: None))
    with pytest.raises(ValueError, match="text"):
        registry.load_samples(spark, "broken")


def test_modes(spark):
    before = list(dims.FW_MODES)
    registry.register_mode("mine", "loud", "JSON Object", ("\nSCHEMA:", "!"))
    try:
        assert ("mine", "loud") in {(r.framework, r["mode"]) for r in selection.select_modes(spark, ["mine"]).collect()}
        grid = spark.createDataFrame([("mine", "loud", "JSON Object", True, False, "doc")],
                                     "framework string, mode string, approach string, use_desc boolean, use_rich boolean, text string")
        row = requests.render_requests(grid, F.lit("R"), F.lit("M"), F.lit("{d}"), F.lit("{n}"), F.lit("X")).first()
        assert row.messages[0].content == "M\nSCHEMA:{d}!" and row.payload is None and row.schema_in_prompt
    finally:
        registry.unregister_mode("mine", "loud")
    assert dims.FW_MODES == before and "mine" not in dims.SUPPORTED_MODES


def test_user_metric(spark):
    leaf.register_metric("code", lambda a, p: F.when(F.lower(F.try_variant_get(a, "$", "string")) == F.lower(
        F.try_variant_get(p, "$", "string")), 1.0).otherwise(0.25))
    try:
        df = spark.createDataFrame([("d", '{"c":"AB"}', '{"c":"ab"}'), ("e", '{"c":"AB"}', '{"c":"AC"}')], "doc_key string, g string, p string")
        df = df.select("doc_key", F.lit("s").alias("schema_id"), F.parse_json("g").alias("gt"), F.parse_json("p").alias("pred"))
        nodes = schema_nodes(spark.createDataFrame([("s", '{"type":"object","properties":{"c":{"type":"code"}}}')], "schema_id string, schema_text string"))
        assert {r.doc_key: r.pct for r in align.document_scores(df, nodes).collect()} == {"d": 100.0, "e": 25.0}
    finally:
        del leaf.USER_METRICS["code"]


def test_sample_key_is_repeatable_and_seeded(spark):
    df = spark.range(1000).selectExpr("cast(id as string) id")
    pick = lambda seed, d: {r.id for r in selection.seeded_sample(d, 50, selection.sample_key(seed)).collect()}
    assert pick(1, df) == pick(1, df.repartition(7)) and len(pick(1, df)) == 50 and pick(1, df) != pick(2, df)
    assert selection.seeded_sample(df, None, selection.sample_key(None)).count() == 1000


@pytest.mark.parametrize("line", ['{"text": "x', '{"schema":"{bad","json":{}}', '{"schema":{},"json":"{bad"}'])
def test_strict_scan_fails_for_a_bare_count(spark, tmp_path, line):
    (tmp_path / "c.jsonl").write_text('{"schema":{},"json":{}}\n \t\n' + line + "\n")
    with pytest.raises(Exception, match="malformed"):
        jsonl.scan_strict(spark, str(tmp_path)).count()


def test_large_file_is_numbered_across_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(f"a{i}" for i in range(5000)) + "\n")
    (tmp_path / "b.jsonl").write_text("\r\n".join(f"b{i}" for i in range(10)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = jsonl.numbered_lines(spark, str(tmp_path))
        assert lines.select("file").rdd.getNumPartitions() >= 1
        got = {r.line_idx: r.line.strip() for r in lines.collect()}
        splits = spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert splits > 3 and got == {**{i: f"a{i}" for i in range(5000)}, **{5000 + i: f"b{i}" for i in range(10)}}


def test_strict_defaults(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"json":{"a":1}}\n')
    row = jsonl.scan_strict(spark, str(tmp_path)).select(F.to_json("schema").alias("s"), F.to_json("ground_truth").alias("g"), "text", "id").first()
    assert tuple(row) == ("{}", '{"a":1}', "", "custom_0000")


def test_elements_nested_five_deep(spark):
    """Arrays pair by stable strings at any depth."""
    from leafwise.functions.values import stable_text
    assert stable_text({"a": {"b": {"c": {"d": None, "e": True, "f": [1, {"g": "x"}]}}}}) == "{a:{b:{c:{d:,e:True,f:[1,{g:x}]}}}}"
