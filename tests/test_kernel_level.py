"""Arrays meet Python in a level of their own."""

import json

from pyspark.sql import functions as F

from leafwise.operators import align

PLAIN = [{"a": i, "b": f"t{i}"} for i in range(3)]
NESTED = [{"a": [1, {"b": 2}]}, {"a": [3]}]


def test_only_arrays_that_need_python_go_there(spark):
    docs = {"plain": (PLAIN, PLAIN[::-1]), "nested": (NESTED, NESTED[::-1]), "tie": ([{"a": 1, "b": "x"}] * 2, [{"a": 1, "b": "y"}] * 3)}
    df = spark.createDataFrame([(k, json.dumps(g), json.dumps(p)) for k, (g, p) in docs.items()], "doc_key string, g string, p string")
    fr = df.select("doc_key", F.lit("s").alias("schema_id"), F.lit("$").alias("path"), F.lit("$").alias("spath"), F.parse_json("g").alias("gt"),
                   F.parse_json("p").alias("pred"), F.lit("array").alias("gt_kind"), F.lit("array").alias("pred_kind"), F.lit("object").alias("items_type"))
    here = align._array_children(fr, python=False)
    assert "ArrowEvalPython" not in here._jdf.queryExecution().toString()
    marked = {r.doc_key for r in here.where(F.col("fixed") == align.KERNEL).collect()}
    assert marked == {"nested", "tie"}
    leaves = align.leaf_scores(fr.select("doc_key", "schema_id", "gt", "pred")).collect()
    assert {r.path: r.score for r in leaves if r.doc_key == "plain"} == {f"$[{i}].{k}": 1.0 for i in range(3) for k in "ab"}
    assert {r.path: r.score for r in leaves if r.doc_key == "nested"} == {"$[0].a[0]": 1.0, "$[0].a[1]": 1.0, "$[1].a[0]": 1.0}
    assert sorted(r.score for r in leaves if r.doc_key == "tie") == [0.0] * 4 + [1.0] * 2
