"""Levels as column files: values keep their form, leaves leave what only containers need."""

import json

from pyspark.sql import functions as F

from leafwise.operators import align
from leafwise.session import stored


def test_stored_variants_keep_their_form(spark):
    texts = ["1.0", "1.25", "5", '{"a":1.0}', '{"a":2}', '{"a":2.50}', "[5,5.0]", "null"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string").repartition(1).select("k", F.parse_json("t").alias("v"))
    for some in (df, df.where("k < 3"), df.where("k between 3 and 5")):
        was, now = (sorted((r.k, r.t, r.j) for r in d.select("k", F.schema_of_variant("v").alias("t"), F.to_json("v").alias("j")).collect()) for d in (some, stored(some)))
        assert was == now


def test_whole_numbers_beside_fractions_below_the_root(spark):
    """5 and 5.0 print differently, also in a level that is stored with fractions beside them."""
    docs = {"same": ({"a": {"b": {"c": 5}}}, {"a": {"b": {"c": 5}}}), "form": ({"a": {"b": {"c": 5}}}, {"a": {"b": {"c": 5.0}}}),
            "other": ({"a": {"b": {"c": 1.25}}}, {"a": {"b": {"c": 1.5}}}), "list": ({"a": {"b": [{"c": 7}, {"c": 2.5}]}}, {"a": {"b": [{"c": 2.5}, {"c": 7}]}})}
    df = spark.createDataFrame([(k, json.dumps(g), json.dumps(p)) for k, (g, p) in docs.items()], "doc_key string, g string, p string").repartition(1)
    pairs = df.select("doc_key", F.lit("s").alias("schema_id"), F.parse_json("g").alias("gt"), F.parse_json("p").alias("pred"))
    nodes = spark.createDataFrame([("s", "$.a.b.c", "string", None)], "schema_id string, spath string, ftype string, items_type string")
    leaves = {(r.doc_key, r.path): r.score for r in align.leaf_scores(pairs, nodes).collect()}
    assert leaves[("same", "$.a.b.c")] == 1.0 and leaves[("form", "$.a.b.c")] == 1 - 2 / 3 and leaves[("list", "$.a.b[0].c")] == 1.0


def test_field_scores_keep_the_better_of_equal_paths(spark):
    df = spark.createDataFrame([("d", '{"a.b":"x","a":{"b":"yy"}}', '{"a.b":"x","a":{"b":"zz"}}'), ("e", "{}", "{}")], "doc_key string, g string, p string")
    pairs = df.select("doc_key", F.lit("s").alias("schema_id"), F.parse_json("g").alias("gt"), F.parse_json("p").alias("pred"))
    scored = align.document_scores(pairs, with_field_scores=True)
    assert {r.doc_key: (r.max, r.field_scores) for r in scored.collect()} == {"d": (2.0, {"$.a.b": 1.0}), "e": (0.0, {})}
    # Paths are brought together with their document once, not by path first.
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
