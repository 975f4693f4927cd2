"""Typed documents: conversions, missing fields, reserved keys, unions and depth."""

import json

from pyspark.sql import functions as F

from leafwise.operators import responses, schema, typed

SCHEMA = {"type": "object", "required": ["n"], "properties": {
    "n": {"type": "integer"}, "x": {"type": "number"}, "b": {"type": "boolean"}, "s": {"type": "string"},
    "e": {"enum": ["5", 5, None]}, "u": {"anyOf": [{"type": "integer"}, {"type": "string"}]}, "o": {"anyOf": [{"type": "number"}, {"type": "null"}]},
    "evaluation_config": {"type": "string"}, "a": {"type": "array", "items": {"type": "array", "items": {"$ref": "#/$defs/P"}}}, "q\"": {"type": "string"},
    "free": {}},
    "$defs": {"P": {"type": "object", "properties": {"k": {"type": "integer"}, "evaluation_config": {"type": "integer"}}}}}


def run(spark, docs, schema_dict=SCHEMA):
    nodes = schema.schema_nodes(spark.createDataFrame([("s", json.dumps(schema_dict))], "schema_id string, schema_text string"))
    preds = spark.createDataFrame([(str(i), "s", json.dumps(d), None) for i, d in enumerate(docs)], "sample_id string, schema_id string, raw_response string, error string")
    out = responses.parse_and_validate(preds, nodes, convert=True).select("sample_id", "success", F.to_json("data").alias("d"), "error").collect()
    return {int(r.sample_id): (json.loads(r.d) if r.d else None, r.error) for r in out}


def test_conversions_defaults_and_reserved_keys(spark):
    none = dict.fromkeys(["n", "x", "b", "s", "e", "u", "o", "a", 'q"', "free"])
    got = run(spark, [
        {"n": " 7 ", "x": 3, "b": "yes", "s": "t", "e": 5, "u": "5", "o": "1.5", "evaluation_config": "x", "extra": [1]},
        {"n": 7.0, "x": "2e3", "b": 0, "u": {"k": [1]}, "free": {"evaluation_config": 1}},
        {"n": "9007199254740993", "a": [[], [{"k": "1", "z": 2, "evaluation_config": 3}, {}], []], 'q"': "x\"y"},
        {"n": True, "b": False}])
    assert got[0] == ({**none, "n": 7, "x": 3.0, "b": True, "s": "t", "e": 5, "u": "5", "o": 1.5}, None)
    assert got[1] == ({**none, "n": 7, "x": 2000.0, "b": False, "u": {"k": [1]}, "free": {"evaluation_config": 1}}, None)
    assert got[3] == ({**none, "n": 1, "b": False}, None)
    assert got[2] == ({**none, "n": 9007199254740993, "a": [[], [{"k": 1}, {"k": None}], []], 'q"': 'x"y'}, None)


def test_invalid_documents_have_no_data(spark):
    got = run(spark, [{"x": 1}, {"n": 5.5}, {"n": 1, "s": 5}])
    assert all(d is None and e.startswith("validation error") for d, e in got.values())


def test_reserved_key_is_no_node(spark):
    nodes = schema.schema_nodes(spark.createDataFrame([("s", json.dumps(SCHEMA))], "schema_id string, schema_text string"))
    assert not [r for r in nodes.collect() if "evaluation_config" in r.spath]
    assert "evaluation_config" not in schema.struct_ddl(nodes).first().ddl


def test_depth_and_no_schema(spark):
    deep, inner = {"type": "integer"}, "4"
    for _ in range(12):
        deep, inner = {"type": "object", "properties": {"d": deep}}, {"d": inner}
    got = run(spark, [inner], deep)[0][0]
    for _ in range(12):
        got = got["d"]
    assert got == 4
    docs = spark.createDataFrame([("1", "none", '{"a":"1"}')], "sample_id string, schema_id string, t string").select("sample_id", "schema_id", F.parse_json("t").alias("parsed"))
    nodes = schema.schema_nodes(spark.createDataFrame([("s", "{}")], "schema_id string, schema_text string"))
    assert typed.typed_documents(docs, nodes).first().data_text == '{"a":"1"}'
