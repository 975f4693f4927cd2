"""Golden document-score cases (FIXTURES.md §5.1)."""

import json

import pytest
from pyspark.sql import functions as F

from leafwise.operators.align import document_scores
from leafwise.operators.schema import schema_nodes


def obj(**props):
    return {"type": "object", "properties": props}


I = {"type": "integer"}
S = {"type": "string"}


def arr(items):
    return {"type": "array", "items": items}


CASES = [
    ("identical", obj(a=I, b=S), {"a": 1, "b": "x"}, {"a": 1, "b": "x"}, 2, 2, 100.0),
    ("extra leaf", obj(a=I), {"a": 1}, {"a": 1, "z": "x"}, 1, 2, 50.0),
    ("missing leaf", obj(a=I, b=S), {"a": 1, "b": "x"}, {"a": 1}, 1, 2, 50.0),
    ("null both dropped", obj(a=I, b=S), {"a": 1, "b": None}, {"a": 1}, 1, 1, 100.0),
    ("all null", obj(a=I), {"a": None}, {"a": None}, 0, 1, 0.0),
    ("both empty", {}, {}, {}, 0, 0, 100.0),
    ("predicted empty", obj(a=I), {"a": 1}, {}, 0, 1, 0.0),
    ("no prediction", {}, {"a": 1, "b": [1, 2], "c": None, "d": []}, None, 0, 4, 0.0),
    ("array subset", obj(t=arr(S)), {"t": ["x", "y"]}, {"t": ["y"]}, 1, 2, 50.0),
    ("array permuted", obj(t=arr(S)), {"t": ["abc", "xyz"]}, {"t": ["xyz", "abd"]}, 1.67, 2, 83.3),
    ("one wrong", obj(t=arr(S)), {"t": ["x"]}, {"t": ["q"]}, 0, 1, 0.0),
    ("null elements", obj(t=arr(S)), {"t": [None]}, {"t": [None]}, 1, 1, 100.0),
    ("extra elements", obj(t=arr(S)), {"t": ["x"]}, {"t": ["x", "y", "z"]}, 1, 3, 33.3),
    ("object array permuted", obj(l=arr(obj(k=S, v=I))), {"l": [{"k": "a", "v": 10}, {"k": "b", "v": 20}]},
     {"l": [{"k": "b", "v": 21}, {"k": "a", "v": 12}]}, 3.84, 4, 96.1),
    ("object array missing", obj(l=arr(obj(k=S, v=I))), {"l": [{"k": "a", "v": 10}, {"k": "b", "v": 20}]},
     {"l": [{"k": "b", "v": 20}]}, 2, 4, 50.0),
    ("scalar where object", obj(o=obj(k=S), a=I), {"o": "s", "a": 1}, {"o": {"k": "v"}, "a": 1}, 1, 2, 50.0),
    ("scalars lost", obj(o=obj(k=S), a=I), {"o": "s", "a": 1}, {"o": "t", "a": 1}, 1, 1, 100.0),
    ("key not in schema", {}, {"a": 100}, {"a": 101}, 0.67, 1, 66.7),
    ("type is a list", obj(a={"type": ["integer", "null"]}), {"a": 100}, {"a": 101}, 1, 1, 100.0),
    ("reserved key", obj(a=I), {"a": 1, "evaluation_config": {"x": 1}}, {"a": 1}, 1, 1, 100.0),
    ("no pinning", obj(t=arr(S)), {"t": ["aba", "ab"]}, {"t": ["ba", "aba"]}, 1.33, 2, 66.7),
    ("number array", obj(t=arr(I)), {"t": [10, 100]}, {"t": [104, 10]}, 2, 2, 100.0),
    ("empty gt untyped", obj(t={"type": "array"}), {"t": []}, {"t": [{"k": 1}]}, 0, 1, 0.0),
    ("ref and anyOf", {"type": "object", "$defs": {"P": {"type": "object", "properties": {"v": I}}},
                       "properties": {"p": {"anyOf": [{"$ref": "#/$defs/P"}, {"type": "null"}]}}},
     {"p": {"v": 100}}, {"p": {"v": 104}}, 1, 1, 100.0),
    ("schema_definition wrapper", {"schema_definition": obj(a=I)}, {"a": 100}, {"a": 104}, 1, 1, 100.0),
]


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(c[0], json.dumps(c[1]), json.dumps(c[2]), None if c[3] is None else json.dumps(c[3])) for c in CASES]
    df = spark.createDataFrame(rows, "doc_key string, schema string, gt string, pred string")
    df = df.select("doc_key", F.col("doc_key").alias("schema_id"), F.parse_json("schema").alias("schema"),
                   F.parse_json("gt").alias("gt"), F.parse_json("pred").alias("pred"))
    nodes = schema_nodes(df.select("schema_id", "schema"))
    out = document_scores(df.select("doc_key", "schema_id", "gt", "pred"), nodes)
    return {r["doc_key"]: r for r in out.collect()}


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_golden(scores, case):
    name, _s, _g, _p, total, mx, pct = case
    r = scores[name]
    assert r["max"] == mx
    assert r["pct"] == pytest.approx(pct, abs=0.051)
    assert r["total"] == pytest.approx(total, abs=0.011)
