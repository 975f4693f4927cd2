"""Steps of the queries over many orders: rows dealt out, generated methods the JIT compiles, schemas parsed once."""

import json

from leafwise.functions import schema_json
from leafwise.operators.schema import schema_nodes
from leafwise.plans import schemas
from leafwise.session import JIT_METHOD_BYTES, dealt, tune

TEXT = json.dumps({"type": "object", "properties": {"a": {"$ref": "#/$defs/A"}, "b": {"type": "array", "items": {"type": "string"}}},
                   "$defs": {"A": {"type": "object", "properties": {"x": {"type": "string", "enum": ["u", "v"]}}}}})


class _Cluster:
    """A session of a master that is not local, as far as ``dealt`` asks."""
    master, defaultParallelism = "yarn", 3

    def __init__(self):
        self.sparkContext = self

    def getConf(self):
        return self

    def get(self, name, other):
        return other


class _Scan:
    sparkSession = _Cluster()

    def repartition(self, n):
        return n


def test_scans_are_dealt_on_a_cluster(spark):
    assert dealt(_Scan()) == 12
    one = spark.range(100).coalesce(1)
    assert dealt(one).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in dealt(one).collect()) == list(range(100))


def test_sample_schemas_do_not_stay_in_the_scan_tasks(spark, tmp_path):
    spark.createDataFrame([(k, "1-URGENT") for k in range(50)], "o_orderkey long, o_orderpriority string").coalesce(1).write.parquet(
        str(tmp_path / "orders.parquet"))
    found = schemas.sample_schemas(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 1 and found.count() == 50


def test_generated_methods_stay_below_the_jit_limit(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "65535")
        tune(spark)
        assert spark.conf.get(name) == str(JIT_METHOD_BYTES)
        spark.conf.set(name, "20000")
        tune(spark)
        assert spark.conf.get(name) == "20000"
    finally:
        spark.conf.set(name, before)


def test_a_schema_is_parsed_once(monkeypatch):
    parsed = []
    loads = json.loads
    monkeypatch.setattr(schema_json.json, "loads", lambda text: parsed.append(text) or loads(text))
    assert len(schema_json.nodes(TEXT)) == 5 and len(parsed) == 1
    text = schema_json.self_contained_or_none(TEXT)
    assert len(parsed) == 2 and text == schema_json.self_contained(TEXT)
    assert [schema_json.self_contained_or_none(t) for t in (None, "{", "[1]")] == [None, None, None]


def test_node_columns_asked_for_are_those_of_the_whole_table(spark):
    df = spark.createDataFrame([("s", TEXT), ("t", "[]"), (None, TEXT)], "schema_id string, schema_text string")
    whole, names = schema_nodes(df), ["schema_id", "spath", "order", "raw_enum"]
    some = schema_nodes(df, *names)
    assert some.columns == names and sorted(map(str, some.collect())) == sorted(map(str, whole.select(*names).collect()))
    assert len(some.collect()) == 10
