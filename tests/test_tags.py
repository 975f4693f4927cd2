"""Kinds of values without a look into containers."""

from pyspark.sql import functions as F

from leafwise.functions.values import kind_of, vtag, vtype


def test_tags_tell_the_same_kinds(spark):
    values = ['{"a":1}', "{}", "[]", '[1,{"a":[]}]', "1", "1.5", "1.0", "1e300", '"x"', '""', "true", "null", None, "123456789012345678901234567890"]
    df = spark.createDataFrame([(v,) for v in values], "s string").select("s", F.parse_json("s").alias("v"))
    rows = df.select("s", kind_of(vtag(F.col("v"))).alias("a"), kind_of(vtype(F.col("v"))).alias("b"), vtag(F.col("v")).alias("t")).collect()
    assert all(r.a == r.b for r in rows)
    assert {r.t for r in rows if r.a in ("object", "array")} == {"OBJECT", "ARRAY"}
