"""Values that many expressions read are computed once a row."""

from pyspark.sql import functions as F

from leafwise.functions.values import as_array, typed, with_element_info
from leafwise.operators import rubric
from leafwise.session import computed


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_struct_fields_are_not_computed_per_access(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "k int, t string").select(
        "k", F.struct(F.reverse("t").alias("t"), F.lit(3).alias("n")).alias("doc"), F.lit(True).alias("data"))
    assert computed(docs).columns == docs.columns and sorted(map(str, computed(docs).collect())) == sorted(map(str, docs.collect()))
    d = F.col("doc")
    parts = [("has", 1, F.when(d["t"] == "ba", 1).otherwise(0)), ("long", 2, F.when(F.length(d["t"]) > 1, d["n"] - 1).otherwise(0))]
    scored = rubric.score(docs, parts, F.col("data"), ["k"])
    assert _plan(scored).count("reverse(") == 1
    assert {r.k: (r.components, r.total, r.max, r.pct) for r in scored.collect()} == {
        1: ({"has": 1, "long": 2}, 3, 3, 100.0), 2: ({"has": 0, "long": 0}, 0, 3, 0.0)}


def test_texts_are_not_computed_per_keyword(spark):
    df = spark.createDataFrame([(1, ["Ab", "Cd"], [["AB"], ["x", "cD"], ["y"]]), (2, [], []), (3, ["q"], [[], None])],
                               "k int, t array<string>, g array<array<string>>")
    found = df.select("k", rubric.keyword_coverage(F.array_join("t", " "), F.col("g"), 9, True).alias("p"),
                      rubric.contains_any(F.array_join("t", " "), F.array(F.lit("b C"), F.lit("z"))).alias("c"))
    assert _plan(found).count("transform(array(") == 2
    assert {r.k: (r.p, r.c) for r in found.collect()} == {1: (6, True), 2: (0, False), 3: (0, False)}


def test_both_sides_of_a_match_share_a_python_process(spark):
    pairs = spark.createDataFrame([(1, '["a",[1,{"z":2}]]', '[1e300]'), (2, '["b"]', 'null')], "k int, g string, p string").select(
        "k", *[typed(as_array(F.parse_json(c))).alias(c) for c in "gp"], F.lit(False).alias("o"))
    both = with_element_info(pairs, {"a": "g", "b": "p"}, "o").select("k", "a", "b")
    assert both._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    texts = {r.k: tuple(x and [e.s for e in x] for x in (r.a, r.b)) for r in both.collect()}
    assert texts == {1: (["a", '[1,{"z":2}]'], ["1e+300"]), 2: (["b"], None)}
