"""Steps that were rewritten to scale give what the plain ones give."""

import functools

from pyspark.sql import functions as F

from leafwise.functions.leaf import leaf_score, with_leaf_score
from leafwise.functions.values import as_array, element_info, typed, vtype, with_element_info
from leafwise.operators import align

ARRAYS = ['[]', 'null', '[{"b":1,"a":"x"},{"a":null,"c":true}]', '[{"a":1.0},{"a":0.00001},{"a":12345678901234567890}]', '[{"a":[1,{"z":2}]}]',
          '[{"a":1},null,3]', '["x",1,1.50,null,false]', '[1e300,[1],{"k":"v"}]', '[{"\\ud83d\\ude00":1,"\\uffee":2,"":""}]', '[0.0,-0.0001,100.0]']


def _variants(spark, texts, names=("id", "v")):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id int, " + ", ".join(f"{n} string" for n in names[1:]))
    return df.select("id", *[F.parse_json(n).alias(n) for n in names[1:]])


def test_element_info_by_expressions(spark):
    for objects in (True, False):
        df = _variants(spark, [(t,) for t in ARRAYS]).select("id", as_array(F.col("v")).alias("a")).where("a is not null")
        plain = df.select("id", element_info(F.to_variant_object("a"), F.lit(objects)).alias("x")).collect()
        fast = with_element_info(df.select("id", typed(F.col("a")).alias("t"), F.lit(objects).alias("o")), {"x": "t"}, "o").select("id", "x").collect()
        assert sorted(map(str, plain)) == sorted(map(str, fast))


def test_match_from_shared_fields_is_the_full_match(spark):
    pairs = [('[{"a":1,"b":"p"},{"a":2,"b":"q"}]', '[{"a":2,"b":"q"},{"a":1,"b":"r"}]'), ('[{"a":1},{"a":1}]', '[{"a":1}]'),
             ('[{"a":1}]', '[{"a":2},{"a":1},{"a":3}]'), ('[{"a":5},{"a":6},{"a":7}]', '[{"a":7},{"a":5}]'), ('[]', '[{"a":1}]'), ('[{"a":1}]', '[]')]
    df = _variants(spark, pairs, ("id", "g", "p"))
    run = functools.partial(align.array_matching, df, as_array(F.col("g")), as_array(F.col("p")), F.lit("object"))
    found = {k: {r.id: r._match for r in run(keep_weights=k).select("id", "_match").collect()} for k in (False, True)}
    assert found[False] == found[True]
    assert found[False][0] == [1, 0] and found[False][3] == [1, -1, 0]


def test_staged_leaf_scores(spark):
    values = ['null', '"a"', '" a "', '"\\u00a0a"', '""', '"12"', '12', '12.5', 'true', '"1_0"', '"nan"', '[1]', '0']
    df = _variants(spark, [(a, p) for a in values for p in values], ("id", "a", "p")).crossJoin(
        spark.createDataFrame([(t,) for t in ("string", "number", "integer", "boolean", "other")], "ft string"))
    df = df.withColumns({"at": vtype(F.col("a")), "pt": vtype(F.col("p"))})
    plain = df.select("id", "ft", leaf_score(*map(F.col, ("a", "p", "ft", "at", "pt"))).alias("score"))
    staged = with_leaf_score(df, F.lit(True), "a", "p", "ft", "at", "pt").select("id", "ft", "score")
    assert plain.count() == 5 * len(values) ** 2 and plain.exceptAll(staged).isEmpty() and staged.exceptAll(plain).isEmpty()
