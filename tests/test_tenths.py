"""Integer tenths of scores."""

import random

from pyspark.sql import functions as F

from leafwise.functions.stats import tenths


def test_tenths_round_like_round(spark):
    rng = random.Random(5)
    values = [0.05, 0.15, -0.05, -0.25, 0.049999999999999996, 12.3, 100.0, -0.0, None, 1e14, 0.25, 0.35] + [rng.uniform(-100, 100) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(tenths(F.col("x")).alias("a"), F.round(F.col("x") * 10.0).cast("long").alias("b"))
    assert all(r.a == r.b for r in got.collect())
    assert "round(" not in df.select(tenths(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
