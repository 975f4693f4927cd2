"""New result rows of a merge never go through the driver, however small their shuffle is."""

from pyspark.sql import functions as F

from leafwise.operators import grid


def test_new_rows_are_not_broadcast(spark):
    def rows(first, last, score):
        return spark.range(first, last).select(*[F.lit(c).alias(c) for c in grid.GRAIN[:-1]], F.col("id").cast("string").alias("sample_id"), F.lit(score).alias("score_pct"))
    merged = grid.merge_results(rows(0, 50, 1.0), rows(20, 80, 2.0))
    assert sorted((int(r.sample_id), r.score_pct) for r in merged.collect()) == [(i, 1.0) for i in range(20)] + [(i, 2.0) for i in range(20, 80)]
    plan = merged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    joins = [line for line in plan.splitlines() if "Join [" in line and "sample_id" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
