"""Merged results: only rows of cells that both inputs hold are joined."""

from leafwise.operators import grid


def test_merged_results_join_only_cells_of_both(spark):
    schema = "c string, m string, sample_id string, s double"
    old = spark.createDataFrame([("x", "1", "a", 1.0), ("x", "1", "a", 1.0), ("x", "1", "b", 2.0), ("x", "2", "a", 3.0), (None, "1", "a", 4.0),
                                 ("x", "1", None, 5.0)], schema)
    new = spark.createDataFrame([("x", "1", "a", 9.0), ("x", "3", "a", 8.0), (None, "1", "a", 7.0), ("x", "1", None, 6.0)], schema)
    merged = grid.merge_results(old, new, ["c", "m", "sample_id"])
    assert sorted(r.s for r in merged.collect()) == [2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]
    # The large side is dealt by the grain only where its cell is in both inputs.
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 2
