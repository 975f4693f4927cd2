"""Runs are written by mode without a sort of texts."""

from leafwise.session import open_writers
from leafwise.sources import runs


def test_runs_are_written_by_mode_without_a_sort_of_texts(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i % 2}", f"m{i % 3}", i) for i in range(60)], "framework string, mode string, x int").coalesce(1)
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    with open_writers(spark, 4):
        assert spark.conf.get(name) == "4"
    told = runs.write_run(rows, str(tmp_path), "r")
    assert spark.conf.get(name) == before
    assert told["rows"] == 60 and len(told["files"]) == 6
    back = runs.read_runs(spark, str(tmp_path), rows.schema)
    assert sorted((r.framework, r.mode, r.x) for r in back.collect()) == sorted((r.framework, r.mode, r.x) for r in rows.collect())
