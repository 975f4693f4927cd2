"""Test-grid expansion and resume (incremental re-run) operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.session import small_side

GRAIN = ["dataset", "model", "combination", "framework", "mode", "sample_id"]


def expand_grid(samples: DataFrame, catalogue: Column) -> DataFrame:
    """samples × (combination, mode) cells as a narrow ``explode`` of the bounded
    literal catalogue: no join, no shuffle, row count = product."""
    return samples.select("*", F.explode(catalogue).alias("_cell")).select("*", "_cell.*").drop("_cell")


def remaining_work(grid: DataFrame, completed: DataFrame) -> DataFrame:
    """Cells whose (framework, mode) is not completed yet (left anti join)."""
    done = completed.select("framework", "mode").distinct()     # AQE broadcasts it when runtime size is small
    return grid.join(done, ["framework", "mode"], "left_anti")


def skipped_work(grid: DataFrame, completed: DataFrame) -> DataFrame:
    done = completed.select("framework", "mode").distinct()
    return grid.join(done, ["framework", "mode"], "left_semi")


def restrict_to_saved(samples: DataFrame, saved_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Keep the samples of a saved run (left semi join on the saved id list)."""
    return samples.join(saved_ids.select(F.col("sample_id").alias(id_col)).distinct(), id_col, "left_semi")


def missing_saved(samples: DataFrame, saved_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Saved ids that the reloaded source no longer has (the count-mismatch warning)."""
    return saved_ids.select("sample_id").distinct().join(
        samples.select(F.col(id_col).alias("sample_id")), "sample_id", "left_anti")


def merge_results(old: DataFrame, new: DataFrame, grain: list[str] = GRAIN) -> DataFrame:
    """Old ∪ new result rows; on a grain collision the new row wins.

    Rows can only collide in cells (the grain without its last key) that both inputs hold; there are few cells, so they
    are found first and broadcast.  Old rows of other cells stay where they are; the rest are removed with an anti join
    on the grain, against the new rows of the same cells.  The new rows are many and compress well, so their shuffled
    size says little about what a hash table of them would take: they are sorted, never sent through the driver."""
    cells = grain[:-1]
    if not cells:
        return old.join(new.select(*grain).hint("merge"), grain, "left_anti").unionByName(new, allowMissingColumns=True)
    both = small_side(old.select(*cells).distinct().join(new.select(*cells).distinct(), cells))
    apart = old.join(both, cells, "left_anti")
    met = old.join(both, cells, "left_semi").join(new.join(both, cells, "left_semi").select(*grain).hint("merge"), grain, "left_anti")
    return apart.unionByName(met).unionByName(new, allowMissingColumns=True)


def ground_truth_or_empty(rows: DataFrame, truths: DataFrame, key: str) -> DataFrame:
    """Each row with its document's ground truth (VARIANT), ``{}`` where there is none."""
    return rows.join(truths.select(key, "ground_truth"), key, "left").withColumn(
        "ground_truth", F.coalesce("ground_truth", F.parse_json(F.lit("{}"))))
