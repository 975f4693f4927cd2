"""Run sink that appears at once: data first, then one manifest.

A run's rows go to a folder of their own below ``<root>/<run_id>/``; the manifest, written last and moved into place
by a rename, names that folder, its files and the number of rows.  Readers look at manifests only, so a write that
fails or is still going on is invisible, and writing a run again replaces it in one step (the old folder stays until
``drop_replaced``).  All paths go through Spark's file systems.
"""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.session import open_writers

MANIFEST = "manifest.json"
OPEN_FILE_BYTES = 8 << 20       # what an open file of a run holds back until it is written out


def run_name(dataset: str, when: datetime.datetime | None = None) -> str:
    return f"{dataset}_{(when or datetime.datetime.now()):%Y%m%d_%H%M%S}"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list:
    _, p, fs = _files(spark, path)
    return list(fs.listStatus(p)) if fs.exists(p) else []


def _publish(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside ``path`` and renames it into place."""
    jvm, target, fs = _files(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"cannot publish {path}")


def write_run(results: DataFrame, root: str, run_id: str) -> dict:
    """Stores all rows of a run and publishes it; returns its manifest."""
    spark = results.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    path = f"{root}/{run_id}/{folder}"
    # Sorted by one number, not by two texts row against row; a task's modes then come one after another.
    with open_writers(spark):
        results.sortWithinPartitions(F.xxhash64("framework", "mode")).write.partitionBy("framework", "mode").option("parquet.block.size", OPEN_FILE_BYTES).parquet(path)
    rows = spark.read.schema(results.schema).parquet(path).count()
    _, p, fs = _files(spark, path)
    found, files = fs.listFiles(p, True), []
    while found.hasNext():
        s = found.next()
        if s.getPath().getName().startswith("part-"):
            files.append([str(s.getPath().toString()).split(f"/{folder}/", 1)[1], s.getLen()])
    manifest = {"run_id": run_id, "folder": folder, "rows": rows, "files": sorted(files)}
    _publish(spark, f"{root}/{run_id}/{MANIFEST}", json.dumps(manifest))
    return manifest


def published_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, folder, rows, files) of the runs that are there, newest first."""
    paths = [f"{root}/{s.getPath().getName()}/{MANIFEST}" for s in _listed(spark, root)
             if s.isDirectory() and any(x.getPath().getName() == MANIFEST for x in _listed(spark, f"{root}/{s.getPath().getName()}"))]
    schema = "run_id string, folder string, rows long, files array<array<string>>"
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(paths).orderBy(F.desc("run_id"))


def read_runs(spark: SparkSession, root: str, schema, run_ids: list[str] | None = None) -> DataFrame:
    """All rows of the published runs (or of some), with ``_source``: the run they come from."""
    runs = [r for r in published_runs(spark, root).collect() if run_ids is None or r.run_id in run_ids]
    frames = [spark.read.schema(schema).parquet(f"{root}/{r.run_id}/{r.folder}").withColumn("_source", F.lit(r.run_id)) for r in runs]
    if not frames:
        return spark.createDataFrame([], schema).withColumn("_source", F.lit(None).cast("string"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def drop_replaced(spark: SparkSession, root: str) -> int:
    """Deletes data folders that no manifest names; call it when no write is going on.  Returns their number."""
    named = {(r.run_id, r.folder) for r in published_runs(spark, root).collect()}
    gone = 0
    for run in _listed(spark, root):
        for s in _listed(spark, run.getPath().toString()):
            if s.isDirectory() and (run.getPath().getName(), s.getPath().getName()) not in named:
                _files(spark, root)[2].delete(s.getPath(), True)
                gone += 1
    return gone
