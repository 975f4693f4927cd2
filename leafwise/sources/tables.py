"""Parquet table access.  Column selection happens at the call site so the
scan's ReadSchema only carries what the operator needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}; available: {', '.join(TABLES)}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
