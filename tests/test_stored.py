"""Tables stored as Parquet instead of uncompressed checkpoints."""

import os

from pyspark.sql import functions as F

from leafwise.session import cut_lineage, ensure_checkpoint_dir, stored


def _bytes(spark):
    base = ensure_checkpoint_dir(spark).replace("file:", "")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(base) for f in files)


def test_stored_keeps_rows_and_takes_less_disk(spark):
    df = spark.range(20_000).select("id", F.concat(F.lit("line-"), F.lpad(F.col("id").cast("string"), 10, "0")).alias("s"),
                                    F.array(F.lit("a"), F.lit(None)).alias("f"))
    start = _bytes(spark)
    kept = stored(df)
    small = _bytes(spark) - start
    cut_lineage(df)
    assert 0 < small < _bytes(spark) - start - small
    assert kept.dtypes == df.dtypes and kept.exceptAll(df).isEmpty() and kept.count() == 20_000
