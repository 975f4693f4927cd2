"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.session import scratch_dir
from leafwise.sources.tables import table


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    return df.select(*columns) if columns else df


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back: the lineage ends
    there, and every executor (also one that replaces a lost one) can read the files."""
    spark = df.sparkSession
    path = scratch_dir(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """A stored table, with a broadcast hint if it has at most ``most`` rows (counted; rows must be small ones).
    Otherwise Spark joins it as it is, by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def map_columns(df: DataFrame, inputs: list[str], schema: str,
                start: Callable[[], Callable[..., dict]]) -> DataFrame:
    """Run a per-batch function over Arrow batches of ``inputs``.

    ``start()`` is called once per task and returns ``step(*columns as Python lists) -> dict of columns``
    (lists, numpy or Arrow arrays) in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    target = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = step(*[batch.column(i).to_pylist() for i in range(batch.num_columns)])
            cols = [out[f.name] for f in target]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, target)],
                schema=target)

    return df.select(*inputs).mapInArrow(run, parsed)


def held_out(doc_id, folds: int, fold: int):
    """True where crc32 of the id's decimal text leaves ``fold``; a null id is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds) == F.lit(fold), F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int,
                    max_docs: int, max_chars: int):
    """At most ``max_docs`` labelled training texts of at most ``max_chars`` characters, the first by hash of
    the id, as [(text, label)] ordered by that hash.  Of several texts under one id the one with the smallest hash
    (then the smallest text) is taken, so the sample is the same in every run.  The bound makes the broadcast and the
    collect safe."""
    ids = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
           .where(~held_out(F.col("doc_id"), folds, fold))
           .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))
    rows = (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
            .where(F.length("text") <= max_chars)
            .groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")).collect())
    rows.sort(key=lambda r: (hash_id(r.doc_id), r.doc_id))
    return [(r.text, int(r.label)) for r in rows]


def hash_id(doc_id: int) -> int:
    import zlib
    return zlib.crc32(b"order" + str(doc_id).encode())
