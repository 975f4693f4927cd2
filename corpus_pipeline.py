"""A corpus from documents to training sequences, in five stages.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the
last return the columns of documents.  Stages are written as Parquet and read again by the next one.

Defined results follow the operators' own docstrings.  Rows are matched to verdicts by doc_id and a hash of
the text (and language and source where the verdict depends on them), so repeated ids do not mix; of rows that
are equal in doc_id and text, the near-duplicate stage keeps one, except rows without words, which all stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.llm import jaccard_join, packing, quality_rules, secret_scan, toxicity
from leafwise.llm.common import documents, map_columns, saved
from leafwise.session import ship_package
from leafwise.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TOXIC_FROM = 0.7


def matching(docs: DataFrame, keys: DataFrame, names: list[str], how: str) -> DataFrame:
    """Rows of docs (with text_hash) whose ``names`` are (left_semi) or are not (left_anti) among the keys."""
    right = keys.select(*[F.col(n).alias(f"k_{n}") for n in names]).distinct()
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"k_{n}"))
    return docs.withColumn("text_hash", F.xxhash64("text")).join(right, same, how)


def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ship_package(spark)
    rejected = quality_rules.quality_rules(docs).where(~F.col("kept"))
    return matching(docs, rejected, ["doc_id", "text_hash", "lang", "source"], "left_anti").select(*COLUMNS)


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of ``TOXIC_FROM`` or more go."""
    ship_package(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    shared = spark.sparkContext.broadcast(model)

    def start():
        m = shared.value

        def step(*columns):
            keep = [score < TOXIC_FROM for score, _ in m.score_all(columns[1])]
            return {n: [v for v, k in zip(c, keep) if k] for n, c in zip(COLUMNS, columns)}
        return step
    return map_columns(docs, COLUMNS, SCHEMA, start)


def stage_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    ship_package(spark)
    joined = jaccard_join.jaccard_join(docs)
    head = F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("text_hash").eqNullSafe(F.col("kept_text"))
    # Rows that go: not the head of their group; and all but one of several equal heads.
    marked = saved(joined.groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("rows"), F.max(head).alias("head"), F.max("n_shingles").alias("words")), "heads")
    names = ["doc_id", "text_hash"]
    once = matching(docs, marked.where(~F.col("head") | ((F.col("rows") > 1) & (F.col("words") > 0))), names, "left_anti")
    several = marked.where(F.col("head") & (F.col("rows") > 1) & (F.col("words") > 0))
    if several.limit(1).count() == 0:
        return once.select(*COLUMNS)
    one = matching(docs, several, names, "left_semi").dropDuplicates(names)
    return once.select(*COLUMNS).unionByName(one.select(*COLUMNS))


def stage_secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets inside texts are replaced by their kind."""
    ship_package(spark)
    return secret_scan.redact(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    ship_package(spark)
    return packing.digest(packing.pack_documents(docs))


STAGES = [("quality_rules", stage_quality_rules), ("toxicity", stage_toxicity), ("jaccard_join", stage_jaccard_join),
          ("secret_scan", stage_secret_scan), ("packing", stage_packing)]

#: Trained models and retrieval packing have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
