"""Directory corpus: ``<root>/<domain>/<schema_name>/<x>-schema.json`` plus
``<root>/<domain>/<schema_name>/pdf+gold/<stem>.pdf`` and ``<stem>.gold.json``,
with cached document text ``<text_dir>/<domain>__<schema_name>__<stem>.txt``.

Each file kind is one ``wholetext`` / ``binaryFile`` scan whose keys come from
``_metadata.file_path``; pairing is plain joins (documents without gold or
without a schema are skipped; the first schema file of a group wins).  The
binary scan selects only paths, so document bytes are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GROUP = r"/([^/]+)/([^/]+)/"


def decoded(name):
    """A part of ``_metadata.file_path`` as the file is named: the path is an address, with escapes but a literal plus."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _keyed(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    path = F.col("_metadata.file_path")
    cols = [decoded(F.regexp_extract(path, pattern, i + 1)).alias(n) for i, n in enumerate(names)]
    return df.select(*cols, path.alias("path"), *[c for c in df.columns if c != "_metadata"])


def scan_corpus(spark: SparkSession, root: str, text_dir: str | None = None) -> DataFrame:
    root = root.rstrip("/")
    schemas = _keyed(spark.read.text(f"{root}/*/*/*-schema.json", wholetext=True),
                     _GROUP + r"[^/]*-schema\.json$", ["domain", "schema_name"])
    first_schema = schemas.groupBy("domain", "schema_name").agg(
        F.min_by("value", "path").alias("schema_text"))
    golds = _keyed(spark.read.text(f"{root}/*/*/pdf+gold/*.gold.json", wholetext=True),
                   _GROUP + r"pdf\+gold/([^/]+)\.gold\.json$", ["domain", "schema_name", "stem"])
    docs = _keyed(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf")
                  .load(f"{root}/*/*/pdf+gold").select("_metadata"),
                  _GROUP + r"pdf\+gold/([^/]+)\.pdf$", ["domain", "schema_name", "stem"])
    paired = (docs.join(golds.select("domain", "schema_name", "stem", F.col("value").alias("gold_text")),
                        ["domain", "schema_name", "stem"])
              .join(first_schema, ["domain", "schema_name"]))
    out = paired.select(
        F.concat_ws("__", "domain", "schema_name", "stem").alias("id"), "domain", "schema_name",
        F.concat_ws("/", "domain", "schema_name").alias("schema_key"), F.col("path").alias("source_path"),
        F.parse_json("schema_text").alias("schema"), F.parse_json("gold_text").alias("ground_truth"))
    if text_dir:
        texts = spark.read.text(f"{text_dir.rstrip('/')}/*.txt", wholetext=True).select(
            decoded(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.txt$", 1)).alias("id"),
            F.col("value").alias("text"))
        out = out.join(texts, "id", "left")
    else:
        out = out.withColumn("text", F.lit(None).cast("string"))
    return out


def scan_keyed_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """Multi-file text scan keyed by file stem (e.g. ``resumes/resume_*.md``)."""
    return spark.read.text(pattern, wholetext=True).select(
        decoded(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.[^./]+$", 1)).alias("stem"),
        F.col("value").alias("text"))
