"""Directory corpora as a Spark data source, and a writer for many small named files.

Layout as in ``sources/corpus.py``.  ``CorpusSource`` lists ``<root>/<domain>/<schema_name>`` only where the
filters on ``domain`` and ``schema_name`` allow it, pairs documents, gold files and schemas by name at listing
time, and hands out groups of at most ``files_per_task`` documents, one input partition each.  Paths alone pass
the driver, as with Spark's own file sources; contents are read by the tasks.

Defined results: a document without gold or without a schema is skipped; the first schema file by name counts; a
missing cached text is null; files are read as UTF-8; an empty or missing root gives no rows.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

FORMAT = "leafwise_corpus"
FIELDS = ("id string, domain string, schema_name string, stem string, source_path string, schema_text string, "
          "gold_text string, text string")
LISTED = ("domain", "schema_name")
BATCH_BYTES = 8 << 20


def filesystem(path: str):
    """File system of a path or address, and the path in it."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Documents(InputPartition):
    """A bounded group of documents: (domain, schema_name, stem, path of the schema)."""
    listed: list[tuple[str, str, str, str]]


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.texts = options.get("texts", "").rstrip("/")
        self.files_per_task = int(options.get("files_per_task", "500"))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality and membership on the folder names are settled by the listing; the rest is left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in [(c,) for c in LISTED]:
                values = set(f.value) if isinstance(f, In) else {f.value}
                column = f.attribute[0]
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def folders(self, files, parent: str, column: str) -> list[str]:
        from pyarrow import fs
        found = files.get_file_info(fs.FileSelector(parent, allow_not_found=True))
        names = sorted(i.base_name for i in found if i.type == fs.FileType.Directory)
        return [n for n in names if column not in self.wanted or n in self.wanted[column]]

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs
        files, root = filesystem(self.root)
        listed: list[tuple[str, str, str, str]] = []
        for domain in self.folders(files, root, "domain"):
            for schema in self.folders(files, posixpath.join(root, domain), "schema_name"):
                group = posixpath.join(root, domain, schema)
                schemas = sorted(i.path for i in files.get_file_info(fs.FileSelector(group)) if i.path.endswith("-schema.json"))
                inner = fs.FileSelector(posixpath.join(group, "pdf+gold"), allow_not_found=True)
                names = {i.base_name for i in files.get_file_info(inner)}
                if schemas:
                    listed += [(domain, schema, n[:-4], schemas[0]) for n in sorted(names)
                               if n.endswith(".pdf") and n[:-4] + ".gold.json" in names]
        n = self.files_per_task
        return [Documents(listed[i:i + n]) for i in range(0, len(listed), n)] or [Documents([])]

    def read(self, partition: Documents) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(self.root)
        text_files, text_root = filesystem(self.texts) if self.texts else (None, "")
        schema = pa.schema([(n.split()[0], pa.string()) for n in FIELDS.split(", ")])

        def content(where, path: str) -> str:
            with where.open_input_file(path) as f:
                return f.read().decode("utf-8")

        rows, held, schemas = [], 0, {}
        for domain, name, stem, schema_path in partition.listed:
            key = "__".join((domain, name, stem))
            base = posixpath.join(root, domain, name, "pdf+gold", stem)
            if schema_path not in schemas:
                schemas = {schema_path: content(files, schema_path)}
            text = None
            if text_files:
                try:
                    text = content(text_files, posixpath.join(text_root, key + ".txt"))
                except FileNotFoundError:
                    pass
            row = (key, domain, name, stem, base + ".pdf", schemas[schema_path], content(files, base + ".gold.json"), text)
            rows.append(row)
            held += sum(len(v or "") for v in row)
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)


class CorpusSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> DataSourceReader:
        return CorpusReader(self.options)


def read_corpus(spark: SparkSession, root: str, text_dir: str | None = None, files_per_task: int = 500) -> DataFrame:
    """One row per paired document, as ``corpus.scan_corpus`` gives them, with the texts of schema and gold."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CorpusSource)
    reader = spark.read.format(FORMAT).option("files_per_task", str(files_per_task))
    if text_dir:
        reader = reader.option("texts", text_dir)
    return reader.load(root).withColumn("schema_key", F.concat_ws("/", "domain", "schema_name"))


def write_files(files: DataFrame, root: str) -> int:
    """Writes rows (name, content) as files below ``root``, each at once: to a name of the attempt, then moved.
    A task that runs again replaces its files.  Returns the number of files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        store, base = filesystem(root)
        attempt, written = TaskContext.get().taskAttemptId(), 0
        made: set[str] = set()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = posixpath.join(base, name)
                folder = posixpath.dirname(path)
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{path}.{attempt}.part") as f:
                    f.write((content or "").encode("utf-8"))
                store.move(f"{path}.{attempt}.part", path)
                written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["written"])

    return files.select("name", "content").mapInArrow(run, "written long").agg(F.sum("written")).first()[0] or 0
