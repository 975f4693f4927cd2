"""Operator 13, exact duplicates by Patricia tries.

A text is normalised (each run of white space becomes one space) and keyed by its length and content hash.  Every
task inserts the full byte strings of its rows into a compressed radix trie whose keys are the length, the hash
and then the text; a terminal holds the smallest identifier that reached it and the number of rows.  These local
classes, one row for all equal texts of a task, are stored with the rows' class numbers.  Only classes are then
dealt by length and hash: a task inserts their byte strings, in the order of length and hash, into a trie of its
own, and the terminal a class ends in names its owner.  Two texts meet in a terminal only if all their bytes are
equal, whatever their hashes are.

Memory is bounded by spilling subtrees.  A task that makes local classes gives away its largest subtrees when the
trie's labels pass ``resident_bytes``; an equal text that comes later opens another class.  In the second step rows
arrive sorted, so every subtree below the current length and hash is complete and can go.

A group of any size is one row per task after the first step.  Rows of groups are joined to their classes by class
number, which a class shares only with rows of its own task; rows that are alone in their class need no join.

Defined results: null texts count as empty; of equal texts the row with the smallest doc_id stays, a null doc_id
only where all are null; of several rows equal in text and doc_id one stays; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.llm.common import documents, saved

WHITE = r"[\x20\x09-\x0D]+"
RESIDENT_BYTES = 64 << 20
BATCH_BYTES, BATCH_ROWS = 4 << 20, 10_000       # what a task hands on at a time
KEY = ">Iq"                 # length and content hash, ahead of the text
LOCAL = "class_id long, place int, doc_id long, rows long, lead int, size int, hash long, text binary, sha string"
OWNED = "class_id long, doc_id long, rows long, keep_id long, group_size long, lead int, sha string"


class Node:
    """A state of the trie: the bytes on the edge into it, its children by first byte, what ends in it."""

    __slots__ = ("label", "children", "end")

    def __init__(self, label: bytes):
        self.label, self.children, self.end = label, {}, None


def common_prefix(a: bytes, b: bytes) -> int:
    """Number of leading bytes that are equal, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Compressed radix trie over byte strings."""

    def __init__(self):
        self.root, self.resident = Node(b""), 0

    def terminal(self, key: bytes) -> Node:
        """The node that ``key`` ends in, made if there is none; ``end`` is None in a new one."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.resident += len(child.label)
                return child
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            shared = common_prefix(child.label, key[at:at + len(child.label)])
            fork = Node(child.label[:shared])
            child.label = child.label[shared:]
            fork.children[child.label[0]] = child
            node.children[fork.label[0]] = fork
            node, at = fork, at + shared
        return node

    @staticmethod
    def ends(top: Node, before: bytes = b"") -> Iterator[tuple[bytes, object]]:
        """(key, end) of every terminal of a subtree; ``before`` is what leads to its edge."""
        todo = [(top, before)]
        while todo:
            node, key = todo.pop()
            key += node.label
            if node.end is not None:
                yield key, node.end
            todo.extend((child, key) for child in node.children.values())

    @staticmethod
    def size(top: Node) -> int:
        """Bytes on the edges of a subtree."""
        total, todo = 0, [top]
        while todo:
            node = todo.pop()
            total += len(node.label)
            todo.extend(node.children.values())
        return total

    def spill(self, leave: int = 0) -> Iterator[tuple[bytes, object]]:
        """Cuts subtrees, the largest first, until at most ``leave`` bytes of labels are left (0: the whole trie);
        yields what ended in them.  Where all keys share a beginning, the subtrees after it are cut."""
        if leave == 0:
            yield from self.ends(self.root)
            self.root, self.resident = Node(b""), 0
            return
        top, before = self.root, b""
        while len(top.children) == 1 and top.end is None:
            top = next(iter(top.children.values()))
            before += top.label
        sizes = {b: self.size(child) for b, child in top.children.items()}
        for b in sorted(sizes, key=lambda b: (-sizes[b], b)):
            if self.resident <= leave:
                return
            yield from self.ends(top.children.pop(b), before)
            self.resident -= sizes[b]


class Rows:
    """Collects output rows and gives them out in record batches of bounded size."""

    def __init__(self, target: pa.Schema):
        self.target, self.rows, self.held = target, [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += size
        if self.held > BATCH_BYTES or len(self.rows) >= BATCH_ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.target)],
                                             schema=self.target)
        self.rows, self.held = [], 0


def schemas(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    schema = _parse_datatype_string(ddl)
    return schema, to_arrow_schema(schema)


def smaller(a: int | None, b: int | None) -> bool:
    """Whether identifier a comes before b; null comes last."""
    return a is not None and (b is None or a < b)


def local_classes(docs: DataFrame, resident_bytes: int = RESIDENT_BYTES) -> DataFrame:
    """Two kinds of rows.  Classes: class_id, doc_id (the smallest), rows, lead (place of the smallest among them),
    size, hash, text, sha.  Members of classes with several rows: class_id, place, doc_id."""
    schema, target = schemas(LOCAL)
    text = F.regexp_replace(F.coalesce("text", F.lit("")), WHITE, " ")
    keyed = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
             .select("doc_id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("hash"),
                     F.col("text").cast("binary").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 33
        trie = PatriciaTrie()
        out = Rows(target)

        def spilled(leave: int) -> Iterator[pa.RecordBatch]:
            for key, (c, doc, n, lead) in trie.spill(leave):
                size, content_hash = struct.unpack_from(KEY, key)
                text = key[struct.calcsize(KEY):]
                yield from out.add((c, None, doc, n, lead, size, content_hash, text, hashlib.sha256(text).hexdigest()), size)

        for batch in batches:
            for doc, size, content_hash, text in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                node = trie.terminal(struct.pack(KEY, size, content_hash) + text)
                if node.end is None:
                    node.end = [number, doc, 1, 0]
                    number += 1
                    if trie.resident > resident_bytes:
                        yield from spilled(resident_bytes // 2)
                    continue
                c, least, n, lead = end = node.end
                if n == 1:
                    yield from out.add((c, 0, least, *[None] * 6))
                yield from out.add((c, n, doc, *[None] * 6))
                if smaller(doc, least):
                    end[1], end[3] = doc, n
                end[2] = n + 1
        yield from spilled(0)
        yield from out.rest()

    return keyed.mapInArrow(run, schema)


def owners(classes: DataFrame, resident_bytes: int = RESIDENT_BYTES) -> DataFrame:
    """For every class its group's smallest identifier and size; ``lead`` stays only in the class that holds it."""
    schema, target = schemas(OWNED)
    names = ("size", "hash", "text", "class_id", "doc_id", "rows", "lead", "sha")
    dealt = classes.select(*names).repartition("size", "hash").sortWithinPartitions("size", "hash", "class_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, current = PatriciaTrie(), b""
        out = Rows(target)

        def spilled() -> Iterator[pa.RecordBatch]:
            for _, (keep, total, owner, classes) in trie.spill():
                for c, doc, n, lead, sha in classes:
                    yield from out.add((c, doc, n, keep, total, lead if c == owner else None, sha))

        for batch in batches:
            for size, content_hash, text, c, doc, n, lead, sha in zip(*[batch.column(i).to_pylist() for i in range(8)]):
                key = struct.pack(KEY, size, content_hash)
                if key != current and trie.resident > resident_bytes:
                    yield from spilled()
                current = key
                node = trie.terminal(key + text)
                if node.end is None:
                    node.end = [doc, n, c, [(c, doc, n, lead, sha)]]
                    continue
                end = node.end
                if smaller(doc, end[0]):
                    end[0], end[2] = doc, c
                end[1] += n
                end[3].append((c, doc, n, lead, sha))
        yield from spilled()
        yield from out.rest()

    return dealt.mapInArrow(run, schema)


def exact_dedup(docs: DataFrame, resident_bytes: int = RESIDENT_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    stored = saved(local_classes(docs, resident_bytes), "texts")
    owned = saved(owners(stored.where("rows is not null"), resident_bytes), "owners")
    result = [F.col("doc_id"), "keep_id", "group_size", F.col("kept"), F.col("sha").alias("text_sha256")]
    alone = owned.where("rows = 1").withColumn("kept", F.col("lead").isNotNull()).select(*result)
    members = stored.where("rows is null").select("class_id", "place", "doc_id")
    several = owned.where("rows > 1").drop("doc_id")
    joined = (members.join(several, "class_id").withColumn("kept", F.coalesce(F.col("place") == F.col("lead"), F.lit(False)))
              .select(*result))
    return alone.unionByName(joined)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir, "doc_id", "text"))


Q = {"op13_exact_dedup": op13_exact_dedup}
SQL = {"op13_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
  FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM t"""}
