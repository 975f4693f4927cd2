"""JSON-Schema tables.

``schema_nodes`` flattens every distinct schema into one row per node with ``$ref`` (walked from the root, to
the end of the chain), ``anyOf`` (single non-null member, else the first non-null one) and the
``schema_definition`` wrapper resolved.  Schemas are deduplicated by ``schema_id`` first, so a schema shared by
many samples is flattened once; one narrow pass walks each document (``functions/schema_json.py``), so there is
no limit on depth or on the length of a reference chain, and a reference that leads back to itself ends there.  A schema
that is no JSON object has no nodes (``prompts.schema_rejects`` names it).

Node columns: schema_id, spath ($.a.b, [] for array items), parent_spath, name, ftype (declared type, default
'string'; a type list is kept as its JSON text and therefore falls back to value inference), items_type,
is_array_item, required, nullable, enum ARRAY<STRING>, description, default_json, closed, depth, parts (names
from the root) and order (declared positions from the root: sorting by it lists fields as declared).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from leafwise.functions import schema_json
from leafwise.session import cut_lineage, spread

NODE_SCHEMA = ("schema_id string, spath string, parent_spath string, name string, ftype string, is_array_item boolean, "
               "required boolean, nullable boolean, enum array<string>, description string, default_json string, "
               "closed boolean, unresolved_ref boolean, declared_type string, parts array<string>, order array<int>, "
               "q1 boolean, raw_type string, raw_description string, raw_enum array<string>, raw_items_type string, "
               "depth int, items_type string, any_type boolean")


def schema_text(schemas: DataFrame):
    """The schema as text: column ``schema_text`` (keeps the declared order) or the VARIANT's (sorted) text."""
    return F.col("schema_text") if "schema_text" in schemas.columns else F.to_json("schema")


def schema_nodes(schemas: DataFrame, *columns: str) -> DataFrame:
    """schemas(schema_id, schema VARIANT or schema_text) -> one resolved row per schema node.

    ``columns``: the node columns that leave Python, all if none are named."""
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = _parse_datatype_string(NODE_SCHEMA)
    if columns:
        schema = StructType([schema[c] for c in columns])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(*(batch.column(c).to_pylist() for c in range(2))):
                for node in schema_json.nodes(text):
                    node["schema_id"] = i
                    rows.append(node)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in target], schema=target)

    distinct = schemas.select(F.col("schema_id").cast("string").alias("schema_id"), schema_text(schemas).alias("text"))
    return spread(distinct.dropDuplicates(["schema_id"])).mapInArrow(run, schema)


_SCALAR_DDL = {"string": "STRING", "integer": "BIGINT", "number": "DOUBLE", "boolean": "BOOLEAN"}


def struct_ddl(nodes: DataFrame) -> DataFrame:
    """Schema table -> Spark DDL type per schema (``STRUCT<`a`: BIGINT, ...>``), the
    typed model a ``from_json`` of one schema group needs.

    Assembled bottom-up one depth at a time: the DDL of depth d+1 nodes is
    aggregated into their parents (a shuffle on (schema_id, parent) per level,
    bounded by one schema's width).  Unknown / union types map to STRING."""
    base = nodes.select("schema_id", "spath", "parent_spath", "name", "ftype", "is_array_item", "depth")
    base = cut_lineage(base)
    max_depth = base.agg(F.max("depth")).first()[0] or 0
    scalar = F.coalesce(F.create_map(*[x for k, v in _SCALAR_DDL.items() for x in (F.lit(k), F.lit(v))])[F.col("ftype")],
                        F.lit("STRING"))
    below = None
    for d in range(max_depth, -1, -1):
        lvl = base.filter(F.col("depth") == d)
        if below is not None:
            kids = below.groupBy("schema_id", F.col("parent_spath").alias("spath")).agg(
                F.array_sort(F.collect_list(F.struct("name", "ddl", "is_array_item"))).alias("kids"))
            lvl = lvl.join(kids, ["schema_id", "spath"], "left")
        else:
            lvl = lvl.withColumn("kids", F.lit(None).cast("array<struct<name:string,ddl:string,is_array_item:boolean>>"))
        fields = F.array_join(F.transform(F.filter("kids", lambda k: ~k["is_array_item"]),
                                          lambda k: F.concat(F.lit("`"), k["name"], F.lit("`: "), k["ddl"])), ", ")
        item = F.try_element_at(F.filter("kids", lambda k: k["is_array_item"]), F.lit(1))["ddl"]
        ddl = (F.when(F.col("ftype") == "object", F.concat(F.lit("STRUCT<"), F.coalesce(fields, F.lit("")), F.lit(">")))
               .when(F.col("ftype") == "array", F.concat(F.lit("ARRAY<"), F.coalesce(item, F.lit("STRING")), F.lit(">")))
               .otherwise(scalar))
        below = cut_lineage(lvl.select("schema_id", "spath", "parent_spath", "name", "is_array_item", ddl.alias("ddl")))
    return below.filter(F.col("spath") == "$").select("schema_id", "ddl")
