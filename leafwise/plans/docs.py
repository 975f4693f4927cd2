"""Document carrier: one ground-truth JSON document per order and a
deterministically perturbed prediction, both as VARIANT.

Ground truth
  {orderkey, status, priority, totalprice,
   customer: {name, segment, nation},
   items: [{part, quantity, price, flag, shipped}, ...]}   (lineitem rows, sorted)
Prediction
  status lower-cased (orderkey % 4 = 0), priority replaced (orderkey % 6 = 0),
  totalprice scaled by (100 + orderkey % 9) / 100 in integer cents, customer name
  abbreviated (custkey % 5 = 0), segment NULL (orderkey % 7 = 0), an extra
  ``comment`` key (orderkey % 10 = 0); items with linenumber % 5 = 0 dropped,
  price scaled by (50 + partkey % 7) / 50 in cents, flag lower-cased
  (partkey % 3 = 0), element order shuffled by (partkey * 31) % 97.

Building the documents is the one place this pipeline shuffles by order key
(lineitem grouped per order, joined to orders); nation is tiny and customer
is joined on its key, with AQE free to broadcast either when statistics
prove them small.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwise.functions.values import FIELD_SEP
from leafwise.sources.tables import table

SCHEMA_ID = "orders_v1"
# Fixed JSON Schema describing the carrier documents.
SCHEMA = {
    "title": "Order",
    "type": "object",
    "required": ["orderkey", "status", "items"],
    "properties": {
        "orderkey": {"type": "integer", "description": "Order number"},
        "status": {"type": "string", "description": "Order status code", "enum": ["F", "O", "P"]},
        "priority": {"type": "string", "description": "Order priority label"},
        "totalprice": {"type": "number", "description": "Total price of the order"},
        "customer": {"$ref": "#/$defs/Customer", "description": "Ordering customer"},
        "items": {"type": "array", "description": "Line items", "items": {"$ref": "#/$defs/Item"}},
    },
    "$defs": {
        "Customer": {"type": "object", "required": ["name"], "properties": {
            "name": {"type": "string", "description": "Customer name"},
            "segment": {"anyOf": [{"type": "string"}, {"type": "null"}], "description": "Market segment"},
            "nation": {"type": "string", "description": "Nation name"}}},
        "Item": {"type": "object", "required": ["part", "quantity"], "properties": {
            "part": {"type": "integer", "description": "Part key"},
            "pos": {"type": "integer", "description": "Position of the line item in the order"},
            "quantity": {"type": "integer", "description": "Quantity"},
            "price": {"type": "number", "description": "Extended price"},
            "flag": {"type": "string", "description": "Return flag", "enum": ["A", "N", "R"]},
            "shipped": {"type": "boolean", "description": "Line status is final"}}},
    },
}


def schema_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(SCHEMA_ID, json.dumps(SCHEMA))], "schema_id string, schema_text string").select(
        "schema_id", F.parse_json("schema_text").alias("schema"), "schema_text")


def _cents(c):
    return F.round(c * 100.0).cast("long")


def loose_item_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item arrays without a position to tell them apart: (doc_key, gt VARIANT array, pred VARIANT array).

    Elements are {quantity, flag, shipped}, so that several predicted items fit several items equally well; the
    prediction drops linenumber % 5 = 0, lowers the quantity by partkey % 3, lower-cases the flag at partkey % 3
    = 0 and has one or two surplus items at orderkey % 4 = 0 (so either side may be the longer one)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag",
                                                 "l_linestatus")
    pk = F.col("l_partkey")
    keys = [F.col("l_linenumber"), pk, F.col("l_quantity").cast("long").alias("q"), F.col("l_returnflag").alias("f"),
            (F.col("l_linestatus") == "F").alias("s")]
    agg = li.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct(*keys))).alias("g"),
        F.sort_array(F.collect_list(F.when(F.col("l_linenumber") % 5 != 0, F.struct(
            ((pk * 31) % 97).alias("shuffle"), *keys)))).alias("p"))
    k = F.col("l_orderkey")

    def item(q, f, s):
        return F.struct(q.alias("quantity"), f.alias("flag"), s.alias("shipped"))
    gt = F.transform("g", lambda r: item(r["q"], r["f"], r["s"]))
    pred = F.transform("p", lambda r: item(
        r["q"] - r["l_partkey"] % 3, F.when(r["l_partkey"] % 3 == 0, F.lower(r["f"])).otherwise(r["f"]), r["s"]))
    surplus = F.array(item(F.lit(1).cast("long"), F.lit("N"), F.lit(False)), item(F.lit(50).cast("long"), F.lit("A"), F.lit(True)))
    extra = F.when(k % 4 == 0, F.slice(surplus, F.lit(1), (1 + k % 8 / 4).cast("int"))).otherwise(F.slice(surplus, 1, 0))
    return agg.select(F.concat(F.lit("ord_"), k.cast("string")).alias("doc_key"),
                      F.parse_json(F.to_json(gt)).alias("gt"), F.parse_json(F.to_json(F.concat(pred, extra))).alias("pred"))


def long_item_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements (array_id, side, pos, s, f) of one array per return flag: every line item with an id of its own; the
    prediction drops linenumber % 5 = 0 and raises the quantity by partkey % 3."""
    keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
            "l_linestatus", "l_shipdate"]
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *keys)
    i = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*keys)) - 1
    li = li.withColumn("i", i).select(
        F.col("l_returnflag").alias("array_id"), (F.col("l_orderkey") * 10_000 + F.col("i")).alias("pos"), "l_linenumber", "l_partkey",
        F.col("l_quantity").cast("long").alias("q"), F.when(F.col("l_linestatus") == "F", F.lit("True")).otherwise(F.lit("False")).alias("shipped"),
        F.concat(F.lit("line-"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), F.lit("-"), F.lpad(F.col("i").cast("string"), 4, "0")).alias("id"))

    def side(number, rows, quantity):
        shown = [("id", F.col("id")), ("quantity", quantity.cast("string")), ("shipped", F.col("shipped"))]
        text = F.concat(F.lit("{"), F.array_join(F.array(*[F.concat(F.lit(k + ":"), v) for k, v in shown]), ","), F.lit("}"))
        return rows.select("array_id", F.lit(number).alias("side"), "pos", text.alias("s"),
                           F.array(*[F.concat(F.lit(k + FIELD_SEP), v) for k, v in shown]).alias("f"))
    kept = li.where("l_linenumber % 5 <> 0")
    return side(0, li, F.col("q")).unionByName(side(1, kept, F.col("q") + F.col("l_partkey") % 3))


def document_pairs(spark: SparkSession, sf_dir: str, only=None) -> DataFrame:
    """(doc_key, schema_id, gt VARIANT, pred VARIANT) for every order with its line items; ``only`` is a condition on
    o_orderkey, which reaches both scans."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                              "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    sort_cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    pk = F.col("l_partkey")
    pred_price = F.floor(_cents(F.col("l_extendedprice")) * (F.lit(50) + pk % 7) / 50)
    row = F.struct(*[F.col(x) for x in sort_cols], ((pk * 31) % 97).alias("shuffle"),
                   (pred_price.cast("double") / 100.0).alias("pred_price"))
    if only is not None:
        o = o.where(only)
        li = li.withColumnRenamed("l_orderkey", "o_orderkey").where(only).withColumnRenamed("o_orderkey", "l_orderkey")
    # one sorted list per order; an item's position in it is its unperturbed ``pos``
    items = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    gt_items = F.transform("rows", lambda r, i: F.struct(
        r["l_partkey"].alias("part"), i.cast("long").alias("pos"), r["l_quantity"].cast("long").alias("quantity"),
        r["l_extendedprice"].alias("price"), r["l_returnflag"].alias("flag"),
        (r["l_linestatus"] == "F").alias("shipped")))
    kept = F.filter(F.transform("rows", lambda r, i: F.struct(r["shuffle"].alias("shuffle"), r.alias("r"),
                                                              i.alias("i"))),
                    lambda x: x["r"]["l_linenumber"] % 5 != 0)
    pred_items = F.transform(F.array_sort(kept), lambda x: F.struct(
        x["r"]["l_partkey"].alias("part"), x["i"].cast("long").alias("pos"),
        x["r"]["l_quantity"].cast("long").alias("quantity"), x["r"]["pred_price"].alias("price"),
        F.when(x["r"]["l_partkey"] % 3 == 0, F.lower(x["r"]["l_returnflag"])).otherwise(x["r"]["l_returnflag"])
        .alias("flag"), (x["r"]["l_linestatus"] == "F").alias("shipped")))
    items = items.select("l_orderkey", gt_items.alias("g"), pred_items.alias("p"))
    k = F.col("o_orderkey")
    docs = (o.join(items, o.o_orderkey == items.l_orderkey, "left")
            .join(c, o.o_custkey == c.c_custkey, "left")
            .join(n, c.c_nationkey == n.n_nationkey, "left"))
    gt = F.struct(
        k.alias("orderkey"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("totalprice"),
        F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
                 F.col("n_name").alias("nation")).alias("customer"),
        F.coalesce(F.col("g"), F.array()).alias("items"))
    pred_total = F.floor(_cents(F.col("o_totalprice")) * (F.lit(100) + k % 9) / 100).cast("double") / 100.0
    pred = F.struct(
        k.alias("orderkey"),
        F.when(k % 4 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(k % 6 == 0, F.lit("3-MEDIUM")).otherwise(F.col("o_orderpriority")).alias("priority"),
        pred_total.alias("totalprice"),
        F.struct(F.when(F.col("o_custkey") % 5 == 0, F.regexp_replace("c_name", "Customer#", "Cust#"))
                 .otherwise(F.col("c_name")).alias("name"),
                 F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("segment"),
                 F.col("n_name").alias("nation")).alias("customer"),
        F.when(k % 10 == 0, F.lit("rush")).alias("comment"),
        F.coalesce(F.col("p"), F.array()).alias("items"))
    return docs.select(
        F.concat(F.lit("ord_"), k.cast("string")).alias("doc_key"), F.lit(SCHEMA_ID).alias("schema_id"),
        F.parse_json(F.to_json(gt)).alias("gt"),
        F.parse_json(F.to_json(pred, {"ignoreNullFields": "true"})).alias("pred"))


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primitive-array carrier: per order the part names of its items (ground truth,
    sorted like the items) and a perturbed, shuffled prediction: linenumber % 5 = 0
    dropped, an 's' appended when partkey % 4 = 0, and an extra 'spare part' for
    orderkey % 9 = 0.  (doc_key, gt VARIANT array, pred VARIANT array)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    x = li.join(part, li.l_partkey == part.p_partkey, "inner")
    sort_cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    pk = F.col("l_partkey")
    pred_name = F.when(pk % 4 == 0, F.concat("p_name", F.lit("s"))).otherwise(F.col("p_name"))
    agg = x.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in sort_cols], F.col("p_name").alias("v")))).alias("g"),
        F.sort_array(F.collect_list(F.when(F.col("l_linenumber") % 5 != 0, F.struct(
            ((pk * 31) % 97).alias("shuffle"), *[F.col(c) for c in sort_cols], pred_name.alias("v"))))).alias("p"))
    k = F.col("l_orderkey")
    extra = F.when(k % 9 == 0, F.array(F.lit("spare part"))).otherwise(F.array().cast("array<string>"))
    return agg.select(
        F.concat(F.lit("ord_"), k.cast("string")).alias("doc_key"),
        F.parse_json(F.to_json(F.transform("g", lambda e: e["v"]))).alias("gt"),
        F.parse_json(F.to_json(F.concat(F.transform("p", lambda e: e["v"]), extra))).alias("pred"))


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per event: its props object plus scalar, null and array fields."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    doc = F.struct(F.col("event_type").alias("event"), F.col("value").alias("value"),
                   F.col("user_id").alias("user"), (F.col("value") > 10).alias("flag"),
                   F.lit(None).cast("string").alias("note"), F.parse_json("props").alias("props"),
                   F.array(F.col("event_type"), (F.col("user_id") % 7).cast("string")).alias("tags"))
    return e.select("event_id", F.to_variant_object(doc).alias("doc"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw responses per order, one class per orderkey % 7: 0 plain JSON, 1 fenced,
    2 truncated, 3 empty, 4 refused (NULL + error), 5 wrapped in a list ('[]' when
    orderkey % 14 = 5), 6 orderkey of the wrong type."""
    pairs = document_pairs(spark, sf_dir)
    k = F.regexp_extract("doc_key", r"(\d+)$", 1).cast("long")
    js = F.to_json(F.col("pred"))
    c = k % 7
    raw = (F.when(c == 0, js)
           .when(c == 1, F.concat(F.lit("```json\n"), js, F.lit("\n```")))
           .when(c == 2, F.substring(js, 1, 20))
           .when(c == 3, F.lit(""))
           .when(c == 4, F.lit(None).cast("string"))
           .when(k % 14 == 5, F.lit("[]"))
           .when(c == 5, F.concat(F.lit("["), js, F.lit("]")))
           .otherwise(F.regexp_replace(js, r'"orderkey":[0-9]+', '"orderkey":"abc"')))
    err = F.when(c == 4, F.lit("Model refused: I cannot help with that"))
    return pairs.select(F.col("doc_key").alias("sample_id"), "schema_id", raw.alias("raw_response"),
                        err.alias("error"), (F.lit(100) + k % 900).cast("double").alias("latency_ms"), k.alias("k"))


def shaped_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response per order, right or wrong in one way by orderkey % 10: 0 valid; 1 null in a required field; 2 a
    nested required field missing; 3 an object where text belongs; 4 text where an object belongs; 5 an array where an
    object belongs; 6 nulls in optional fields; 7 an array element with a null and a missing required field; 8 an
    empty object; 9 null in a nullable field."""
    k = F.col("o_orderkey")
    body = F.element_at(F.array(*map(F.lit, [
        '"status":"F","items":[{"part":1,"quantity":2}]', '"status":null,"items":[]', '"status":"F","items":[],"customer":{"segment":"X"}',
        '"status":"F","items":[],"priority":{"a":1}', '"status":"F","items":[],"customer":"me"', '"status":"F","items":[],"customer":["me"]',
        '"status":"F","items":[],"customer":null,"totalprice":null', '"status":"F","items":[{"part":null}]', "",
        '"status":"F","items":[],"customer":{"name":"n","segment":null}'])), (k % 10 + 1).cast("int"))
    raw = F.when(k % 10 == 8, F.lit("{}")).otherwise(F.concat(F.lit('{"orderkey":'), k.cast("string"), F.lit(","), body, F.lit("}")))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("ord_"), k.cast("string")).alias("sample_id"), F.lit(SCHEMA_ID).alias("schema_id"),
        raw.alias("raw_response"), F.lit(None).cast("string").alias("error"))


def loose_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One valid response per order whose values have other forms than declared: the order key as text (orderkey % 3 = 0),
    with a fraction (1) or as it is; the total as text (orderkey % 4 = 0), as a number (1), in whole units (2) or
    missing; one item per return flag word of the order with text and flag words; undeclared and reserved keys."""
    k = F.col("o_orderkey")
    ks, total = k.cast("string"), F.col("o_totalprice")
    key = F.when(k % 3 == 0, F.concat(F.lit('" '), ks, F.lit('"'))).when(k % 3 == 1, F.concat(ks, F.lit(".0"))).otherwise(ks)
    price = (F.when(k % 4 == 0, F.concat(F.lit(',"totalprice":"'), total.cast("string"), F.lit('"')))
             .when(k % 4 == 1, F.concat(F.lit(',"totalprice":'), total.cast("string")))
             .when(k % 4 == 2, F.concat(F.lit(',"totalprice":'), F.floor(total).cast("string"))).otherwise(F.lit("")))
    item = F.concat(F.lit('{"zzz":[1,{"a":2}],"part":"'), (k % 100).cast("string"), F.lit('","quantity":'), (k % 50).cast("string"),
                    F.lit('.0,"shipped":"'), F.when(k % 2 == 0, F.lit("Yes")).otherwise(F.lit("0")), F.lit('"}'))
    items = F.when(k % 5 == 0, F.lit("[]")).otherwise(F.concat(F.lit("["), item, F.when(k % 5 > 2, F.concat(F.lit(","), item)).otherwise(F.lit("")), F.lit("]")))
    customer = F.when(k % 6 == 0, F.lit("")).otherwise(F.concat(
        F.lit(',"customer":{"evaluation_config":{"x":1},"name":"C'), F.col("o_custkey").cast("string"), F.lit('"'),
        F.when(k % 6 == 1, F.lit(',"nation":"A \\"B\\""')).otherwise(F.lit("")), F.lit("}")))
    raw = F.concat(F.lit('{"evaluation_config":"exact","items":'), items, F.lit(',"orderkey":'), key, F.lit(',"status":"'), F.col("o_orderstatus"),
                   F.lit('"'), price, customer, F.lit(',"comment":null}'))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("ord_"), ks).alias("sample_id"), F.lit(SCHEMA_ID).alias("schema_id"), raw.alias("raw_response"),
        F.lit(None).cast("string").alias("error"))
