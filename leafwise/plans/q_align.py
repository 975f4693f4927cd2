"""Document alignment and scoring queries over the order-document carrier."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from leafwise.operators import align, boards, sparse_match
from leafwise.operators.schema import schema_nodes
from leafwise.plans import docs
from leafwise.session import spread, stored

Q: dict = {}
SQL: dict = {}


def q(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


def _nodes(spark):
    return schema_nodes(docs.schema_table(spark))


@q("doc_score")
def doc_score(spark, sf):
    pairs = docs.document_pairs(spark, sf)
    return align.document_scores(pairs, _nodes(spark))


# --- oracle SQL -----------------------------------------------------------------
def ned_sql(a: str, b: str) -> str:
    return (f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1.0 - "
            f"CAST(levenshtein({a}, {b}) AS DOUBLE) / CAST(greatest(length({a}), length({b})) AS DOUBLE) END)")


def num_sql(a: str, p: str) -> str:
    rel = f"(abs(({a}) - ({p})) / abs({a}))"
    return (f"(CASE WHEN ({a}) IS NULL OR ({p}) IS NULL THEN 0.0 WHEN ({a}) = ({p}) THEN 1.0 "
            f"WHEN ({a}) = 0 THEN (CASE WHEN abs({p}) <= 0.05 THEN 1.0 ELSE 0.0 END) "
            f"WHEN {rel} <= 0.05 THEN 1.0 ELSE greatest(0.0, 1.0 - ({rel} - CAST(0.05 AS DOUBLE)) / "
            f"CAST(0.95 AS DOUBLE)) END)")


def _price_str(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def _stable_item(p: str) -> str:
    return (f"'{{flag:' || {p}flag || ',part:' || CAST({p}part AS VARCHAR) || ',pos:' || CAST({p}pos AS VARCHAR) "
            f"|| ',price:' || {_price_str(p + 'price')} "
            f"|| ',quantity:' || CAST({p}qty AS VARCHAR) || ',shipped:' || "
            f"(CASE WHEN {p}shipped THEN 'True' ELSE 'False' END) || '}}'")


_ORDER_COLS = ("l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, "
               "l_returnflag, l_linestatus, l_shipdate")

DOCS_CTE = f"""
li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER_COLS}) - 1 AS i FROM lineitem),
gi AS (SELECT l_orderkey AS ok, i, i AS pos, l_partkey AS part, CAST(l_quantity AS BIGINT) AS qty, l_extendedprice AS price,
              l_returnflag AS flag, l_linestatus = 'F' AS shipped FROM li),
pi AS (SELECT l_orderkey AS ok,
              row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_partkey * 31) % 97, {_ORDER_COLS}, i) - 1 AS j,
              i AS pos, l_partkey AS part, CAST(l_quantity AS BIGINT) AS qty,
              CAST(floor(CAST(CAST(round(l_extendedprice * 100.0) AS BIGINT) * (50 + l_partkey % 7) AS DOUBLE) / 50)
                   AS DOUBLE) / 100.0 AS price,
              CASE WHEN l_partkey % 3 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AS flag,
              l_linestatus = 'F' AS shipped
       FROM li WHERE l_linenumber % 5 <> 0),
gs AS (SELECT *, {_stable_item('')} AS s FROM gi),
ps AS (SELECT *, {_stable_item('')} AS s FROM pi),
nm AS (SELECT ok, count(*) AS n FROM gi GROUP BY ok),
mm AS (SELECT ok, count(*) AS m FROM pi GROUP BY ok),
w AS (SELECT g.ok, g.i, p.j,
             (CASE WHEN g.flag = p.flag THEN 1 ELSE 0 END) + (CASE WHEN g.part = p.part THEN 1 ELSE 0 END)
             + (CASE WHEN {_price_str('g.price')} = {_price_str('p.price')} THEN 1 ELSE 0 END)
             + (CASE WHEN g.qty = p.qty THEN 1 ELSE 0 END) + (CASE WHEN g.shipped = p.shipped THEN 1 ELSE 0 END)
             + (CASE WHEN g.pos = p.pos THEN 1 ELSE 0 END) AS cnt,
             (CASE WHEN g.flag = p.flag THEN length(g.flag) ELSE 0 END)
             + (CASE WHEN g.part = p.part THEN length(CAST(g.part AS VARCHAR)) ELSE 0 END)
             + (CASE WHEN {_price_str('g.price')} = {_price_str('p.price')} THEN length({_price_str('g.price')}) ELSE 0 END)
             + (CASE WHEN g.qty = p.qty THEN length(CAST(g.qty AS VARCHAR)) ELSE 0 END)
             + (CASE WHEN g.shipped = p.shipped THEN length(CASE WHEN g.shipped THEN 'True' ELSE 'False' END) ELSE 0 END)
             + (CASE WHEN g.pos = p.pos THEN length(CAST(g.pos AS VARCHAR)) ELSE 0 END)
               AS len,
             levenshtein(g.s, p.s) AS lev
      FROM gs g JOIN ps p ON g.ok = p.ok),
wt AS (SELECT w.*, (CAST(cnt AS DOUBLE) * 1000.0 + CAST(len AS DOUBLE)) - CAST(lev AS DOUBLE) * 0.1 AS wgt,
              nm.n, mm.m FROM w JOIN nm USING (ok) JOIN mm USING (ok)),
by_col AS (SELECT ok, i, j FROM (SELECT ok, i, j, n, m,
              row_number() OVER (PARTITION BY ok, j ORDER BY wgt DESC, i) AS r FROM wt) WHERE r = 1 AND n > m),
by_row AS (SELECT ok, i, j FROM (SELECT ok, i, j, n, m,
              row_number() OVER (PARTITION BY ok, i ORDER BY wgt DESC, j) AS r FROM wt) WHERE r = 1 AND n <= m),
mt AS (SELECT * FROM by_col UNION ALL SELECT * FROM by_row),
pairs_m AS (SELECT g.ok, g.i, g.pos AS gpos, p.pos AS ppos, g.part AS gpart, p.part AS ppart, g.qty AS gqty, p.qty AS pqty, g.price AS gprice,
                   p.price AS pprice, g.flag AS gflag, p.flag AS pflag, g.shipped AS gsh, p.shipped AS psh
            FROM mt JOIN gi g ON g.ok = mt.ok AND g.i = mt.i JOIN pi p ON p.ok = mt.ok AND p.j = mt.j),
item_leaves AS (
  SELECT ok, '$.items[' || CAST(i AS VARCHAR) || '].part' AS path, {num_sql('gpart', 'ppart')} AS sc FROM pairs_m
  UNION ALL SELECT ok, '$.items[' || CAST(i AS VARCHAR) || '].pos',
         {num_sql('CAST(gpos AS DOUBLE)', 'CAST(ppos AS DOUBLE)')} FROM pairs_m
  UNION ALL SELECT ok, '$.items[' || CAST(i AS VARCHAR) || '].quantity',
         {num_sql('CAST(gqty AS DOUBLE)', 'CAST(pqty AS DOUBLE)')} FROM pairs_m
  UNION ALL SELECT ok, '$.items[' || CAST(i AS VARCHAR) || '].price', {num_sql('gprice', 'pprice')} FROM pairs_m
  UNION ALL SELECT ok, '$.items[' || CAST(i AS VARCHAR) || '].flag', {ned_sql('gflag', 'pflag')} FROM pairs_m
  UNION ALL SELECT ok, '$.items[' || CAST(i AS VARCHAR) || '].shipped',
         CASE WHEN gsh = psh THEN 1.0 ELSE 0.0 END FROM pairs_m
  UNION ALL SELECT g.ok, '$.items[' || CAST(g.i AS VARCHAR) || '].' || f.x, 0.0 FROM gi g,
         (SELECT unnest(['flag', 'part', 'pos', 'price', 'quantity', 'shipped']) AS x) f
         WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.ok = g.ok AND mt.i = g.i)
  UNION ALL SELECT p.ok, '$.items[' || CAST(nm.n + p.j AS VARCHAR) || '].' || f.x, 0.0 FROM pi p JOIN nm ON nm.ok = p.ok,
         (SELECT unnest(['flag', 'part', 'pos', 'price', 'quantity', 'shipped']) AS x) f
         WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.ok = p.ok AND mt.j = p.j)),
od AS (SELECT o.o_orderkey AS ok, o.o_orderstatus AS st, o.o_orderpriority AS pr, o.o_totalprice AS tp,
              c.c_name AS cn, c.c_mktsegment AS cs, n.n_name AS nn, o.o_custkey AS ck
       FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
       LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
top_leaves AS (
  SELECT ok, '$.orderkey' AS path, 1.0 AS sc FROM od
  UNION ALL SELECT ok, '$.status', {ned_sql('st', "CASE WHEN ok % 4 = 0 THEN lower(st) ELSE st END")} FROM od
  UNION ALL SELECT ok, '$.priority', {ned_sql('pr', "CASE WHEN ok % 6 = 0 THEN '3-MEDIUM' ELSE pr END")} FROM od
  UNION ALL SELECT ok, '$.totalprice', {num_sql('tp', 'CAST(floor(CAST(CAST(round(tp * 100.0) AS BIGINT) * (100 + ok % 9) AS DOUBLE) / 100) AS DOUBLE) / 100.0')} FROM od
  UNION ALL SELECT ok, '$.customer.name', {ned_sql('cn', "CASE WHEN ck % 5 = 0 THEN replace(cn, 'Customer#', 'Cust#') ELSE cn END")} FROM od
  UNION ALL SELECT ok, '$.customer.segment', CASE WHEN ok % 7 = 0 THEN 0.0 ELSE 1.0 END FROM od
  UNION ALL SELECT ok, '$.customer.nation', 1.0 FROM od
  UNION ALL SELECT ok, '$.comment', 0.0 FROM od WHERE ok % 10 = 0),
all_leaves AS (SELECT * FROM top_leaves UNION ALL SELECT * FROM item_leaves)
"""

SQL["doc_score"] = f"""
WITH {DOCS_CTE}
SELECT 'ord_' || CAST(ok AS VARCHAR) AS doc_key, round(sum(sc), 2) AS total, CAST(count(*) AS DOUBLE) AS max,
       round(sum(sc) / count(*) * 100.0, 1) AS pct
FROM all_leaves GROUP BY ok"""


# --- more alignment queries ---------------------------------------------------------
from leafwise.functions import leaf as LF  # noqa: E402
from leafwise.functions.values import as_array, as_map, vtype  # noqa: E402
from leafwise.operators.flatten import flatten_json  # noqa: E402
from leafwise.sources.tables import table  # noqa: E402


@q("leaf_ned")
def leaf_ned(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name"))
    return p.join(nxt, "p_partkey").select("p_partkey", LF.ned(F.col("p_name"), F.col("next_name")).alias("sim"))


SQL["leaf_ned"] = f"""
SELECT a.p_partkey, {ned_sql('a.p_name', 'b.p_name')} AS sim FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"""


@q("leaf_number")
def leaf_number(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    q_pred = F.col("l_quantity") * (F.lit(100) + F.col("l_orderkey") % 41 - 20) / 100.0
    return li.select("l_orderkey", "l_linenumber",
                     LF.number_score_d(F.col("l_discount"), F.col("l_tax")).alias("s_rate"),
                     LF.number_score_d(F.col("l_quantity"), q_pred).alias("s_qty"))


SQL["leaf_number"] = f"""
SELECT l_orderkey, l_linenumber, {num_sql('l_discount', 'l_tax')} AS s_rate,
       {num_sql('l_quantity', 'l_quantity * (100 + l_orderkey % 41 - 20) / 100.0')} AS s_qty FROM lineitem"""


def _vpair(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                          "o_orderpriority")
    k = F.col("o_orderkey")
    doc = F.to_variant_object(F.struct(
        F.col("o_orderpriority").alias("s1"),
        F.when(k % 6 == 0, F.lower("o_orderpriority")).otherwise(F.concat(F.lit(" "), F.col("o_orderpriority")))
        .alias("s2"),
        F.col("o_totalprice").alias("n1"), (F.col("o_totalprice") * (F.lit(100) + k % 13) / 100.0).alias("n2"),
        F.col("o_custkey").alias("i1"), (F.col("o_custkey") + k % 3).alias("i2"),
        (F.col("o_orderstatus") == "F").alias("b1"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.col("o_orderstatus")).alias("b2")))
    return o.select("o_orderkey", doc.alias("d"))


@q("leaf_boolean")
def leaf_boolean(spark, sf):
    d = _vpair(spark, sf)
    m = as_map(F.col("d"))
    return d.select("o_orderkey", LF.boolean_score(m["b1"], m["b2"]).alias("s_bool"),
                    LF.boolean_score(m["i1"], m["b1"]).alias("s_num_bool"))


SQL["leaf_boolean"] = """
SELECT o_orderkey,
       CASE WHEN (o_orderstatus = 'F') = (CASE WHEN o_orderkey % 5 = 0 THEN false ELSE length(o_orderstatus) > 0 END)
            THEN 1.0 ELSE 0.0 END AS s_bool,
       CASE WHEN (o_custkey <> 0) = (o_orderstatus = 'F') THEN 1.0 ELSE 0.0 END AS s_num_bool
FROM orders"""


@q("leaf_dispatch")
def leaf_dispatch(spark, sf):
    d = _vpair(spark, sf)
    m = as_map(F.col("d"))
    k = F.col("o_orderkey") % 4
    ftype = (F.when(k == 0, F.lit("string")).when(k == 1, F.lit("number")).when(k == 2, F.lit("integer"))
             .otherwise(F.lit("boolean")))
    a = F.when(k == 0, m["s1"]).when(k == 1, m["n1"]).when(k == 2, m["i1"]).otherwise(m["b1"])
    p = F.when(k == 0, m["s2"]).when(k == 1, m["n2"]).when(k == 2, m["i2"]).otherwise(m["b2"])
    rows = d.select("o_orderkey", ftype.alias("ftype"), a.alias("a"), p.alias("p"))
    rows = rows.withColumns({"at": vtype(F.col("a")), "pt": vtype(F.col("p"))})
    return rows.select("o_orderkey", "ftype", LF.leaf_score(*map(F.col, ("a", "p", "ftype", "at", "pt"))).alias("score"))


_s2 = "CASE WHEN o_orderkey % 6 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END"
SQL["leaf_dispatch"] = f"""
SELECT o_orderkey,
       CASE o_orderkey % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'number' WHEN 2 THEN 'integer' ELSE 'boolean' END AS ftype,
       CASE o_orderkey % 4
         WHEN 0 THEN {ned_sql('o_orderpriority', _s2)}
         WHEN 1 THEN {num_sql('o_totalprice', 'o_totalprice * (100 + o_orderkey % 13) / 100.0')}
         WHEN 2 THEN {num_sql('CAST(o_custkey AS DOUBLE)', 'CAST(o_custkey + o_orderkey % 3 AS DOUBLE)')}
         ELSE CASE WHEN (o_orderstatus = 'F') = (CASE WHEN o_orderkey % 5 = 0 THEN false
                                                     ELSE length(o_orderstatus) > 0 END) THEN 1.0 ELSE 0.0 END
       END AS score
FROM orders"""


@q("doc_score_degenerate")
def doc_score_degenerate(spark, sf):
    pairs = docs.document_pairs(spark, sf)
    k = F.regexp_extract("doc_key", r"(\d+)$", 1).cast("long")
    pred = (F.when(k % 8 == 0, F.lit(None).cast("variant"))
            .when(k % 8 == 1, F.parse_json(F.lit("{}"))).otherwise(F.col("pred")))
    return align.document_scores(pairs.withColumn("pred", pred), _nodes(spark))


SQL["doc_score_degenerate"] = f"""
WITH {DOCS_CTE},
nitems AS (SELECT o.o_orderkey AS ok, COALESCE(nm.n, 0) AS n FROM orders o LEFT JOIN nm ON nm.ok = o.o_orderkey),
normal AS (SELECT ok, round(sum(sc), 2) AS total, CAST(count(*) AS DOUBLE) AS max,
                  round(sum(sc) / count(*) * 100.0, 1) AS pct FROM all_leaves GROUP BY ok)
SELECT 'ord_' || CAST(ok AS VARCHAR) AS doc_key,
       CASE WHEN ok % 8 IN (0, 1) THEN 0.0 ELSE total END AS total,
       CASE WHEN ok % 8 IN (0, 1) THEN CAST(7 + 6 * n AS DOUBLE) ELSE max END AS max,
       CASE WHEN ok % 8 IN (0, 1) THEN 0.0 ELSE pct END AS pct
FROM normal JOIN nitems USING (ok)"""


@q("leaf_count")
def leaf_count(spark, sf):
    pairs = docs.document_pairs(spark, sf)
    return pairs.select("doc_key", align.leaf_count(F.col("gt")).alias("n_leaves"))


SQL["leaf_count"] = """
SELECT 'ord_' || CAST(o.o_orderkey AS VARCHAR) AS doc_key, CAST(7 + 6 * COALESCE(c.n, 0) AS INTEGER) AS n_leaves
FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) c
  ON c.l_orderkey = o.o_orderkey"""


def _items(col):
    return F.coalesce(as_array(as_map(F.col(col))["items"]), F.array().cast("array<variant>"))


def _item_matching(spark, sf, swap=False, keep_weights=False):
    pairs = align.cut_lineage(spread(docs.document_pairs(spark, sf), "doc_key"))
    g, p = ("pred", "gt") if swap else ("gt", "pred")
    return align.array_matching(pairs.select("doc_key", "gt", "pred"), _items(g), _items(p),
                                F.lit("object"), keep_weights=keep_weights)


def _edges(df):
    rows = df.select("doc_key", F.posexplode("_w").alias("i", "row"))
    return rows.select("doc_key", "i", F.posexplode("row").alias("j", "weight"))


@q("object_similarity")
def object_similarity(spark, sf):
    return _edges(_item_matching(spark, sf, keep_weights=True).filter(F.col("_w").isNotNull()))


SQL["object_similarity"] = f"""
WITH {DOCS_CTE}
SELECT 'ord_' || CAST(ok AS VARCHAR) AS doc_key, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, wgt AS weight FROM wt"""


@q("unmatched_gt")
def unmatched_gt(spark, sf):
    m = _item_matching(spark, sf)
    return (m.select("doc_key", F.posexplode("_match").alias("i", "j")).filter(F.col("j") < 0)
            .select("doc_key", F.concat(F.lit("$.items["), F.col("i").cast("string"), F.lit("]")).alias("path")))


SQL["unmatched_gt"] = f"""
WITH {DOCS_CTE}
SELECT 'ord_' || CAST(g.ok AS VARCHAR) AS doc_key, '$.items[' || CAST(g.i AS VARCHAR) || ']' AS path
FROM gi g WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.ok = g.ok AND mt.i = g.i)"""


@q("unmatched_pred")
def unmatched_pred(spark, sf):
    m = _item_matching(spark, sf, swap=True)
    idx = F.transform(F.col("_pa"), lambda y, j: j)
    un = F.filter(idx, lambda j: ~F.array_contains(F.col("_match"), j))
    return (m.select("doc_key", F.size("_ga").alias("n"), F.explode(un).alias("j"))
            .select("doc_key", F.concat(F.lit("$.items["), (F.col("n") + F.col("j")).cast("string"),
                                        F.lit("]")).alias("path")))


SQL["unmatched_pred"] = f"""
WITH {DOCS_CTE}
SELECT 'ord_' || CAST(g.ok AS VARCHAR) AS doc_key, '$.items[' || CAST(COALESCE(mm.m, 0) + g.i AS VARCHAR) || ']' AS path
FROM gi g LEFT JOIN mm ON mm.ok = g.ok WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.ok = g.ok AND mt.i = g.i)"""


def _name_matching(spark, sf, greedy=False, keep_weights=False):
    pairs = align.cut_lineage(spread(docs.name_pairs(spark, sf), "doc_key"))
    return align.array_matching(pairs, as_array(F.col("gt")), as_array(F.col("pred")), F.lit("string"),
                                keep_weights=keep_weights, greedy=greedy)


@q("primitive_similarity")
def primitive_similarity(spark, sf):
    return _edges(_name_matching(spark, sf, keep_weights=True).filter(F.col("_w").isNotNull()))


_NAME_CTE = f"""
li AS (SELECT l.*, p.p_name FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
g AS (SELECT l_orderkey AS ok, p_name AS s,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER_COLS}) - 1 AS i FROM li),
p0 AS (SELECT l_orderkey AS ok, CASE WHEN l_partkey % 4 = 0 THEN p_name || 's' ELSE p_name END AS s,
              row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_partkey * 31) % 97, {_ORDER_COLS}) - 1 AS j
       FROM li WHERE l_linenumber % 5 <> 0),
p AS (SELECT * FROM p0
      UNION ALL SELECT ok, 'spare part', (SELECT count(*) FROM p0 WHERE p0.ok = k.ok)
      FROM (SELECT DISTINCT l_orderkey AS ok FROM li WHERE l_orderkey % 9 = 0) k)
"""

SQL["primitive_similarity"] = f"""
WITH {_NAME_CTE}
SELECT 'ord_' || CAST(g.ok AS VARCHAR) AS doc_key, CAST(g.i AS INTEGER) AS i, CAST(p.j AS INTEGER) AS j,
       1.0 - CAST(levenshtein(g.s, p.s) AS DOUBLE) / CAST(greatest(length(g.s), length(p.s), 1) AS DOUBLE) AS weight
FROM g JOIN p ON g.ok = p.ok"""


def _assignment_totals(m):
    w = F.col("_w")
    pairs = F.filter(F.transform(F.col("_match"), lambda j, i: F.struct(i.alias("i"), j.alias("j"))),
                     lambda s: s["j"] >= 0)
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, s: acc + F.element_at(F.element_at(w, s["i"] + 1), s["j"] + 1))
    return m.select("doc_key", F.size("_ga").alias("n"), F.size("_pa").alias("m"),
                    F.size(pairs).alias("matched"), F.round(F.coalesce(total, F.lit(0.0)), 9).alias("total_weight"))


@q("assignment_optimal")
def assignment_optimal(spark, sf):
    return _assignment_totals(_name_matching(spark, sf, keep_weights=True))


@q("assignment_greedy")
def assignment_greedy(spark, sf):
    return _assignment_totals(_name_matching(spark, sf, greedy=True, keep_weights=True))


# Oracles of the assignment: the optimum by dynamic programming over subsets of the longer side, row by row of
# the shorter side; the greedy rule row by row.  ``wts``: ok, i, j, weight, n, m.
def _optimal_sql(wts_cte: str, counts: str) -> str:
    return f"""
WITH RECURSIVE {wts_cte},
side AS (SELECT ok, CASE WHEN n <= m THEN i ELSE j END AS a, CASE WHEN n <= m THEN j ELSE i END AS b, weight FROM wts),
dp AS (SELECT DISTINCT ok, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS mask, CAST(0.0 AS DOUBLE) AS total FROM side
  UNION ALL
  SELECT d.ok, d.step + 1, d.mask | (CAST(1 AS BIGINT) << CAST(s.b AS BIGINT)), max(d.total + s.weight)
  FROM dp d JOIN side s ON s.ok = d.ok AND s.a = d.step AND (d.mask & (CAST(1 AS BIGINT) << CAST(s.b AS BIGINT))) = 0
  GROUP BY d.ok, d.step + 1, d.mask | (CAST(1 AS BIGINT) << CAST(s.b AS BIGINT))),
best AS (SELECT d.ok, max(d.total) AS total FROM dp d JOIN ({counts}) c ON c.ok = d.ok AND d.step = least(c.n, c.m) GROUP BY d.ok)
SELECT 'ord_' || CAST(c.ok AS VARCHAR) AS doc_key, CAST(c.n AS INTEGER) AS n, CAST(c.m AS INTEGER) AS m,
       CAST(least(c.n, c.m) AS INTEGER) AS matched, round(coalesce(best.total, 0.0), 9) AS total_weight
FROM ({counts}) c LEFT JOIN best USING (ok)"""


def _greedy_sql(wts_cte: str, counts: str) -> str:
    return f"""
WITH RECURSIVE {wts_cte},
dp AS (SELECT DISTINCT ok, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS mask, CAST(0.0 AS DOUBLE) AS total,
              CAST(0 AS BIGINT) AS matched FROM wts
  UNION ALL
  SELECT ok, step + 1, CASE WHEN j IS NULL THEN mask ELSE mask | (CAST(1 AS BIGINT) << CAST(j AS BIGINT)) END,
         total + coalesce(weight, 0.0), matched + (CASE WHEN j IS NULL THEN 0 ELSE 1 END)
  FROM (SELECT d.ok, d.step, d.mask, d.total, d.matched, w.j, w.weight,
               row_number() OVER (PARTITION BY d.ok ORDER BY w.weight DESC NULLS LAST, w.j) AS r
        FROM dp d LEFT JOIN wts w ON w.ok = d.ok AND w.i = d.step AND w.weight > 0
             AND (d.mask & (CAST(1 AS BIGINT) << CAST(w.j AS BIGINT))) = 0
        WHERE d.step < (SELECT max(n) FROM wts)) WHERE r = 1),
last AS (SELECT ok, total, matched FROM dp WHERE step = (SELECT max(n) FROM wts))
SELECT 'ord_' || CAST(c.ok AS VARCHAR) AS doc_key, CAST(c.n AS INTEGER) AS n, CAST(c.m AS INTEGER) AS m,
       CAST(coalesce(last.matched, 0) AS INTEGER) AS matched, round(coalesce(last.total, 0.0), 9) AS total_weight
FROM ({counts}) c LEFT JOIN last USING (ok)"""


_NAME_WTS = f"""{_NAME_CTE},
gn AS (SELECT ok, count(*) AS n FROM g GROUP BY ok), pn AS (SELECT ok, count(*) AS m FROM p GROUP BY ok),
wts AS (SELECT g.ok, g.i, p.j, gn.n, pn.m,
               1.0 - CAST(levenshtein(g.s, p.s) AS DOUBLE) / CAST(greatest(length(g.s), length(p.s), 1) AS DOUBLE) AS weight
        FROM g JOIN p ON g.ok = p.ok JOIN gn ON gn.ok = g.ok JOIN pn ON pn.ok = g.ok)"""
_NAME_COUNTS = "SELECT gn.ok, gn.n, coalesce(pn.m, 0) AS m FROM gn LEFT JOIN pn USING (ok)"
SQL["assignment_optimal"] = _optimal_sql(_NAME_WTS, _NAME_COUNTS)
SQL["assignment_greedy"] = _greedy_sql(_NAME_WTS, _NAME_COUNTS)


@q("object_assignment")
def object_assignment(spark, sf):
    """Items that resemble each other: best pairing of object arrays, either side the longer one."""
    pairs = align.cut_lineage(docs.loose_item_pairs(spark, sf))
    return _assignment_totals(align.array_matching(pairs, as_array(F.col("gt")), as_array(F.col("pred")),
                                                   F.lit("object"), keep_weights=True))


_LOOSE_WTS = """
g AS (SELECT l_orderkey AS ok, CAST(l_quantity AS BIGINT) AS qty, l_returnflag AS flag, l_linestatus = 'F' AS shipped,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS BIGINT),
                                l_returnflag, l_linestatus = 'F') - 1 AS i FROM lineitem),
p0 AS (SELECT l_orderkey AS ok, CAST(l_quantity AS BIGINT) - l_partkey % 3 AS qty,
              CASE WHEN l_partkey % 3 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AS flag, l_linestatus = 'F' AS shipped,
              row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_partkey * 31) % 97, l_linenumber, l_partkey,
                                 CAST(l_quantity AS BIGINT), l_returnflag, l_linestatus = 'F') - 1 AS j
       FROM lineitem WHERE l_linenumber % 5 <> 0),
k AS (SELECT DISTINCT l_orderkey AS ok FROM lineitem),
p AS (SELECT * FROM p0
      UNION ALL SELECT ok, 1, 'N', false, (SELECT count(*) FROM p0 WHERE p0.ok = k.ok) FROM k WHERE ok % 4 = 0
      UNION ALL SELECT ok, 50, 'A', true, (SELECT count(*) FROM p0 WHERE p0.ok = k.ok) + 1 FROM k WHERE ok % 8 = 4),
gs AS (SELECT *, '{flag:' || flag || ',quantity:' || CAST(qty AS VARCHAR) || ',shipped:'
                 || (CASE WHEN shipped THEN 'True' ELSE 'False' END) || '}' AS s FROM g),
ps AS (SELECT *, '{flag:' || flag || ',quantity:' || CAST(qty AS VARCHAR) || ',shipped:'
                 || (CASE WHEN shipped THEN 'True' ELSE 'False' END) || '}' AS s FROM p),
gn AS (SELECT ok, count(*) AS n FROM g GROUP BY ok), pn AS (SELECT ok, count(*) AS m FROM p GROUP BY ok),
wts AS (SELECT a.ok, a.i, b.j, gn.n, pn.m,
          (CAST((CASE WHEN a.flag = b.flag THEN 1 ELSE 0 END) + (CASE WHEN a.qty = b.qty THEN 1 ELSE 0 END)
                + (CASE WHEN a.shipped = b.shipped THEN 1 ELSE 0 END) AS DOUBLE) * 1000.0
           + CAST((CASE WHEN a.flag = b.flag THEN length(a.flag) ELSE 0 END)
                + (CASE WHEN a.qty = b.qty THEN length(CAST(a.qty AS VARCHAR)) ELSE 0 END)
                + (CASE WHEN a.shipped = b.shipped THEN length(CASE WHEN a.shipped THEN 'True' ELSE 'False' END) ELSE 0 END)
               AS DOUBLE)) - CAST(levenshtein(a.s, b.s) AS DOUBLE) * 0.1 AS weight
        FROM gs a JOIN ps b ON a.ok = b.ok JOIN gn ON gn.ok = a.ok JOIN pn ON pn.ok = a.ok)"""
SQL["object_assignment"] = _optimal_sql(_LOOSE_WTS, _NAME_COUNTS)


@q("sparse_array_match")
def sparse_array_match(spark, sf):
    """The same arrays as ``object_assignment``, paired over edges instead of matrices."""
    pairs = align.cut_lineage(docs.loose_item_pairs(spark, sf))
    elements = stored(sparse_match.elements_of(pairs, "doc_key", as_array(F.col("gt")), as_array(F.col("pred"))))
    every = pairs.select(F.col("doc_key").alias("array_id"), F.size(as_array(F.col("gt"))).alias("n"), F.size(as_array(F.col("pred"))).alias("m"))
    found = sparse_match.totals(elements, sparse_match.sparse_match(elements)).drop("n", "m")
    return every.join(found.hint("merge"), "array_id", "left").select(
        F.col("array_id").alias("doc_key"), "n", "m", F.coalesce("matched", F.lit(0)).alias("matched"),
        F.coalesce("total_weight", F.lit(0.0)).alias("total_weight"))


SQL["sparse_array_match"] = _optimal_sql(_LOOSE_WTS, _NAME_COUNTS)


@q("sparse_long_arrays")
def sparse_long_arrays(spark, sf):
    """All line items of a return flag as one array: a third of the table, far too long for a matrix in a row."""
    elements = stored(docs.long_item_arrays(spark, sf))
    return sparse_match.totals(elements, sparse_match.sparse_match(elements))


# Only an item's own prediction shares its id, which no other agreement outweighs: the best pairing is known.
SQL["sparse_long_arrays"] = f"""
WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER_COLS}) - 1 AS i FROM lineitem),
e AS (SELECT l_returnflag AS array_id, l_linenumber % 5 <> 0 AS kept, CAST(l_quantity AS BIGINT) AS q,
             CAST(l_quantity AS BIGINT) + l_partkey % 3 AS p,
             CASE WHEN l_linestatus = 'F' THEN 'True' ELSE 'False' END AS shipped,
             'line-' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || '-' || lpad(CAST(i AS VARCHAR), 4, '0') AS id FROM li),
w AS (SELECT array_id, kept,
             20000 + 10 * (length(id) + length(shipped)) + (CASE WHEN p = q THEN 10000 + 10 * length(CAST(q AS VARCHAR)) ELSE 0 END)
             - levenshtein('{{id:' || id || ',quantity:' || CAST(q AS VARCHAR) || ',shipped:' || shipped || '}}',
                           '{{id:' || id || ',quantity:' || CAST(p AS VARCHAR) || ',shipped:' || shipped || '}}') AS t FROM e)
SELECT array_id, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (WHERE kept) AS INTEGER) AS m,
       CAST(count(*) FILTER (WHERE kept) AS INTEGER) AS matched,
       CAST(coalesce(sum(t) FILTER (WHERE kept), 0) AS DOUBLE) / 10.0 AS total_weight
FROM w GROUP BY array_id"""


@q("json_flatten")
def json_flatten(spark, sf):
    ev = docs.event_documents(spark, sf)
    return flatten_json(ev, "event_id", "doc").select(F.col("key").alias("event_id"), "path", "kind", "text")


_EV_CTE = """
ev AS (SELECT event_id, '$.event' AS path, 'string' AS kind, event_type AS text FROM events
 UNION ALL SELECT event_id, '$.value', 'number', CAST(value AS VARCHAR) FROM events
 UNION ALL SELECT event_id, '$.user', 'integer', CAST(user_id AS VARCHAR) FROM events
 UNION ALL SELECT event_id, '$.flag', 'boolean', CASE WHEN value > 10 THEN 'True' ELSE 'False' END FROM events
 UNION ALL SELECT event_id, '$.note', 'null', 'None' FROM events
 UNION ALL SELECT event_id, '$.props.k', 'integer', CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) FROM events
 UNION ALL SELECT event_id, '$.tags[0]', 'string', event_type FROM events
 UNION ALL SELECT event_id, '$.tags[1]', 'string', CAST(user_id % 7 AS VARCHAR) FROM events)
"""
SQL["json_flatten"] = f"WITH {_EV_CTE} SELECT * FROM ev"


@q("value_types")
def value_types(spark, sf):
    ev = docs.event_documents(spark, sf)
    return flatten_json(ev, "event_id", "doc").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


SQL["value_types"] = f"WITH {_EV_CTE} SELECT kind, count(*) AS n FROM ev GROUP BY kind"


@q("object_key_align")
def object_key_align(spark, sf):
    pairs = docs.document_pairs(spark, sf)
    return align.key_alignment(pairs).groupBy("key", "side").agg(F.count(F.lit(1)).alias("n"))


SQL["object_key_align"] = """
WITH k AS (SELECT unnest(['customer', 'items', 'orderkey', 'priority', 'status', 'totalprice']) AS key)
SELECT key, 'both' AS side, (SELECT count(*) FROM orders) AS n FROM k
UNION ALL SELECT 'comment', 'pred_only', count(*) FROM orders WHERE o_orderkey % 10 = 0"""


@q("hardest_fields")
def hardest_fields(spark, sf):
    pairs = docs.document_pairs(spark, sf)
    leaves = align.leaf_scores(spread(pairs), _nodes(spark))
    board = boards.field_score_board(leaves)
    return board.select("path", "n", F.round("avg_score", 6).alias("avg_score"))


SQL["hardest_fields"] = f"""
WITH {DOCS_CTE}
SELECT path, count(*) AS n, round(avg(sc), 6) AS avg_score FROM all_leaves GROUP BY path"""


_PIVOT_MODES = ["instructor/tools", "langchain/json_mode", "openai/default"]


def _mode_of_key():
    k = F.regexp_extract("doc_key", r"(\d+)$", 1).cast("long")
    return F.element_at(F.array(*map(F.lit, _PIVOT_MODES)), (k % 3 + 1).cast("int"))


@q("field_mode_pivot")
def field_mode_pivot(spark, sf):
    """Every order's document as one mode's result: mean score per field and mode."""
    leaves = align.leaf_scores(spread(docs.document_pairs(spark, sf)), _nodes(spark))
    return boards.field_mode_pivot(leaves.select("path", _mode_of_key().alias("fw_mode"), "score"), _PIVOT_MODES)


SQL["field_mode_pivot"] = f"""
WITH {DOCS_CTE},
cells AS (SELECT path, """ + ", ".join(
    f"""round(avg(CASE WHEN ok % 3 = {i} THEN sc END), 3) AS "{m}" """ for i, m in enumerate(_PIVOT_MODES)) + f"""
          FROM all_leaves GROUP BY path)
SELECT *, round(({' + '.join(f'COALESCE("{m}", 0.0)' for m in _PIVOT_MODES)})
     / CAST({' + '.join(f'(CASE WHEN "{m}" IS NULL THEN 0 ELSE 1 END)' for m in _PIVOT_MODES)} AS DOUBLE), 3) AS avg FROM cells"""


@q("field_scores")
def field_scores(spark, sf):
    """Scores per field path of every document, as rows of the documents' field-score maps."""
    scored = align.document_scores(docs.document_pairs(spark, sf), _nodes(spark), with_field_scores=True)
    return scored.select("doc_key", F.explode("field_scores").alias("path", "score"))


SQL["field_scores"] = f"""
WITH {DOCS_CTE}
SELECT 'ord_' || CAST(ok AS VARCHAR) AS doc_key, path, round(sc, 4) AS score FROM all_leaves"""


@q("sample_detail")
def sample_detail(spark, sf):
    """Ground truth vs prediction of one selected sample (the detail view's selection)."""
    pairs = docs.document_pairs(spark, sf, F.col("o_orderkey") == 7)
    return pairs.select("doc_key", F.try_variant_get("gt", "$.status", "string").alias("gt_status"),
                        F.try_variant_get("pred", "$.status", "string").alias("pred_status"),
                        F.try_variant_get("gt", "$.totalprice", "double").alias("gt_total"),
                        F.try_variant_get("pred", "$.totalprice", "double").alias("pred_total"))


SQL["sample_detail"] = """
SELECT 'ord_' || CAST(o_orderkey AS VARCHAR) AS doc_key, o_orderstatus AS gt_status,
       CASE WHEN o_orderkey % 4 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS pred_status,
       o_totalprice AS gt_total,
       CAST(floor(CAST(CAST(round(o_totalprice * 100.0) AS BIGINT) * (100 + o_orderkey % 9) AS DOUBLE) / 100)
            AS DOUBLE) / 100.0 AS pred_total
FROM orders WHERE o_orderkey = 7"""


def _same_beginning(actual, predicted):
    """Half a point for a text that begins like the other, a whole one for the same text."""
    return (actual.str[:2] == predicted.str[:2]).astype(float) / 2 + (actual == predicted).astype(float) / 2


@q("user_metrics")
def user_metrics(spark, sf):
    """Two field types of the user's own: status codes by a column expression, priorities by a batch function."""
    declared = json.loads(json.dumps(docs.SCHEMA))
    declared["properties"]["status"]["type"] = "code"
    declared["properties"]["priority"]["type"] = "label"
    nodes = schema_nodes(spark.createDataFrame([(docs.SCHEMA_ID, json.dumps(declared))], "schema_id string, schema_text string"))

    def same_code(a, p):
        return F.when(F.lower(F.try_variant_get(a, "$", "string")) == F.lower(F.try_variant_get(p, "$", "string")), 1.0).otherwise(0.0)
    LF.register_metric("code", same_code)
    LF.register_metric("label", _same_beginning, arrow=True)
    try:
        return align.document_scores(docs.document_pairs(spark, sf), nodes)
    finally:
        del LF.USER_METRICS["code"], LF.ARROW_METRICS["label"]


SQL["user_metrics"] = f"""
WITH {DOCS_CTE},
mine AS (SELECT ok, path, CASE path WHEN '$.status' THEN 1.0 WHEN '$.priority' THEN
             (CASE WHEN ok % 6 <> 0 THEN 1.0 ELSE (SELECT CASE WHEN pr = '3-MEDIUM' THEN 1.0 WHEN substr(pr, 1, 2) = '3-' THEN 0.5 ELSE 0.0 END
                                                   FROM od WHERE od.ok = all_leaves.ok) END) ELSE sc END AS sc FROM all_leaves)
SELECT 'ord_' || CAST(ok AS VARCHAR) AS doc_key, round(sum(sc), 2) AS total, CAST(count(*) AS DOUBLE) AS max,
       round(sum(sc) / count(*) * 100.0, 1) AS pct
FROM mine GROUP BY ok"""
