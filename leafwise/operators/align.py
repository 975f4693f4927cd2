"""Document alignment: flatten a (ground truth, prediction) JSON pair into typed leaf pairs and score them.

The recursion runs as a level-wise frontier loop.  The frontier holds containers only; a level opens each
container in-row (object keys are unioned, array elements are matched on an n×m weight matrix built with
higher-order functions over JVM ``levenshtein``), joins the children to their schema nodes and classes them at
once: leaves leave the level as scores, containers form the next frontier.  No level shuffles: the schema nodes are
broadcast while they are measured to be small.  Each level is kept below the reliable checkpoint folder, which cuts the
lineage and survives executor loss: the first, whole documents, as rows; the others as column files, which take a
fraction of the disk and are cheap to read again, as most of their rows are leaves, with few columns set.  The loop ends
when no container is left, at any depth.

Semantics follow the evaluated scorer: both-null pairs vanish; a node is an object when its schema says so or
either side is an object (likewise arrays); a scalar where a container is expected is dropped; primitive array
elements become leaves directly (null elements still pair); unmatched ground-truth elements keep index i,
unmatched predictions get index n + j.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.functions.distance import edit_distances
from leafwise.functions.leaf import ARROW_METRICS, USER_METRICS, arrow_score, element_similarity, with_leaf_score
from leafwise.functions.values import FIELD_SEP, as_array, as_map, kind_of, pystr, truthy, typed, vtag, vtype, with_element_info
from leafwise.operators.assignment import with_match
from leafwise.session import cut_lineage, small_side, spread, stored

LEAF_TYPES = ("string", "number", "integer", "boolean")
RESERVED = "evaluation_config"
KERNEL = "\u0000kernel"         # ``fixed`` of an array container whose match takes Python

_CHILD = "struct<path:string,spath:string,gt:variant,pred:variant,fixed:string>"


def _child(path: Column, spath: Column, gt: Column, pred: Column, fixed: Column | None = None) -> Column:
    """``fixed``: leaf type of a primitive array element, which is a leaf whatever its value."""
    return F.struct(path.alias("path"), spath.alias("spath"), gt.alias("gt"), pred.alias("pred"),
                    (fixed if fixed is not None else F.lit(None).cast("string")).alias("fixed"))


def _object_children(fr: DataFrame) -> DataFrame:
    """Children of the object containers ``fr``.  The two maps are columns of their own: inside a lambda they would be
    built again for every key."""
    fr = fr.withColumns({"_gm": F.when(F.col("gt_kind") == "object", as_map(F.col("gt"))),
                         "_pm": F.when(F.col("pred_kind") == "object", as_map(F.col("pred")))})
    gm, pm = F.col("_gm"), F.col("_pm")
    empty = F.array().cast("array<string>")
    keys = F.array_union(F.coalesce(F.map_keys(gm), empty), F.coalesce(F.map_keys(pm), empty))
    keys = F.sort_array(F.array_remove(keys, RESERVED))
    kids = F.transform(keys, lambda k: _child(F.concat(F.col("path"), F.lit("."), k), F.concat(F.col("spath"), F.lit("."), k),
                                              F.try_element_at(gm, k), F.try_element_at(pm, k)))
    return fr.select("doc_key", "schema_id", F.explode(kids).alias("c")).select("doc_key", "schema_id", "c.*")


def array_matching(fr: DataFrame, ga: Column, pa: Column, items_type: Column, keep_weights: bool = False,
                   greedy: bool = False, python: bool = True) -> DataFrame:
    """Match two VARIANT arrays held in the same row.

    Adds ``_ga`` / ``_pa`` (array<struct<v, t>>), ``_obj`` (object-element
    matching), optionally ``_w`` (the n×m weight matrix) and ``_match``
    (matched column per ground-truth element, -1 if none).  Per-element work
    (type tag, stable string, field map, Python string) is materialised once
    per element; the matrix only combines those.  Nothing leaves the row.
    Without ``python`` the match is NULL where texts or matrices would have to
    go there.
    """
    fr = fr.withColumn("_ga", typed(ga)).withColumn("_pa", typed(pa)).withColumn("_it", items_type)
    ga, pa = F.col("_ga"), F.col("_pa")
    n, m = F.size(ga), F.size(pa)
    first_t = F.try_element_at(ga, F.lit(1))["t"]
    obj = (F.col("_it") == "object") | ((n > 0) & F.coalesce(first_t.startswith("OBJECT"), F.lit(False)))
    fr = fr.withColumn("_obj", obj)
    fr = with_element_info(fr, {"_gi": "_ga", "_pi": "_pa"}, "_obj", python)

    # weights: object elements by field agreement and whole-element edit distance,
    # primitive elements by normalised edit distance of their Python strings
    def shared(g, p):
        return F.aggregate(F.array_intersect(g["f"], p["f"]), F.lit(0), lambda acc, e: acc + F.lit(1000) + F.length(e) - F.instr(e, FIELD_SEP))

    gi, pi = F.col("_gi"), F.col("_pi")
    both = (n > 0) & (m > 0)
    if keep_weights or greedy:                  # every row needs its matrix: distances of a batch of rows at once
        wanted = both
        fr = fr.withColumn("_d", edit_distances(*(F.when(wanted, F.transform(x, lambda e: e["s"])) for x in (gi, pi))))

        def distance(g, i, p, j):
            return F.col("_d")[i][j]
    else:
        fr = _sure_match(fr, both & F.col("_obj"), n, m, shared)
        wanted = both & F.col("_sure").isNull()

        def distance(g, i, p, j):
            return F.levenshtein(g["s"], p["s"])
    w_obj = F.transform(gi, lambda g, i: F.transform(pi, lambda p, j: shared(g, p).cast("double") - distance(g, i, p, j).cast("double") * 0.1))
    w_prim = F.transform(gi, lambda g, i: F.transform(pi, lambda p, j: element_similarity(g["s"], p["s"], distance(g, i, p, j))))
    fr = fr.withColumn("_w", F.when(wanted, F.when(F.col("_obj"), w_obj).otherwise(w_prim))).drop("_d")
    fr = with_match(fr, F.col("_w"), n, m, greedy=greedy, python=python)
    if not python:
        fr = fr.withColumn("_match", F.when(F.col("_gi").isNotNull() & F.col("_pi").isNotNull(), F.col("_match")))
    fr = fr.drop("_gi", "_pi", "_it")
    if "_sure" in fr.columns:
        fr = fr.withColumn("_match", F.coalesce("_sure", "_match")).drop("_sure")
    return fr if keep_weights else fr.drop("_w")


def _sure_match(fr: DataFrame, where: Column, n: Column, m: Column, shared) -> DataFrame:
    """Adds ``_sure``: the match of object arrays that follows from the shared fields alone, else NULL.

    An edit distance lies between the difference of the two lengths and the longer length, so each weight has a lower
    and an upper bound without it.  Where, for every element of the shorter side, one weight's lower bound exceeds all
    its other upper bounds, and these are different elements, they are the strict row maxima that ``with_match``
    certifies, whatever the edit distances are.  Bounds are in tenths, as integers."""
    fr = fr.withColumns({"_short": F.when(where, F.when(n <= m, F.col("_gi")).otherwise(F.col("_pi"))),
                         "_long": F.when(where, F.when(n <= m, F.col("_pi")).otherwise(F.col("_gi")))})

    def sizes(a, b, j):
        x, y = F.length(a["s"]), F.length(b["s"])
        return F.struct((shared(a, b) * 10).alias("b"), F.abs(x - y).alias("d"), F.greatest(x, y).alias("m"), j.alias("j"))

    def bounds(row):
        return F.transform(row, lambda x: F.struct((x["b"] - x["d"]).alias("hi"), x["j"].alias("j"), (x["b"] - x["m"]).alias("lo")))
    rows = F.transform("_short", lambda a: F.transform(F.col("_long"), lambda b, j: sizes(a, b, j)))
    fr = fr.withColumn("_best", F.transform(rows, lambda r: F.slice(F.sort_array(bounds(r), asc=False), 1, 2)))
    fr = fr.withColumn("_arg", F.transform("_best", lambda t: F.when((F.size(t) == 1) | (t[0]["lo"] > F.try_element_at(t, F.lit(2))["hi"]), t[0]["j"])))
    every = ~F.exists("_arg", lambda j: j.isNull()) & (F.size(F.array_distinct("_arg")) == F.size("_arg"))
    by_long = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.array_position(F.col("_arg"), i).cast("int") - 1)
    return fr.withColumn("_sure", F.when(where & every, F.when(n <= m, F.col("_arg")).otherwise(by_long))).drop("_short", "_long", "_best", "_arg")


def _array_children(fr: DataFrame, python: bool = True) -> DataFrame:
    """Children of the array containers ``fr``: matched pairs, then what is left on either side.  Without ``python`` a
    container whose match takes Python comes back itself, marked for the next level."""
    empty = F.array().cast("array<variant>")
    ga = F.coalesce(F.when(F.col("gt_kind") == "array", as_array(F.col("gt"))), empty)
    pa = F.coalesce(F.when(F.col("pred_kind") == "array", as_array(F.col("pred"))), empty)
    fr = array_matching(fr, ga, pa, F.coalesce(F.col("items_type"), F.lit("string")), python=python)
    ga, pa, match = F.col("_ga"), F.col("_pa"), F.col("_match")
    n = F.size(ga)
    item_spath = F.concat(F.col("spath"), F.lit("[]"))
    fixed = F.when(~F.col("_obj"), F.coalesce(F.col("items_type"), F.lit("string")))

    def at(i):
        return F.concat(F.col("path"), F.lit("["), i.cast("string"), F.lit("]"))
    from_gt = F.transform(ga, lambda x, i: _child(at(i), item_spath, x["v"], F.when(
        match[i] >= 0, F.try_element_at(pa, match[i] + 1)["v"]), fixed))
    indexed = F.transform(pa, lambda y, j: F.struct(j.alias("j"), y["v"].alias("y")))
    unmatched = F.filter(indexed, lambda s: ~F.array_contains(match, s["j"]))
    from_pred = F.transform(unmatched, lambda s: _child(at(n + s["j"]), item_spath, F.lit(None).cast("variant"), s["y"], fixed))
    kids = F.concat(from_gt, from_pred)
    if not python:
        kids = F.when(match.isNull(), F.array(_child(F.col("path"), F.col("spath"), F.col("gt"), F.col("pred"), F.lit(KERNEL)))).otherwise(kids)
    return fr.select("doc_key", "schema_id", F.explode(kids).alias("c")).select("doc_key", "schema_id", "c.*")


#: Class of a container -> its children.  Arrays meet Python in a level of their own, which only those that need it enter.
CHILDREN = {"object": _object_children, "array": functools.partial(_array_children, python=False), "kernel": _array_children}


def _classed(rows: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """Rows (doc_key, schema_id, path, spath, gt, pred, fixed) with their class: leaves carry their score and no
    values any more, containers (object, array) carry their values and kinds; both-null pairs are dropped."""
    if nodes is not None:
        rows = rows.join(nodes, ["schema_id", "spath"], "left")
    else:
        rows = rows.withColumns({"ftype": F.lit(None).cast("string"), "items_type": F.lit(None).cast("string")})
    rows = rows.withColumns({"_gt_t": vtag(F.col("gt")), "_pr_t": vtag(F.col("pred"))})
    rows = rows.withColumns({"gt_kind": kind_of(F.col("_gt_t")), "pred_kind": kind_of(F.col("_pr_t"))})
    gk, pk, fixed = F.col("gt_kind"), F.col("pred_kind"), F.col("fixed")
    rows = rows.where(fixed.isNotNull() | (gk != "null") | (pk != "null"))
    ft = F.coalesce(F.col("ftype"), F.lit("string"))
    is_obj = (ft == "object") | (gk == "object") | (pk == "object")
    is_arr = (ft == "array") | (gk == "array") | (pk == "array")
    cls = F.when(fixed == KERNEL, F.lit("kernel")).when(fixed.isNotNull(), F.lit("leaf")).when(is_obj, F.lit("object")).when(is_arr, F.lit("array")).otherwise(F.lit("leaf"))
    leaf_type = F.coalesce(fixed, F.when(ft.isin(*LEAF_TYPES, *USER_METRICS, *ARROW_METRICS), ft).otherwise(F.when(gk != "null", gk).otherwise(pk)))
    rows = rows.withColumns({"cls": cls, "leaf_type": leaf_type})
    leaf = F.col("cls") == "leaf"
    held = ~leaf | F.col("leaf_type").isin(*ARROW_METRICS) if ARROW_METRICS else ~leaf       # values that are still needed
    rows = with_leaf_score(rows, leaf, "gt", "pred", "leaf_type", "_gt_t", "_pr_t")
    opened = [F.when(~leaf, F.col(c)).alias(c) for c in ("schema_id", "spath", "items_type")]
    kept = [F.when(held, F.col(c)).alias(c) for c in ("gt", "pred", "gt_kind", "pred_kind")]
    return rows.select("doc_key", "path", "cls", F.when(leaf, F.col("leaf_type")).alias("leaf_type"), "score", *opened, *kept)


def _batch_scored(found: DataFrame) -> DataFrame:
    """Leaves of the types with batch metrics, each type in a stage of its own that ships its own texts only."""
    others = found.where(~F.col("leaf_type").isin(*ARROW_METRICS))
    scored = [others.select("doc_key", "path", F.col("leaf_type").alias("ftype"), "score")]
    for name, metric in ARROW_METRICS.items():
        own = found.where(F.col("leaf_type") == name)
        one_null = (F.col("gt_kind") == "null") | (F.col("pred_kind") == "null")
        base = ["doc_key", "path", F.col("leaf_type").alias("ftype")]
        texts = own.where(~one_null).select(*base, pystr(F.col("gt")).alias("a"), pystr(F.col("pred")).alias("p"))
        scored += [own.where(one_null).select(*base, F.when(F.col("gt_kind") == F.col("pred_kind"), 1.0).otherwise(0.0).alias("score")),
                   texts.select("doc_key", "path", "ftype", arrow_score(metric, F.col("a"), F.col("p")).alias("score"))]
    return functools.reduce(DataFrame.unionByName, scored)


def leaf_scores(pairs: DataFrame, schema_nodes: DataFrame | None = None) -> DataFrame:
    """pairs(doc_key, schema_id, gt VARIANT, pred VARIANT) -> leaves(doc_key, path, ftype, score).

    ``schema_nodes(schema_id, spath, ftype, items_type)`` is the resolved schema table
    (``operators.schema.schema_nodes``); None means every node is ``{}``."""
    nodes = None if schema_nodes is None else small_side(schema_nodes.select("schema_id", "spath", "ftype", "items_type"))
    rows = pairs.select(F.col("doc_key").cast("string"), F.col("schema_id").cast("string"), F.lit("$").alias("path"),
                        F.lit("$").alias("spath"), "gt", "pred", F.lit(None).cast("string").alias("fixed"))
    leaves = None
    while True:
        level = (cut_lineage if leaves is None else stored)(_classed(rows, nodes))
        found = level.where("cls = 'leaf'")
        found = _batch_scored(found) if ARROW_METRICS else found.select("doc_key", "path", F.col("leaf_type").alias("ftype"), "score")
        leaves = found if leaves is None else leaves.unionByName(found)
        opened = [kids(level.where(F.col("cls") == cls)) for cls, kids in CHILDREN.items() if not level.where(F.col("cls") == cls).isEmpty()]
        if not opened:
            return leaves
        rows = functools.reduce(DataFrame.unionByName, opened)


_KEY_TOKEN = r'"(?:[^"\\]|\\.)*"\s*:'
_STR_TOKEN = r'"(?:[^"\\]|\\.)*"'
_SCALAR = r"S|true|false|null|-?[0-9][0-9.eE+-]*"


def leaf_count(v: Column) -> Column:
    """Scalars and nulls count 1, empty containers 0, whole document at least 1
    (token count over the compact JSON text, JVM-side, no recursion)."""
    txt = F.regexp_replace(F.regexp_replace(F.to_json(v), _KEY_TOKEN, ":"), _STR_TOKEN, "S")
    c = F.regexp_count(txt, F.lit(_SCALAR))
    return F.when(kind_of(vtype(v)).isin("object", "array"), F.greatest(c, F.lit(1))).otherwise(F.lit(1))


def document_scores(pairs: DataFrame, schema_nodes: DataFrame | None = None,
                    with_field_scores: bool = False) -> DataFrame:
    """Per document: total (Σ leaf scores, round 2), max (number of pairs), pct (round 1).

    No prediction (SQL NULL): total 0, max = leaf count of the ground truth, pct 0.
    No pairs: both sides non-empty -> max 1, pct 0; otherwise max 0, pct 100.
    """
    pairs = cut_lineage(spread(pairs.select(F.col("doc_key").cast("string"), "schema_id", "gt", "pred")))
    leaves = leaf_scores(pairs.where("pred is not null"), schema_nodes)
    sums = [F.sum("score").alias("_total"), F.count(F.lit(1)).alias("_n")]
    if with_field_scores:
        sums.append(F.collect_list(F.struct("path", "score")).alias("_leaves"))
    per_doc = leaves.groupBy("doc_key").agg(*sums)
    if with_field_scores:               # a path that stands for two leaves keeps the better score
        per_doc = per_doc.withColumn("_leaves", F.sort_array("_leaves"))
        last = F.filter("_leaves", lambda x, i: ~F.coalesce(F.try_element_at("_leaves", i + 2)["path"] == x["path"], F.lit(False)))
        per_doc = per_doc.withColumn("field_scores", F.map_from_entries(F.transform(last, lambda x: F.struct(x["path"], F.round(x["score"], 4)))))
    j = pairs.join(per_doc, "doc_key", "left")
    no_pred = F.col("pred").isNull()
    no_pairs = F.col("_n").isNull()
    both = truthy(F.col("gt")) & truthy(F.col("pred"))
    total = F.when(no_pred | no_pairs, F.lit(0.0)).otherwise(F.round(F.col("_total"), 2))
    mx = (F.when(no_pred, leaf_count(F.col("gt")).cast("double"))
          .when(no_pairs, F.when(both, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(F.col("_n").cast("double")))
    pct = (F.when(no_pred, F.lit(0.0))
           .when(no_pairs, F.when(both, F.lit(0.0)).otherwise(F.lit(100.0)))
           .otherwise(F.round(F.col("_total") / F.col("_n") * 100.0, 1)))
    cols = [F.col("doc_key"), total.alias("total"), mx.alias("max"), pct.alias("pct")]
    if with_field_scores:
        cols.append(F.coalesce(F.col("field_scores"), F.create_map().cast("map<string,double>")).alias("field_scores"))
    return j.select(*cols)


def key_alignment(pairs: DataFrame) -> DataFrame:
    """Root-level object key union: (doc_key, key, side in both/gt_only/pred_only),
    reserved keys excluded.  In-row set algebra on the two key arrays."""
    empty = F.array().cast("array<string>")
    gk = F.coalesce(F.map_keys(as_map(F.col("gt"))), empty)
    pk = F.coalesce(F.map_keys(as_map(F.col("pred"))), empty)
    both = F.transform(F.array_intersect(gk, pk), lambda k: F.struct(k.alias("key"), F.lit("both").alias("side")))
    g_only = F.transform(F.array_except(gk, pk), lambda k: F.struct(k.alias("key"), F.lit("gt_only").alias("side")))
    p_only = F.transform(F.array_except(pk, gk), lambda k: F.struct(k.alias("key"), F.lit("pred_only").alias("side")))
    out = pairs.select("doc_key", F.explode(F.concat(both, g_only, p_only)).alias("e")).select("doc_key", "e.*")
    return out.filter(F.col("key") != RESERVED)
