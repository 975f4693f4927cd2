"""Leaf metrics: normalised edit-distance similarity, tolerant number
comparison, truthiness comparison, and the typed dispatcher."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.functions.values import pyfloat, pystr, pystrip, strip_text, truthy, vtype

TOLERANCE = 0.05
#: Metrics of further field types: type -> (actual VARIANT, predicted VARIANT) -> score Column between 0 and 1.
USER_METRICS: dict = {}
#: Metrics of further field types over batches: type -> (actual texts, predicted texts) -> scores.
ARROW_METRICS: dict = {}


def ned(a: Column, b: Column) -> Column:
    """1 - levenshtein / max length (code points); both empty -> 1."""
    mx = F.greatest(F.length(a), F.length(b))
    return F.when(mx == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b).cast("double") / mx.cast("double"))


def element_similarity(a: Column, b: Column, distance: Column | None = None) -> Column:
    """Primitive array element weight: 1 - lev / max(len, len, 1) (no strip); ``distance``: their edit distance, if known."""
    mx = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.lit(1.0) - (F.levenshtein(a, b) if distance is None else distance).cast("double") / mx.cast("double")


def number_score_d(a: Column, p: Column, tol: float = TOLERANCE) -> Column:
    """Tolerant comparison of two doubles (NULL = unparsable -> 0)."""
    rel = F.abs(a - p) / F.abs(a)
    return (F.when(a.isNull() | p.isNull(), F.lit(0.0))
            .when(F.isnan(a) | F.isnan(p), F.lit(0.0))
            .when(a == p, F.lit(1.0))
            .when(a == 0, F.when(F.abs(p) <= tol, F.lit(1.0)).otherwise(F.lit(0.0)))
            .when(F.isnan(rel), F.lit(0.0))
            .when(rel <= tol, F.lit(1.0))
            .otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - (rel - tol) / (1.0 - tol))))


def number_score(a: Column, p: Column, at: Column | None = None, pt: Column | None = None) -> Column:
    return number_score_d(pyfloat(a, at), pyfloat(p, pt))


def boolean_score(a: Column, p: Column, at: Column | None = None, pt: Column | None = None) -> Column:
    return F.when(truthy(a, at) == truthy(p, pt), F.lit(1.0)).otherwise(F.lit(0.0))


def string_score(a: Column, p: Column, at: Column | None = None, pt: Column | None = None) -> Column:
    return ned(pystrip(pystr(a, at)), pystrip(pystr(p, pt)))


def register_metric(field_type: str, metric, arrow: bool = False) -> None:
    """Score leaves of a declared type by ``metric(actual, predicted)``; it goes before the built-in ones.

    ``arrow``: the metric takes two pandas Series of texts (Python ``str`` of the values) and gives scores; it runs in
    a stage of its own that gets the leaves of its type only.  Nulls are scored before it: both 1, one 0."""
    (ARROW_METRICS if arrow else USER_METRICS)[field_type] = metric


def arrow_score(metric, a: Column, p: Column) -> Column:
    """``metric`` over batches of texts."""
    def run(actual: pd.Series, predicted: pd.Series) -> pd.Series:
        return metric(actual, predicted)
    return F.pandas_udf(run, "double")(a, p)


def leaf_score(a: Column, p: Column, field_type: Column, at: Column | None = None,
               pt: Column | None = None) -> Column:
    """Typed leaf comparison on VARIANT values: both null 1, one null 0, then by type.

    ``at`` / ``pt`` are the values' precomputed type tags (``values.vtype``)."""
    at = vtype(a) if at is None else at
    pt = vtype(p) if pt is None else pt
    a_null, p_null = at == "VOID", pt == "VOID"
    out = F.when(a_null & p_null, F.lit(1.0)).when(a_null | p_null, F.lit(0.0))
    for name, metric in USER_METRICS.items():
        out = out.when(field_type == name, metric(a, p))
    return (out.when(field_type.isin("number", "integer"), number_score(a, p, at, pt))
            .when(field_type == "boolean", boolean_score(a, p, at, pt))
            .otherwise(string_score(a, p, at, pt)))


def with_leaf_score(rows: DataFrame, where: Column, a: str, p: str, field_type: str, at: str, pt: str, out: str = "score") -> DataFrame:
    """``leaf_score`` of the rows ``where`` says, as column ``out``; types with batch metrics are left NULL.

    Numbers and texts are columns of their own: within one expression each would be built again wherever it is used.
    Equal texts score 1 as they are; only different ones are stripped and compared."""
    ft, live = F.col(field_type), where & (F.col(at) != "VOID") & (F.col(pt) != "VOID")
    number = ft.isin("number", "integer")
    text = ~ft.isin("number", "integer", "boolean", *USER_METRICS, *ARROW_METRICS)
    rows = rows.withColumns({"_an": F.when(live & number, pyfloat(F.col(a), F.col(at))), "_pn": F.when(live & number, pyfloat(F.col(p), F.col(pt))),
                             "_as": F.when(live & text, pystr(F.col(a), F.col(at))), "_ps": F.when(live & text, pystr(F.col(p), F.col(pt)))})
    differ = F.col("_as") != F.col("_ps")
    rows = rows.withColumns({"_as": F.when(differ, strip_text(F.col("_as"))), "_ps": F.when(differ, strip_text(F.col("_ps")))})
    a_null, p_null = F.col(at) == "VOID", F.col(pt) == "VOID"
    score = F.when(~where, F.lit(None).cast("double")).when(a_null & p_null, F.lit(1.0)).when(a_null | p_null, F.lit(0.0))
    for name, metric in USER_METRICS.items():
        score = score.when(ft == name, metric(F.col(a), F.col(p)))
    score = (score.when(number, number_score_d(F.col("_an"), F.col("_pn")))
             .when(ft == "boolean", boolean_score(F.col(a), F.col(p), F.col(at), F.col(pt)))
             .when(text, F.when(F.col("_as").isNull(), F.lit(1.0)).otherwise(ned(F.col("_as"), F.col("_ps")))))
    return rows.withColumn(out, score).drop("_an", "_pn", "_as", "_ps")
