"""Python-compatible views of JSON values held in VARIANT columns.

The scorer's semantics are defined on Python values (``json.loads`` output);
these expressions reproduce them JVM-side:

* ``kind_of``  — null / object / array / boolean / integer / number / string
* ``pystr``    — ``str(value)`` for scalars (``True``, ``1.0``, ``1e+16``)
* ``pyfloat``  — ``float(value)`` (booleans are numbers; strings follow
  Python's float syntax incl. ``_`` separators, ``inf`` and ``nan``)
* ``truthy``   — ``bool(value)`` ("false" is true, empty containers false)
* ``element_info`` — canonical element strings: '' for null, ``{k:v,…}`` by key, ``[a,b]``, scalars by
  ``str(value)``

Every function takes the value and, optionally, its already computed
``schema_of_variant`` string ``t``: callers materialise ``t`` once per value
(as a column or a struct field) so expression trees stay linear in size.

Canonical-form note: a VARIANT keeps the JSON number's decimal scale, so ``1.0`` is recognised as a float
(DECIMAL(p,0)) and printed ``1.0``.  Array elements that are scalars, or objects of scalars, are rendered by
expressions; arrays with other elements by one Arrow-batched UDF over decoded VARIANTs, at any depth of nesting.
"""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PY_FLOAT = (r"^(?i)[+-]?((([0-9](_?[0-9])*)?\.[0-9](_?[0-9])*|[0-9](_?[0-9])*\.?)"
             r"(e[+-]?[0-9](_?[0-9])*)?|inf|infinity|nan)$")
_WS_STRIP = r"(?U)^\s+|\s+$"


def vtype(v: Column) -> Column:
    """Type tag of a VARIANT; SQL NULL and JSON null both give 'VOID'."""
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def vtag(v: Column) -> Column:
    """``vtype`` without a look into containers, whose tags are bare: 'OBJECT', 'ARRAY'."""
    return (F.when(as_array(v).isNotNull(), F.lit("ARRAY")).when(F.try_variant_get(v, "$", "struct<>").isNotNull(), F.lit("OBJECT"))
            .otherwise(vtype(v)))


def kind_of(t: Column) -> Column:
    """Kind from a type tag."""
    return (F.when(t == "VOID", F.lit("null"))
            .when(t.startswith("OBJECT"), F.lit("object"))
            .when(t.startswith("ARRAY"), F.lit("array"))
            .when(t == "BOOLEAN", F.lit("boolean"))
            .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit("integer"))
            .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), F.lit("number"))
            .otherwise(F.lit("string")))


def as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def typed(arr: Column) -> Column:
    """array<variant> -> array<struct<v variant, t string>> (type tag computed once)."""
    return F.transform(arr, lambda x: F.struct(x.alias("v"), vtag(x).alias("t")))


def _py_sci(s: Column) -> Column:
    """Java '1.0E16' -> Python '1e+16' (mantissa without a trailing '.0')."""
    mant = F.regexp_replace(F.regexp_extract(s, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    ex = F.regexp_extract(s, r"E(-?[0-9]+)$", 1).cast("int")
    sign = F.when(ex < 0, F.lit("-")).otherwise(F.lit("+"))
    return F.concat(mant, F.lit("e"), sign, F.lpad(F.abs(ex).cast("string"), 2, "0"))


def _scalar_str(v: Column, t: Column, null_as: str) -> Column:
    s = F.try_variant_get(v, "$", "string")
    return (F.when(t == "VOID", F.lit(null_as))
            .when(t == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), F.lit("True"))
                  .otherwise(F.lit("False")))
            .when(t.startswith("OBJECT") | t.startswith("ARRAY"), F.to_json(v))
            .when(t.rlike(r"^DECIMAL\(\d+,0\)$"), F.concat(s, F.lit(".0")))
            .when(t.isin("DOUBLE", "FLOAT") & s.contains("E"), _py_sci(s))
            .otherwise(s))


def pystr(v: Column, t: Column | None = None) -> Column:
    """``str(value)`` of a scalar; containers use their JSON text; null -> 'None'."""
    return _scalar_str(v, vtype(v) if t is None else t, "None")


def pystrip(s: Column) -> Column:
    return F.regexp_replace(s, _WS_STRIP, "")


def strip_text(s: Column) -> Column:
    """``pystrip`` of a text that is a column: texts that begin and end with a visible ASCII character are left as they are."""
    def visible(c):
        return (c >= "!") & (c <= "~")
    return F.when(visible(F.substring(s, 1, 1)) & visible(F.substring(s, -1, 1)), s).otherwise(pystrip(s))


def pyfloat(v: Column, t: Column | None = None) -> Column:
    """``float(value)``; NULL where Python raises (containers, bad strings, null)."""
    t = vtype(v) if t is None else t
    s = pystrip(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))
    from_str = F.when(s.rlike(_PY_FLOAT), F.regexp_replace(s, "_", "").try_cast("double"))
    return (F.when(t == "VOID", F.lit(None).cast("double"))
            .when(t == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), F.lit(1.0)).otherwise(F.lit(0.0)))
            .when(t == "STRING", from_str)
            .when(t.startswith("OBJECT") | t.startswith("ARRAY"), F.lit(None).cast("double"))
            .otherwise(F.try_variant_get(v, "$", "double")))


def truthy(v: Column, t: Column | None = None) -> Column:
    t = vtype(v) if t is None else t
    return (F.when(t == "VOID", F.lit(False))
            .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            .when(t == "STRING", F.length(F.try_variant_get(v, "$", "string")) > 0)
            .when(t.startswith("OBJECT"), F.size(as_map(v)) > 0)
            .when(t.startswith("ARRAY"), F.size(as_array(v)) > 0)
            .otherwise(F.try_variant_get(v, "$", "double") != 0))


def python_text(value) -> str:
    """``str(value)`` of a decoded VARIANT scalar (decimals are JSON floats); containers as compact JSON."""
    if isinstance(value, Decimal):
        return repr(float(value))
    if isinstance(value, (dict, list)):
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True, default=float)
    return str(value)


def stable_text(value) -> str:
    """Canonical string of a decoded VARIANT, at any depth: '' for null, ``{k:v,…}`` by key, ``[a,b]``."""
    out, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, _Raw):
            out.append(x)
        elif x is None:
            continue
        elif isinstance(x, dict):
            parts: list = [_Raw("{")]
            for i, k in enumerate(sorted(x)):
                parts += [_Raw(("," if i else "") + k + ":"), x[k]]
            todo += reversed([*parts, _Raw("}")])
        elif isinstance(x, list):
            parts = [_Raw("[")]
            for i, v in enumerate(x):
                parts += [_Raw(","), v] if i else [v]
            todo += reversed([*parts, _Raw("]")])
        else:
            out.append(python_text(x))
    return "".join(out)


class _Raw(str):
    """Text that goes out as it is."""


FIELD_SEP = "\u0000"
_INFO = T.ArrayType(T.StructType([T.StructField("s", T.StringType()), T.StructField("f", T.ArrayType(T.StringType()))]))


def _element_rows(array, objects: bool) -> list[tuple] | None:
    if array is None:
        return None
    rows = []
    for x in array.toPython():
        if not objects:
            rows.append((python_text(x), None))
        elif isinstance(x, dict):
            shown = [(k, stable_text(x[k])) for k in sorted(x)]
            rows.append(("{" + ",".join(f"{k}:{v}" for k, v in shown) + "}", [k + FIELD_SEP + v for k, v in shown if v != ""]))
        else:
            rows.append((stable_text(x), []))
    return rows


@F.pandas_udf(_INFO)
def element_info(arrays: pd.Series, objects: pd.Series) -> pd.Series:
    """VARIANT array -> one (s, f) per element.  Object matching: s is the stable string, f the entries
    'key<NUL>stable value' of its non-empty fields, so two elements agree on a field exactly when they share its
    entry.  Primitive matching: s is the element's Python string."""
    return pd.Series([_element_rows(a, bool(o)) for a, o in zip(arrays, objects)])


# Not deterministic in name only: Catalyst then evaluates it once per row and does not repeat it in filters.
element_info = element_info.asNondeterministic()


def _plain_text(v: Column, t: Column, null_as: str) -> Column:
    """``python_text`` of a scalar; SQL NULL for containers and for numbers that Python may print in another form (decimals
    of more than 15 digits or below 0.0001, binary floats)."""
    s = F.try_variant_get(v, "$", "string")
    small = F.abs(F.try_variant_get(v, "$", "double")).between(5e-324, 1e-4)
    return (F.when(t == "VOID", F.lit(null_as)).when(t.isin("STRING", "BIGINT"), s)
            .when(t == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), F.lit("True")).otherwise(F.lit("False")))
            .when(t.rlike(r"^DECIMAL\(([0-9]|1[0-5]),[0-9]+\)$") & ~small, F.when(t.endswith(",0)"), F.concat(s, F.lit(".0"))).otherwise(s)))


def with_element_info(fr: DataFrame, sides: dict[str, str], objects: str, python: bool = True) -> DataFrame:
    """``element_info`` of array<struct<v, t>> columns (``typed``): ``sides`` names result -> array column, ``objects`` the
    column that tells object matching.  Only arrays with an element that expressions cannot render go to Python, or are
    left NULL without ``python``."""
    def fields(e):
        entries = F.map_entries(as_map(e["v"]))
        return F.when(e["t"].startswith("OBJECT"), F.transform(entries, lambda x: F.struct(x["key"].alias("k"), x["value"].alias("v"), vtype(x["value"]).alias("t"))))

    def entry(x):
        return F.struct(x["k"].alias("k"), _plain_text(x["v"], x["t"], "").alias("x"))

    def shown(f):
        text = F.concat(F.lit("{"), F.array_join(F.transform(f, lambda x: F.concat(x["k"], F.lit(":"), x["x"])), ","), F.lit("}"))
        held = F.transform(F.filter(f, lambda x: x["x"] != ""), lambda x: F.concat(x["k"], F.lit(FIELD_SEP), x["x"]))
        return F.struct(text.alias("s"), held.alias("f"))

    def scalar(s):
        return F.struct(s.alias("s"), F.lit(None).cast("array<string>").alias("f"))
    obj = F.col(objects)
    for out, name in sides.items():
        arr, part, text, plain = F.col(name), f"{out}_e", f"{out}_x", f"{out}_p"
        fr = fr.withColumn(part, F.when(obj, F.transform(arr, fields)))
        fr = fr.withColumns({text: F.transform(part, lambda f: F.sort_array(F.transform(f, entry))),
                             plain: F.when(~obj, F.transform(arr, lambda e: _plain_text(e["v"], e["t"], "None")))}).drop(part)
        simple = F.when(obj, ~F.exists(text, lambda f: f.isNull() | F.exists(f, lambda x: x["x"].isNull()))).otherwise(
            ~F.exists(plain, lambda s: s.isNull()))
        fr = fr.withColumn(part, F.coalesce(simple, F.lit(False)))
    # All sides in one projection: they share one Python process a task.
    if python:
        fr = fr.withColumns({f"{out}_r": element_info(F.when(~F.col(f"{out}_e"), F.to_variant_object(F.transform(name, lambda e: e["v"]))), obj)
                             for out, name in sides.items()})
    else:
        fr = fr.withColumns({f"{out}_r": F.lit(None).cast(_INFO) for out in sides})
    for out in sides:
        part, text, plain = f"{out}_e", f"{out}_x", f"{out}_p"
        fr = fr.withColumn(out, F.when(~F.col(part), F.col(f"{out}_r")).when(obj, F.transform(text, shown)).otherwise(
            F.transform(plain, scalar))).drop(part, text, plain, f"{out}_r")
    return fr
