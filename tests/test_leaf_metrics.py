"""Golden leaf metrics (FIXTURES.md §5.2) and the 95 % CI cases (§5.3)."""

import json
import math

import pytest
from pyspark.sql import functions as F

from leafwise.functions import leaf as LF
from leafwise.functions.stats import ci95, ci95_values

NUMBER_CASES = [
    (100, 104, 1.0), (100, 105, 1.0), (100, 110, 0.947368), (100, 150, 0.526316), (100, 200, 0.0),
    (-10, 10, 0.0), (0, 0.04, 1.0), (0, 0.06, 0.0), ("abc", 1, 0.0), ("1,000", 1000, 0.0), ("12", 12, 1.0),
    (True, 1, 1.0), ("NaN", "NaN", 0.0), ("Infinity", "Infinity", 1.0), (5, "Infinity", 0.0), ("1_000", 1000, 1.0),
]
LEAF_CASES = [
    (True, "false", "boolean", 1.0), (False, "", "boolean", 1.0), (False, "false", "boolean", 0.0),
    (None, None, "string", 1.0), (None, "x", "string", 0.0), (0, None, "integer", 0.0),
    (" a\t", "a", "string", 1.0), (True, "true", "string", 0.75), ("kitten", "sitting", "string", 0.571429),
    ("", "abc", "string", 0.0), ("", "", "string", 1.0), ("한국어", "한국인", "string", 0.666667),
    (1.0, "1.0", "string", 1.0), (100, 101, "string", 0.666667),
]


def _v(x):
    return json.dumps(x)


@pytest.mark.parametrize("a,p,expected", NUMBER_CASES)
def test_number(spark, a, p, expected):
    df = spark.createDataFrame([(_v(a), _v(p))], "a string, p string")
    r = df.select(LF.number_score(F.parse_json("a"), F.parse_json("p")).alias("s")).first()
    assert r["s"] == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize("a,p,ftype,expected", LEAF_CASES)
def test_leaf(spark, a, p, ftype, expected):
    df = spark.createDataFrame([(_v(a), _v(p), ftype)], "a string, p string, t string")
    r = df.select(LF.leaf_score(F.parse_json("a"), F.parse_json("p"), F.col("t")).alias("s")).first()
    assert r["s"] == pytest.approx(expected, abs=1e-6)


def test_nan_strings_follow_python(spark):
    # Python float() accepts 'nan' / 'inf' and '1_000' but not '1d'
    df = spark.createDataFrame([(_v("1d"), _v(1))], "a string, p string")
    assert df.select(LF.number_score(F.parse_json("a"), F.parse_json("p"))).first()[0] == 0.0


CI_CASES = [([], 0.0, 0.0), ([80.04], 80.04, 80.04), ([90, 100], 85.2, 104.8), ([93.1, 88.4, 0.0, 97.7], 24.0, 115.6)]


@pytest.mark.parametrize("scores,lo,hi", CI_CASES)
def test_ci95_values(spark, scores, lo, hi):
    df = spark.createDataFrame([(float(s),) for s in scores], "x double") if scores else \
        spark.createDataFrame([], "x double")
    lo_c, hi_c = ci95_values(F.col("x"))
    r = df.agg(lo_c.alias("lo"), hi_c.alias("hi")).first()
    assert r["lo"] == pytest.approx(lo, abs=1e-9) and r["hi"] == pytest.approx(hi, abs=1e-9)


@pytest.mark.parametrize("scores,lo,hi", [c for c in CI_CASES if all(round(s, 1) == s for s in c[0])])
def test_ci95_tenths(spark, scores, lo, hi):
    """Board form over exact integer tenths (scores carry one decimal)."""
    t = [round(s * 10) for s in scores]
    df = spark.createDataFrame([(len(t), sum(t), sum(x * x for x in t))], "n long, s long, ss long")
    lo_c, hi_c = ci95(F.col("n"), F.col("s"), F.col("ss"))
    r = df.select(lo_c.alias("lo"), hi_c.alias("hi")).first()
    assert r["lo"] == pytest.approx(lo, abs=1e-9) and r["hi"] == pytest.approx(hi, abs=1e-9)
    assert not math.isnan(r["lo"])
