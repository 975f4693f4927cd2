"""Exact arithmetic helpers for leaderboards.

Percent scores carry one decimal, so boards aggregate them as integer tenths:
sums are exact at any scale and the one final division is a single IEEE
operation, so every engine produces the same double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96  # two-sided 95 % normal quantile used for the confidence interval


def tenths(pct: Column) -> Column:
    """Percent with one decimal -> exact integer tenths.

    Halves away from zero like ``round``, which builds a decimal number per row; ``rint`` takes them to the even side."""
    x = pct * 10.0
    r = F.rint(x)
    return (r + F.when((x > 0) & (x - r == 0.5), F.lit(1.0)).when((x < 0) & (x - r == -0.5), F.lit(-1.0)).otherwise(F.lit(0.0))).cast("long")


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; NULL when den = 0."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def round_ratio(num: Column, den: Column, digits: int = 1) -> Column:
    """Half-up rounding of the exact rational num/den (num >= 0, den > 0)."""
    scale = 10 ** digits
    return F.when(den != 0, F.floor((F.lit(2) * num * scale + den) / (F.lit(2) * den)).cast("double") / float(scale))


def round_half_up(x: Column, digits: int = 1) -> Column:
    scale = float(10 ** digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def ci95(n: Column, s10: Column, ss100: Column) -> tuple[Column, Column]:
    """95 % normal-approximation interval from n, Σ tenths and Σ tenths².

    n < 2 -> (mean, mean) unrounded; otherwise bounds rounded to one digit and
    not clipped.  The variance numerator n·Σx² − (Σx)² is exact in DECIMAL(38,0).
    """
    mean = ratio(s10, n * 10)
    num = (n.cast("decimal(38,0)") * ss100.cast("decimal(38,0)")
           - s10.cast("decimal(38,0)") * s10.cast("decimal(38,0)"))
    var = num.cast("double") / (n * (n - 1)).cast("double") / 100.0
    margin = F.lit(Z) * F.sqrt(var / n.cast("double"))
    lo = F.when(n == 0, F.lit(0.0)).when(n < 2, mean).otherwise(round_half_up(mean - margin, 1))
    hi = F.when(n == 0, F.lit(0.0)).when(n < 2, mean).otherwise(round_half_up(mean + margin, 1))
    return lo, hi


def ci95_values(x: Column) -> tuple[Column, Column]:
    """Aggregate form for arbitrary doubles (any precision): (low, high) of the 95 %
    normal interval; n < 2 gives (mean, mean) unrounded, n = 0 gives (0, 0)."""
    n = F.count(x)
    mean = F.avg(x)
    margin = F.lit(Z) * F.sqrt(F.var_samp(x) / n)
    lo = F.when(n == 0, F.lit(0.0)).when(n < 2, mean).otherwise(F.round(mean - margin, 1))
    hi = F.when(n == 0, F.lit(0.0)).when(n < 2, mean).otherwise(F.round(mean + margin, 1))
    return lo, hi
