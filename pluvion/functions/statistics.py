"""Normal and gamma distribution functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of Hart's double precision normal integral (West 2005).
_HART_TOP = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
_HART_BOTTOM = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)


def _horner(x: Column, coefficients: Sequence[float]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, accurate to about 1e-15."""
    a = F.abs(z)
    density = F.exp(-a * a / 2)
    near = density * _horner(a, _HART_TOP) / _horner(a, _HART_BOTTOM)
    fraction = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    far = density / fraction / 2.506628274631
    tail = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(z > 0, 1.0 - tail).otherwise(tail)


def return_period_thresholds(periods: Sequence[int]) -> Column:
    """Array of ``(rp, threshold)`` with the normal quantile of 1/T."""
    return F.array(
        *[
            F.struct(F.lit(t).alias("rp"), F.lit(NormalDist().inv_cdf(1.0 / t)).alias("threshold"))
            for t in periods
        ]
    )


# Acklam's rational approximation of the normal quantile: the middle, the tails, and where they meet.
_QUANTILE_MIDDLE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239)
_QUANTILE_MIDDLE_UNDER = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_QUANTILE_TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_QUANTILE_TAIL_UNDER = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0)
_QUANTILE_MEET = 0.02425

# Nodes and weights of the integral, and the shape from which on it needs no terms of the series.
_NODES = [(float(x), float(w)) for x, w in zip(*np.polynomial.legendre.leggauss(32))]
_SERIES_BELOW, _TERMS = 8.0, 8
# The integrand is left out where it is below exp(-_DEPTH) of its peak.
_DEPTH = 40.0


def _stirling(a: Column) -> Column:
    inv = 1.0 / a
    square = inv * inv
    return inv * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square * (1 / 1188)))))


def with_gamma_cdf(df: DataFrame, x: Column, shape: Column, scale: Column, name: str) -> DataFrame:
    """``df`` with the gamma distribution function (location 0), to about 1e-11.

    A fixed number of operations a row, all of them generated code. Small
    shapes are raised by eight, which takes eight terms of the series. With
    v = log(t / a) the integrand is exp(a (1 + v - exp(v))), a single smooth
    peak at 0; it is summed at 32 nodes from x to where it has faded, on the
    side away from the peak. NULL or NaN input and shapes or scales that are
    not positive give NaN, values up to 0 give 0.
    """
    clean = lambda c: F.coalesce(c.cast("double"), F.lit(float("nan")))
    t, a, v, half, mid = (F.col(c) for c in ("_gx", "_ga", "_gv", "_gh", "_gm"))
    given = df.withColumns({"_g0": clean(shape), "_gs": clean(scale), "_gx": clean(x)})
    known = ~F.isnan("_g0") & ~F.isnan("_gs") & ~F.isnan("_gx") & (F.col("_g0") > 0) & (F.col("_gs") > 0) & (F.col("_g0") < float("inf"))
    inner = known & (t > 0) & (t / F.col("_gs") > 0) & (t / F.col("_gs") < float("inf"))
    given = given.withColumns({"_gk": known, "_gi": inner}).withColumns(
        {"_gx": F.when(F.col("_gi"), t / F.col("_gs")).otherwise(1.0), "_g0": F.when(F.col("_gi"), F.col("_g0")).otherwise(1.0), "_gt": t}
    )
    given = given.withColumn("_ga", F.when(F.col("_g0") < _SERIES_BELOW, F.col("_g0") + _TERMS).otherwise(F.col("_g0"))).withColumn("_gv", F.log(t / a))
    s = _DEPTH / a
    low, high = -(s + F.sqrt(2.0 * s)), F.log1p(s + F.sqrt(2.0 * s))
    beyond = v + _DEPTH / (a * F.when(v != 0, F.expm1(v)))
    edge = F.when(v <= 0, F.when(v <= low, beyond).otherwise(low)).otherwise(F.when(v >= high, beyond).otherwise(high))
    placed = given.withColumn("_ge", edge).withColumns({"_gh": F.abs(v - F.col("_ge")) / 2.0, "_gm": (v + F.col("_ge")) / 2.0})
    total = F.lit(0.0)
    for node, weight in _NODES:
        at = mid + half * F.lit(node)
        total = total + F.lit(weight) * F.exp(a * (at - F.expm1(at)))
    tail = total * half * F.sqrt(a / (2 * np.pi)) * F.exp(-_stirling(a))
    small = F.col("_g0")
    term = terms = F.lit(1.0)
    rise = F.lit(1.0)
    for k in range(1, _TERMS):
        term = term * t / (small + float(k))
        terms, rise = terms + term, rise * (small + float(k))
    lead = F.exp(small * F.log(t) - t - (a - 0.5) * F.log(a) + a - _stirling(a) - 0.9189385332046727) * rise
    summed = placed.withColumn("_gw", tail)
    whole = F.when(v <= 0, F.col("_gw")).otherwise(1.0 - F.col("_gw")) + F.when(small < _SERIES_BELOW, lead * terms).otherwise(0.0)
    value = F.when(~F.col("_gk"), F.lit(float("nan"))).when(F.col("_gi"), F.least(F.greatest(whole, F.lit(0.0)), F.lit(1.0))).when(F.col("_gt") > 0, 1.0).otherwise(0.0)
    return summed.withColumn(name, value).drop("_g0", "_gs", "_gx", "_gk", "_gi", "_gt", "_ga", "_gv", "_ge", "_gh", "_gm", "_gw")


def with_normal_quantile(df: DataFrame, p: Column, name: str) -> DataFrame:
    """``df`` with the inverse of the standard normal distribution function.

    A rational approximation with one correction step by the distribution
    function itself, on the lower half. 0 and 1 give the infinities, NULL, NaN
    and other values NaN.
    """
    given = df.withColumn("_qp", F.coalesce(p.cast("double"), F.lit(float("nan"))))
    inside = ~F.isnan("_qp") & (F.col("_qp") > 0) & (F.col("_qp") < 1)
    given = given.withColumn("_ql", F.when(inside, F.least(F.col("_qp"), 1.0 - F.col("_qp"))).otherwise(0.5))
    low = F.col("_ql")
    far = F.sqrt(-2.0 * F.log(low))
    near = (low - 0.5) * (low - 0.5)
    middle = (low - 0.5) * _horner(near, _QUANTILE_MIDDLE) / _horner(near, _QUANTILE_MIDDLE_UNDER)
    first = given.withColumn("_qz", F.when(low < _QUANTILE_MEET, _horner(far, _QUANTILE_TAIL) / _horner(far, _QUANTILE_TAIL_UNDER)).otherwise(middle))
    z = F.col("_qz")
    step = first.withColumn("_qu", (normal_cdf(z) - low) * F.lit(float(np.sqrt(2 * np.pi))) * F.exp(z * z / 2.0))
    right = F.when(z > -37, z - F.col("_qu") / (1.0 + z * F.col("_qu") / 2.0)).otherwise(z)
    infinite = F.when(F.col("_qp") == 0, float("-inf")).when(F.col("_qp") == 1, float("inf")).otherwise(float("nan"))
    return step.withColumn(name, F.when(inside, F.when(F.col("_qp") > 0.5, -right).otherwise(right)).otherwise(infinite)).drop("_qp", "_ql", "_qz", "_qu")
