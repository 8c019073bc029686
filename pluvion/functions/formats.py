"""Number texts of the zone files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tenths(value: Column) -> Column:
    """Nearest whole number of tenths of the exact binary value, halves to even.

    Ten times a double is 8x + 2x, both exact; the rounding error of their sum
    is recovered so that a product that merely rounds to a half is not taken
    for one.
    """
    a, b = value * 8.0, value * 2.0
    s = a + b
    t = s - a
    err = (a - (s - t)) + (b - t)
    low = F.floor(s)
    part = s - low
    up = (part > 0.5) | ((part == 0.5) & ((err > 0) | ((err == 0) & (low % 2 != 0))))
    return F.when(up, low + 1).otherwise(low)


def _one_decimal(tenths: Column) -> Column:
    t = tenths.cast("bigint")
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def zone_value_text(value: Column) -> Column:
    """One decimal for positive values, ``0`` for everything else and for missing."""
    positive = value.isNotNull() & ~F.isnan(value) & (value > 0)
    return F.when(positive, _one_decimal(_tenths(value))).otherwise("0")


def gauge_value_text(value: Column) -> Column:
    """``0.0`` up to 0.01 and for missing, else rounded to a tenth."""
    small = value.isNull() | F.isnan(value) | (value <= 0.01)
    return F.when(small, "0.0").otherwise(_one_decimal(F.rint(value * 10.0)))
