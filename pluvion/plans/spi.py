"""Standardised precipitation index from monthly totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.functions.statistics import with_gamma_cdf, with_normal_quantile
from pluvion.operators import temporal

# Largest absolute index.
LIMIT = 8.21
# Records whose values do not differ have no fit.
NO_SPREAD = 1e-9


def calibrate(df: DataFrame, keys: Sequence[str], month: str, value: str, start: int, end: int) -> DataFrame:
    """Gamma shape and scale (approximate maximum likelihood) and dry share per key and calendar month.

    Only three means leave the aggregate, whatever the length of the record.
    """
    x = F.col(value)
    wet = F.when(x > 0, x)
    means = (
        df.where(F.col(month).between(start, end))
        .groupBy(*keys, (F.col(month) % 12).alias("season"))
        .agg(F.avg(wet).alias("_m"), F.avg(F.log(wet)).alias("_l"), F.avg((x == 0).cast("double")).alias("dry"))
    )
    a = F.log("_m") - F.col("_l")
    shape = (1.0 + F.sqrt(1.0 + 4.0 * a / 3.0)) / (4.0 * a)
    return means.withColumn("shape", F.when(a > NO_SPREAD, shape)).select(
        *keys, "season", "shape", (F.col("_m") / F.col("shape")).alias("scale"), "dry"
    )


def standardise(df: DataFrame, value: str, shape: str, scale: str, dry: str, name: str) -> DataFrame:
    """``df`` with dry share plus wet gamma probability as a normal quantile within the limit; NULL where a part is missing."""
    wet = with_gamma_cdf(df, F.col(value), F.col(shape), F.col(scale), "_wet")
    told = with_normal_quantile(wet, F.col(dry) + (1.0 - F.col(dry)) * F.col("_wet"), "_z")
    z = F.nanvl("_z", F.lit(None))
    return told.withColumn(name, F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-LIMIT)), F.lit(LIMIT)))).drop("_wet", "_z")


def index(
    df: DataFrame, keys: Sequence[str], month: str, value: str, window: int, start: int, end: int, name: str = "spi"
) -> DataFrame:
    """Index over ``window`` months; months without a full window or fit are NULL.

    ``month`` is a running month number, so gaps count as missing months.
    """
    rolled = temporal.rolling_months(df.select(*keys, month, value), keys, month, value, window, "mean", "_acc")
    fit = calibrate(rolled, keys, month, "_acc", start, end)
    joined = rolled.withColumn("season", F.col(month) % 12).join(fit, [*keys, "season"], "left")
    return standardise(joined, "_acc", "shape", "scale", "dry", name).select(*keys, month, name)
