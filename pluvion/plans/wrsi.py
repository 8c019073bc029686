"""Crop water satisfaction: 100 times actual over potential evaporation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvion.operators import temporal


def ratio(actual: Column, potential: Column) -> Column:
    """100 * actual / potential within 0..150; NULL without potential."""
    raw = 100.0 * actual / F.when(potential > 1e-6, potential)
    return F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(0.0)), F.lit(150.0)))


def period(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Over all time; missing actual values add nothing."""
    sums = df.groupBy(*keys).agg(
        F.coalesce(F.sum("aet"), F.lit(0.0)).alias("aet"), F.coalesce(F.sum("pet"), F.lit(0.0)).alias("pet")
    )
    return sums.withColumn("wrsi", ratio(F.col("aet"), F.col("pet")))


def annual(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    sums = temporal.yearly(df, keys, day, ["aet", "pet"])
    return sums.withColumn("wrsi", ratio(F.col("aet"), F.col("pet")))


def season_to_date(df: DataFrame, keys: Sequence[str], day: str, step: int = 10) -> DataFrame:
    """Running ratio since the start of the year of each bin."""
    bins = temporal.resample_days(df, keys, day, ["aet", "pet"], step)
    run = temporal.year_to_date(bins, keys, "bin", ["aet", "pet"])
    return run.withColumn("wrsi", ratio(F.col("aet"), F.col("pet")))


def latest_season_to_date(df: DataFrame, keys: Sequence[str], day: str, step: int = 10) -> DataFrame:
    """Season-to-date ratio at the last bin.

    Only the bins of its year count, so the rows before the first of them are
    dropped before any sum instead of running a window over all years.
    """
    first = df.agg(F.min(day).alias("v")).scalar()
    last = df.agg(F.max(day).alias("v")).scalar()
    number = lambda d: F.floor(F.datediff(d, first) / step).cast("int")
    start_of = lambda n: F.date_add(first, n * step)
    placed = df.withColumn("_bin", start_of(number(F.col(day))))
    current = placed.where(F.year("_bin") == F.year(start_of(number(last))))
    latest = period(current, keys)
    return df.select(*keys).distinct().join(latest, list(keys), "left")


def band_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shares under 50, 50 to 80 and from 80, with both forms of the mean.

    The mean of the cell ratios and the ratio of the summed water differ; both
    are in use and both are given.
    """
    w = F.col("wrsi")
    pct = lambda cond: F.avg(F.when(cond, 100.0).otherwise(0.0))
    return (
        df.where(w.isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n_cells"),
            F.avg(w).alias("mean_of_ratios"),
            (100.0 * F.sum("aet") / F.sum("pet")).alias("ratio_of_means"),
            pct(w < 50).alias("pct_failed"),
            pct((w >= 50) & (w < 80)).alias("pct_stressed"),
            pct(w >= 80).alias("pct_good"),
        )
    )
