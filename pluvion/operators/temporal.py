"""Time-series operators: resampling, accumulation, seasons, extension, merging, gaps.

Series are keyed (cell, zone, river) with one row per step after the resampling
aggregates, so a window over one series is as long as its calendar, however
many raw rows the key had.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# First letters of the months, January first.
MONTH_LETTERS = "JFMAMJJASOND"


# ---------------------------------------------------------------- resampling

def daily(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    sums: Sequence[str] = (),
    means: Sequence[str] = (),
) -> DataFrame:
    """Daily sums and means of sub-daily readings."""
    return df.groupBy(*keys, F.to_date(time).alias("day")).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means]
    )


def ensemble_daily_mean(
    df: DataFrame, keys: Sequence[str], member: str, time: str, value: str
) -> DataFrame:
    """Daily sum per member, then the mean over the members."""
    per_member = daily(df, [*keys, member], time, sums=[value])
    return per_member.groupBy(*keys, "day").agg(F.avg(value).alias(value))


def yearly(df: DataFrame, keys: Sequence[str], day: str, sums: Sequence[str]) -> DataFrame:
    """Sums per calendar year; a year with only missing values sums to 0."""
    return df.groupBy(*keys, F.year(day).alias("year")).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums], F.count("*").alias("n_rows")
    )


def resample_days(
    df: DataFrame, keys: Sequence[str], day: str, sums: Sequence[str], step: int = 10
) -> DataFrame:
    """Sums over bins of ``step`` days that start at the first day of the data.

    Every series gets every bin up to the last day; bins without rows hold 0.
    """
    first = df.agg(F.min(day).alias("v")).scalar()
    last = df.agg(F.max(day).alias("v")).scalar()
    number = F.floor(F.datediff(F.col(day), F.col("_first")) / step).cast("int")
    binned = (
        df.withColumn("_first", first)
        .groupBy(*keys, number.alias("_n"))
        .agg(*[F.sum(c).alias(c) for c in sums])
    )
    top = F.floor(F.datediff(last, first) / step).cast("int")
    axis = (
        df.select(*keys)
        .distinct()
        .withColumn("_first", first)
        .withColumn("_n", F.explode(F.sequence(F.lit(0), top)))
    )
    return axis.join(binned, [*keys, "_n"], "left").select(
        *keys,
        F.expr(f"date_add(_first, _n * {step})").alias("bin"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in sums],
    )


def month_index(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def year_to_date(df: DataFrame, keys: Sequence[str], step: str, sums: Sequence[str]) -> DataFrame:
    """Running sums inside the calendar year of each step."""
    order = W.partitionBy(*keys, F.year(step)).orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.sum(c).over(order) for c in sums})


def rolling_months(
    df: DataFrame, keys: Sequence[str], month: str, value: str, n: int, how: str = "sum", name: str = "acc"
) -> DataFrame:
    """Accumulation over the last ``n`` months; NULL unless all of them hold a value."""
    order = W.partitionBy(*keys).orderBy(month).rangeBetween(-(n - 1), 0)
    agg = F.avg if how == "mean" else F.sum
    return df.withColumn(
        name, F.when(F.count(value).over(order) == n, agg(value).over(order))
    )


def running_total(df: DataFrame, keys: Sequence[str], step: str, amount: Column, name: str) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(amount).over(order))


# ---------------------------------------------------------------- seasons

def season_codes(months: DataFrame, month: str) -> DataFrame:
    """``(month, season)`` for the distinct months of a time axis.

    The code joins the letters of the two earlier rows of the year and the row
    itself. The first two months have no such rows and take NDJ and DJF; a
    December without them looks ahead.
    """
    axis = months.select(month).distinct()
    letter = F.substring(F.lit(MONTH_LETTERS), F.month(month), F.lit(1))
    in_year = W.partitionBy(F.year(month)).orderBy(month)
    ahead = W.partitionBy(F.lit(1)).orderBy(month)
    number = F.month(month)
    return (
        axis.withColumn("_l", letter)
        .withColumn("_a", F.lag("_l", 2).over(in_year))
        .withColumn("_b", F.lag("_l", 1).over(in_year))
        .withColumn("_next", F.concat(F.lead("_l", 1).over(ahead), F.lead("_l", 2).over(ahead)))
        .select(
            month,
            F.when(F.col("_a").isNotNull(), F.concat("_a", "_b", "_l"))
            .when(number == 1, "NDJ")
            .when(number == 2, "DJF")
            .when(number == 12, F.coalesce(F.concat(F.lit("D"), F.col("_next")), F.lit("DJF")))
            .alias("season"),
        )
    )


def trend_slope(
    df: DataFrame, keys: Sequence[str], position: str, value: str, steps: int, name: str = "slope"
) -> DataFrame:
    """Least-squares slope over the steps; needs all of them and at least two."""
    complete = (F.count(value) == steps) & (F.lit(steps) >= 2)
    return df.groupBy(*keys).agg(
        F.when(complete, F.regr_slope(F.col(value), F.col(position).cast("double"))).alias(name)
    )


# ---------------------------------------------------------------- events

def first_onset(
    bins: DataFrame,
    keys: Sequence[str],
    step: str,
    value: str,
    start: Column,
    end: Column,
    amount: float = 25.0,
    follow: float = 20.0,
) -> DataFrame:
    """First bin of the window with enough rain, confirmed by the next two bins."""
    nxt = W.partitionBy(*keys).orderBy(step).rowsBetween(1, 2)
    ok = (
        (F.col(step) >= start)
        & (F.col(step) <= end)
        & (F.col(value) >= amount)
        & (F.col("_follow") >= follow)
    )
    return (
        bins.withColumn("_follow", F.coalesce(F.sum(value).over(nxt), F.lit(0.0)))
        .groupBy(*keys)
        .agg(F.min(F.when(ok, F.col(step))).alias("onset"))
    )


def growing_degrees(
    df: DataFrame, onset: DataFrame, keys: Sequence[str], day: str, temp: str, end: Column, base: float = 10.0
) -> DataFrame:
    """Sum of degrees above the base from the onset to the end day."""
    gain = F.greatest(F.col(temp) - base, F.lit(0.0))
    return (
        df.where(F.col(day) <= end)
        .join(onset.where(F.col("onset").isNotNull()), list(keys))
        .where(F.col(day) >= F.col("onset"))
        .groupBy(*keys, "onset")
        .agg(F.coalesce(F.sum(F.when(F.col(temp).isNotNull(), gain)), F.lit(0.0)).alias("gdd"))
    )


# ---------------------------------------------------------------- extension and merging

def carry_last(df: DataFrame, keys: Sequence[str], day: str, values: Sequence[str], days: int = 16) -> DataFrame:
    """Series followed by ``days`` copies of the last row of each key."""
    last = df.groupBy(*keys).agg(
        F.max(day).alias("_last"), *[F.max_by(c, day).alias(c) for c in values]
    )
    tail = last.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(days)))).select(
        *keys, F.expr("date_add(_last, _i)").alias(day), *values
    )
    return df.select(*keys, day, *values).unionByName(tail)


def fill_from_latest(
    wanted: DataFrame, df: DataFrame, keys: Sequence[str], day: str, value: str
) -> DataFrame:
    """Wanted days that lack a value take that of the latest day, even earlier ones.

    Keys without any value stay out.
    """
    latest = df.groupBy(*keys).agg(F.max_by(value, day).alias("_latest"))
    missing = (
        wanted.select(*keys, day).distinct().join(df.select(*keys, day), [*keys, day], "left_anti")
        .join(latest, list(keys))
        .select(*keys, day, F.col("_latest").alias(value))
    )
    return df.select(*keys, day, value).unionByName(missing)


def repeat_pattern(
    df: DataFrame, keys: Sequence[str], day: str, values: Sequence[str], pattern: int = 15, days: int = 16
) -> DataFrame:
    """Series followed by ``days`` days that cycle through the last ``pattern`` rows."""
    back = W.partitionBy(*keys).orderBy(F.col(day).desc())
    last = df.select(*keys, day, *values).withColumn("_rank", F.row_number().over(back)).where(
        F.col("_rank") <= pattern
    )
    sized = last.join(
        last.groupBy(*keys).agg(F.count("*").alias("_k"), F.max(day).alias("_last")), list(keys)
    )
    tail = (
        sized.withColumn("_pos", F.col("_k") - F.col("_rank"))
        .withColumn(
            "_i",
            F.explode(F.filter(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: i % F.col("_k") == F.col("_pos"))),
        )
        .select(*keys, F.expr("date_add(_last, _i + 1)").alias(day), *values)
    )
    return df.select(*keys, day, *values).unionByName(tail)


def cutoff_merge(history: DataFrame, fresh: DataFrame, keys: Sequence[str], step: str) -> DataFrame:
    """History strictly before the first fresh step of the key, then all fresh rows."""
    first = fresh.groupBy(*keys).agg(F.min(step).alias("_cut"))
    kept = (
        history.join(first, list(keys), "left")
        .where(F.col("_cut").isNull() | (F.col(step) < F.col("_cut")))
        .drop("_cut")
    )
    return kept.unionByName(fresh.select(*kept.columns))


def append_after_last(history: DataFrame, fresh: DataFrame, keys: Sequence[str], step: str) -> DataFrame:
    """History, then only the fresh rows after its last step."""
    last = history.groupBy(*keys).agg(F.max(step).alias("_end"))
    added = (
        fresh.join(last, list(keys), "left")
        .where(F.col("_end").isNull() | (F.col(step) > F.col("_end")))
        .drop("_end")
    )
    return history.unionByName(added.select(*history.columns))


def replace_range(existing: DataFrame, fresh: DataFrame, day: str, start: Column, end: Column) -> DataFrame:
    """Existing rows outside [start, end], then all fresh rows."""
    kept = existing.where((F.col(day) < start) | (F.col(day) > end))
    return kept.unionByName(fresh.select(*existing.columns))


def missing_days(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Days between the first and last day of a key that have no row."""
    span = df.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    expected = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias(day))
    return expected.join(df.select(*keys, day), [*keys, day], "left_anti")


def gap_summary(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Expected, present and missing day counts per key."""
    days = df.select(*keys, day).distinct()
    return days.groupBy(*keys).agg(
        (F.datediff(F.max(day), F.min(day)) + 1).cast("bigint").alias("expected_days"),
        F.count("*").alias("present_days"),
    ).withColumn("missing_days", F.col("expected_days") - F.col("present_days"))


def _neighbours(keys, step, value):
    base = W.partitionBy(*keys).orderBy(step)
    before = base.rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(*keys).orderBy(F.desc(step)).rowsBetween(W.unboundedPreceding, 0)  # grows row by row, unlike an open end
    at = F.when(F.col(value).isNotNull(), F.col(step))
    return (
        F.last(at, True).over(before),
        F.last(value, True).over(before),
        F.last(at, True).over(after),
        F.last(value, True).over(after),
    )


def interpolate_days(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Daily series with gaps filled linearly; after the last value it is held."""
    span = df.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    axis = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias(day))
    full = axis.join(df.select(*keys, day, value), [*keys, day], "left")
    d0, v0, d1, v1 = _neighbours(keys, day, value)
    part = F.datediff(F.col(day), F.col("_d0")) / F.datediff("_d1", "_d0")
    return full.withColumns({"_d0": d0, "_v0": v0, "_d1": d1, "_v1": v1}).select(
        *keys,
        day,
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(F.col("_v0").isNotNull() & F.col("_v1").isNull(), F.col("_v0"))
        .when(
            F.col("_v0").isNotNull() & F.col("_v1").isNotNull(),
            F.col("_v0") + (F.col("_v1") - F.col("_v0")) * part,
        )
        .alias(value),
    )


def interpolate_onto(
    df: DataFrame, targets: DataFrame, keys: Sequence[str], step: str, value: str
) -> DataFrame:
    """Values at the target steps: linear between, held before the first and after the last.

    ``step`` is numeric (seconds, step number).
    """
    both = df.select(*keys, step, value, F.lit(False).alias("_want")).unionByName(
        targets.select(*keys, step, F.lit(None).cast("double").alias(value), F.lit(True).alias("_want"))
    )
    merged = both.groupBy(*keys, step).agg(F.max(value).alias(value), F.bool_or("_want").alias("_want"))
    d0, v0, d1, v1 = _neighbours(keys, step, value)
    part = (F.col(step) - F.col("_d0")) / (F.col("_d1") - F.col("_d0"))
    return (
        merged.withColumns({"_d0": d0, "_v0": v0, "_d1": d1, "_v1": v1})
        .where("_want")
        .select(
            *keys,
            step,
            F.when(F.col(value).isNotNull(), F.col(value))
            .when(F.col("_v0").isNull(), F.col("_v1"))
            .when(F.col("_v1").isNull(), F.col("_v0"))
            .otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * part)
            .alias(value),
        )
    )


def minmax_normalise(df: DataFrame, value: str, name: str, default: float = 0.7) -> DataFrame:
    """(v - min) / (max - min) clipped to 0..1; ``default`` where no value is given."""
    low = df.agg(F.min(value).alias("v")).scalar()
    high = df.agg(F.max(value).alias("v")).scalar()
    part = (F.col(value) - low) / (high - low + F.lit(1e-10))
    return df.withColumn(
        name,
        F.when(F.col(value).isNull(), F.lit(default)).otherwise(F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0))),
    )


def share_of_total(df: DataFrame, keys: Sequence[str], step: str, value: str, name: str = "share") -> DataFrame:
    """Share of each step in the total of its key; equal shares when the total is 0."""
    per_step = df.groupBy(*keys, step).agg(F.sum(value).alias(value))
    whole = W.partitionBy(*keys)
    total = F.sum(value).over(whole)
    steps = F.count("*").over(whole)
    return per_step.select(
        *keys, step, value, F.coalesce(F.col(value) / F.when(total > 0, total), 1.0 / steps).alias(name)
    )
