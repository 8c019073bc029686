"""File listings and incremental state: discovery, skip rules, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_dated_folder(names: DataFrame, name: str, prefix: str) -> DataFrame:
    """Latest eight-digit date after the prefix, NULL when there is none."""
    date = F.regexp_extract(name, f"^{prefix}([0-9]{{8}})$", 1)
    return names.agg(F.max(F.when(date != "", date)).alias("latest"))


def middle_date_per_month(dates: DataFrame, date: str) -> DataFrame:
    """Middle one of the distinct dates of each month (position count div 2)."""
    days = dates.select(date).distinct().withColumn("month", F.substring(date, 1, 6))
    order = W.partitionBy("month").orderBy(date)
    whole = W.partitionBy("month")
    return (
        days.withColumn("_i", F.row_number().over(order) - 1)
        .withColumn("n_dates", F.count("*").over(whole))
        .where(F.col("_i") == F.floor(F.col("n_dates") / 2))
        .select("month", date, "n_dates")
    )


def first_steps(df: DataFrame, step: str, n: int = 9) -> DataFrame:
    """The first ``n`` distinct steps of an axis."""
    return df.select(step).distinct().orderBy(step).limit(n)


def manifest_status(source: DataFrame, target: DataFrame, name: str = "name", size: str = "size") -> DataFrame:
    """``skip`` where the target holds the same name and size, else ``upload``."""
    stored = target.select(name, F.col(size).alias("_stored"))
    return source.join(stored, name, "left").select(
        name,
        size,
        F.when(F.col("_stored") == F.col(size), "skip").otherwise("upload").alias("status"),
    )


def not_processed(work: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    return work.join(done, list(on), "left_anti")


def rows_after_last(work: DataFrame, existing: DataFrame, key: str, day: str) -> DataFrame:
    """Rows later than the last day already held for their key; all rows of new keys."""
    last = existing.groupBy(key).agg(F.max(day).alias("_last"))
    return (
        work.join(last, key, "left")
        .where(F.col("_last").isNull() | (F.col(day) > F.col("_last")))
        .drop("_last")
    )


def upsert_steps(existing: DataFrame, fresh: DataFrame, axis: DataFrame, step: str, var: str, value: str) -> DataFrame:
    """Fresh steps that the axis has replace the existing ones of their variable.

    Variables whose fresh values are all missing change nothing.
    """
    usable = fresh.groupBy(var).agg(F.count(value).alias("_n")).where(F.col("_n") > 0).select(var)
    taken = fresh.join(axis.select(step).distinct(), step, "left_semi").join(usable, var, "left_semi")
    kept = existing.join(taken.select(var, step).distinct(), [var, step], "left_anti")
    return kept.select(*existing.columns).unionByName(taken.select(*existing.columns))


def distinct_inits(df: DataFrame, init: str) -> DataFrame:
    """Start times seen so far, in order."""
    return df.select(init).distinct().orderBy(init)


def infer_year(folder: Column) -> Column:
    """Year named by a folder."""
    return F.regexp_extract(folder, r"((?:19|20)[0-9]{2})", 1).try_cast("int")
