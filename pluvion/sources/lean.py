"""Lean long table: readers, append with dedupe, sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvion.schema import LEAN_LONG, LEAN_REQUIRED, VARIABLE_CODES, missing_to_null, require_columns, with_aliases


def normalise(df: DataFrame) -> DataFrame:
    """Known aliases renamed, required columns checked, NaN to NULL."""
    df = with_aliases(df, {"zones_id": "zone_id"})
    return missing_to_null(require_columns(df, LEAN_REQUIRED))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalise(spark.read.parquet(path))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Lean CSV with unknown variable codes dropped and gtime parsed."""
    return known_variables(spark.read.schema(LEAN_LONG).csv(path, header=True))


def known_variables(df: DataFrame) -> DataFrame:
    return normalise(df.where(F.col("variable").isin(list(VARIABLE_CODES.values())))).withColumn(
        "time", F.try_to_timestamp("gtime", F.lit("yyyyMMdd'T'HH"))
    )


def append_distinct(existing: DataFrame, fresh: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Union without repeated rows.

    By default whole rows count, processed_at included, so a rerun in another
    hour is kept; ``subset`` narrows the comparison.
    """
    both = existing.unionByName(fresh)
    return both.dropDuplicates(list(subset)) if subset else both.dropDuplicates()


def append_snapshot(
    spark: SparkSession, fresh: DataFrame, current: str | None, target: str, subset: Sequence[str] | None = None
) -> DataFrame:
    """Write existing plus fresh rows, deduplicated, as a new snapshot folder.

    The target must not be the folder being read: a lost executor may need to
    read the source again while the target is being written.
    """
    if current is not None and current.rstrip("/") == target.rstrip("/"):
        raise ValueError("a snapshot cannot overwrite the folder it reads")
    merged = append_distinct(read_parquet(spark, current), fresh, subset) if current else (
        fresh.dropDuplicates(list(subset)) if subset else fresh.dropDuplicates()
    )
    write_parquet(merged, target)
    return spark.read.parquet(target)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, folder: str, stamp: str) -> str:
    """CSV under a time-stamped folder; returns its path."""
    path = f"{folder.rstrip('/')}/{stamp}"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def sort_lean(df: DataFrame, *then: str) -> DataFrame:
    """Rows in order of time, zone and variable, then of the given columns."""
    return df.orderBy("gtime", "zone_id", "variable", *then)
