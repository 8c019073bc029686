"""Row selection and projection operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvion.operators.align import wrap_longitude


def region_subset(
    df: DataFrame,
    lat_bounds: tuple[float, float],
    lon_bounds: tuple[float, float],
    buffer: float = 1.0,
    lat: str = "lat",
    lon: str = "lon",
    all_if_empty: bool = False,
) -> DataFrame:
    """Rows in the buffered box, longitudes first brought to -180..180.

    ``all_if_empty`` gives all rows when the box holds none, at the price of a
    second, filtered scan.
    """
    wrapped = df.withColumn(lon, F.when(F.col(lon) > 180, wrap_longitude(F.col(lon))).otherwise(F.col(lon)))
    inside = F.col(lat).between(lat_bounds[0] - buffer, lat_bounds[1] + buffer) & F.col(lon).between(
        lon_bounds[0] - buffer, lon_bounds[1] + buffer
    )
    if not all_if_empty:
        return wrapped.where(inside)
    none = wrapped.where(inside).limit(1).agg((F.count("*") == 0).alias("v")).scalar()
    return wrapped.where(inside | none)


def time_window(df: DataFrame, time: str, start: Column, end: Column) -> DataFrame:
    """Half-open window [start, end)."""
    return df.where((F.col(time) >= start) & (F.col(time) < end))


def split_hindcast(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows marked ``hc_`` in source_date, and the others."""
    marked = F.coalesce(F.startswith(F.col("source_date"), F.lit("hc_")), F.lit(False))
    return df.where(marked), df.where(~marked)


def keep_values(df: DataFrame, column: str, allowed: Iterable) -> DataFrame:
    return df.where(F.col(column).isin(list(allowed)))


def mask_cells(
    df: DataFrame, mask: DataFrame, on: Sequence[str], keep: Column, values: Sequence[str]
) -> DataFrame:
    """Values become NULL in cells that the mask table does not keep or does not list."""
    joined = df.join(mask.select(*on, F.coalesce(keep, F.lit(False)).alias("_keep")), list(on), "left")
    return joined.withColumns(
        {c: F.when(F.col("_keep"), F.col(c)) for c in values}
    ).drop("_keep")


def forecast_window(df: DataFrame, days: int = 18) -> DataFrame:
    """Lean rows whose gtime is one of the ``days`` midnights from source_date on."""
    start = F.to_date(F.try_to_timestamp("source_date", F.lit("yyyyMMdd")))
    at = F.to_date(F.try_to_timestamp("gtime", F.lit("yyyyMMdd'T'HH")))
    offset = F.datediff(at, start)
    return df.where(F.endswith(F.col("gtime"), F.lit("T00")) & offset.between(0, days - 1))


def forecast_summary(df: DataFrame, days: int = 18) -> DataFrame:
    """Records, dates and missing dates of the window per source date and variable."""
    inside = forecast_window(df, days)
    found = inside.groupBy("source_date", "variable", "gtime").agg(F.count("*").alias("_n"))
    every = df.groupBy("source_date", "variable").agg(F.count("*").alias("original_records"))
    got = found.groupBy("source_date", "variable").agg(
        F.sum("_n").alias("forecast_records"), F.count("*").alias("actual_dates")
    )
    zero = F.lit(0).cast("bigint")
    return every.join(got, ["source_date", "variable"], "left").select(
        "source_date",
        "variable",
        "original_records",
        F.coalesce("forecast_records", zero).alias("forecast_records"),
        F.coalesce("actual_dates", zero).alias("actual_dates"),
        (F.lit(days).cast("bigint") - F.coalesce("actual_dates", zero)).alias("missing_dates"),
    )


def inside_box(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def precipitation_like(value: Column) -> Column:
    """Fill values and negative amounts become 0."""
    return F.when(value.isNull() | F.isnan(value) | (value < 0), 0.0).otherwise(value)


def first_available(df: DataFrame, *choices: tuple[str, callable], default: Column) -> Column:
    """Coalesce over the choices whose column exists, in order, then the default."""
    found = [make(F.col(name)) for name, make in choices if name in df.columns]
    return F.coalesce(*found, default)


def soft_columns(df: DataFrame, prefix: str, k: int) -> Column | None:
    """Array of ``prefix_p1..k`` when all exist; NULL for a row that lacks one."""
    names = [f"{prefix}_p{i}" for i in range(1, k + 1)]
    if not all(n in df.columns for n in names):
        return None
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(n).isNotNull()
    return F.when(whole, F.array(*[F.col(n).cast("double") for n in names]))
