"""Table schemas, required-column guards and the missing-value rule."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAN_LONG = T.StructType(
    [
        T.StructField("gtime", T.StringType()),
        T.StructField("zone_id", T.IntegerType()),
        T.StructField("zone_nu", T.IntegerType()),
        T.StructField("variable", T.IntegerType()),
        T.StructField("mean_value", T.DoubleType()),
        T.StructField("processed_at", T.StringType()),
        T.StructField("source_date", T.StringType()),
    ]
)
LEAN_COLUMNS = [field.name for field in LEAN_LONG]
LEAN_REQUIRED = ["gtime", "zone_id", "variable", "mean_value"]

# Variable names and their codes.
VARIABLE_CODES = {"imerg": 1, "pet": 2, "chirps": 3, "riverdepth": 4, "streamflow": 5}


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail early, with all missing names, when a table lacks needed columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; table has {df.columns}")
    return df


def with_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Rename ``old -> new`` where only the old name is present."""
    for old, new in aliases.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def missing_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn NaN into NULL so that aggregates skip it and comparisons are false."""
    wanted = set(columns) if columns is not None else None
    floats = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        and (wanted is None or f.name in wanted)
    ]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats}) if floats else df


def fill_to_null(value: Column, below: float = -9000.0, fills: Sequence[float] = ()) -> Column:
    """NULL for NaN, values under ``below`` and the listed fill values."""
    bad = F.isnan(value) | (value < F.lit(below))
    for fill in fills:
        bad = bad | (value == F.lit(fill))
    return F.when(~bad, value)
