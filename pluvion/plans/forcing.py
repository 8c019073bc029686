"""Daily rain, temperature and evaporation on a model grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.operators.align import apply_weights
from pluvion.operators.filters import precipitation_like
from pluvion.operators.hydro import not_negative
from pluvion.schema import fill_to_null


def daily_forcing(hourly: DataFrame, clip_evaporation: bool = True) -> DataFrame:
    """Daily fields of (row, col) from sub-daily metres, kelvins and downward evaporation metres."""
    day = hourly.groupBy("row", "col", F.to_date("time").alias("day")).agg(
        (F.sum("tp") * 1000.0).alias("precip"), (F.avg("t2m") - 273.15).alias("temp"), (F.sum("pev") * -1000.0).alias("pet")
    )
    return day.withColumn("pet", not_negative(F.col("pet"))) if clip_evaporation else day


def on_model_grid(daily: DataFrame, weights: DataFrame, mask: DataFrame | None = None, key: str = "cell") -> DataFrame:
    """Bilinear fields on the model cells, all three variables in one pass over the weights.

    With a mask table only its cells remain; it is applied to the weights, so
    cells outside it are never computed.
    """
    used = weights if mask is None else weights.join(mask.select(key), key, "left_semi")
    return apply_weights(daily, used, key, ["precip", "temp", "pet"], ["day"])


def clean_fills(df: DataFrame) -> DataFrame:
    """Fill and negative values become 0 in rain and evaporation and stay in temperature."""
    return df.withColumns({c: precipitation_like(fill_to_null(F.col(c))) for c in ("precip", "pet")})
