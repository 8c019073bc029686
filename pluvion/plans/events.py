"""Flood event hydrographs and yearly water satisfaction of documented drought events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.operators import hydro, temporal
from pluvion.operators.spatial import inverse_distance
from pluvion.plans.wrsi import ratio
from pluvion.session import spread


def event_hydrographs(entries: DataFrame, gauges: DataFrame, key: str, rain: str = "rain", step_s: float = 1800.0) -> DataFrame:
    """Flow and stage per entry and half hour.

    Entries have x, y, area_km2 and bed. Gauge totals are spread to the entries,
    shaped by the storm profile, turned into runoff and routed by a triangular
    unit hydrograph of each entry's size. An event has 48 steps, so an entry is
    one row with short arrays until the steps are written out; entries are
    dealt out over the cores before.
    """
    c = hydro.EVENT_CHANNEL
    totals = inverse_distance(spread(entries), gauges, [key, "area_km2", "bed"], "x", "y", rain)
    scale = F.col(rain) / 1000.0 / step_s * hydro.RUNOFF_SHARE * F.col("area_km2") * 1e6
    flow = F.transform(F.array(*[F.lit(p) for p in hydro.storm_profile()]), lambda p: p * F.col("_scale"))
    shape = hydro.triangle("fixed", hydro.concentration_hours(F.col("area_km2")), step_s / 3600.0)
    arrays = totals.withColumn("_scale", scale).withColumns({"_flow": flow, "_uh": shape})
    routed = arrays.select(key, "bed", F.posexplode(hydro.convolve_arrays(F.col("_flow"), F.col("_uh"))).alias("step", "q"))
    stage = hydro.wide_channel_stage(F.col("q"), F.col("bed"), c["n"], c["width"], c["slope"])
    return routed.select(key, "step", "q", stage.alias("stage"))


def event_table(balance: DataFrame, registry: DataFrame, zone: str, cell: Sequence[str], day: str) -> DataFrame:
    """Mean water satisfaction per basin and year, tagged with the documented event years.

    ``registry`` has the zone, the event name and its years; basins without any
    water balance show as missing. The mean is over the cell ratios.
    """
    yearly = temporal.yearly(balance, [zone, *cell], day, ["aet", "pet"]).withColumn("wrsi", ratio(F.col("aet"), F.col("pet")))
    days = balance.select(zone, day).distinct().groupBy(zone, F.year(day).alias("year")).agg(F.count("*").alias("n_days"))
    basin = yearly.groupBy(zone, "year").agg(
        F.bround(F.avg("wrsi"), 1).alias("wrsi"), F.bround(F.avg("aet"), 0).alias("aet_mm"), F.bround(F.avg("pet"), 0).alias("pet_mm")
    ).join(days, [zone, "year"])
    return registry.join(basin, zone, "left").select(
        zone, "event", F.when(F.col("year").isNull(), "MISSING").otherwise("OK").alias("status"), "year", "wrsi", "aet_mm", "pet_mm", "n_days",
        F.coalesce(F.array_contains("event_years", F.col("year")), F.lit(False)).alias("event_year"),
    )
