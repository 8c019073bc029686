"""Reductions of gridded values to zones, boundaries and basins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvion.schema import VARIABLE_CODES

_METHODS = {"mean": F.avg, "sum": F.sum, "std": F.stddev_pop}


def attach_zones(
    grid: DataFrame, cell_zone: DataFrame, on: Sequence[str], zone: str = "zone_id"
) -> DataFrame:
    """Give each cell its zone; zone 0 means outside and is dropped.

    No broadcast hint: the lookup has one row per cell and the planner decides
    from its size.
    """
    inside = cell_zone.where(F.col(zone).isNotNull() & (F.col(zone) != 0))
    return grid.join(inside, list(on))


def drop_empty_steps(grid: DataFrame, step: Sequence[str], value: str = "value") -> DataFrame:
    """Drop the steps (variable, time) in which no cell holds a value."""
    alive = grid.where(F.col(value).isNotNull()).select(*step).distinct()
    return grid.join(alive, list(step), "left_semi")


def zonal_reduce(
    df: DataFrame, keys: Sequence[str], value: str = "value", method: str = "mean",
    name: str = "mean_value",
) -> DataFrame:
    """Mean, sum or population deviation per group; an unknown method means mean."""
    reducer = _METHODS.get(method, F.avg)
    return df.groupBy(*keys).agg(reducer(value).alias(name))


def zonal_reduce_live(
    grid: DataFrame, cell_zone: DataFrame, on: Sequence[str], step: Sequence[str], zone: str = "zone_id", value: str = "value",
    method: str = "mean", name: str = "mean_value",
) -> DataFrame:
    """Zonal reduction that drops the steps without any valid cell, in one scan of the grid.

    Cells outside all zones still count for the step, so they stay until after
    the aggregate; the test then runs on the few rows per step and zone.
    """
    reducer = _METHODS.get(method, F.avg)
    zoned = grid.join(cell_zone.select(*on, zone), list(on), "left").withColumn(zone, F.coalesce(zone, F.lit(0)))
    reduced = zoned.groupBy(*step, zone).agg(reducer(value).alias(name), F.count(value).alias("_n"))
    alive = F.sum("_n").over(W.partitionBy(*step))
    return reduced.withColumn("_alive", alive).where((F.col("_alive") > 0) & (F.col(zone) != 0)).drop("_n", "_alive")


def lean_table(
    df: DataFrame, processed_at: str | Column, source_date: str | Column, time: str = "time",
) -> DataFrame:
    """Zone values as the lean long table."""
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(
        F.date_format(time, "yyyyMMdd'T'HH").alias("gtime"),
        F.col("zone_id").cast("int").alias("zone_id"),
        F.lit(1).alias("zone_nu"),
        F.col("variable").cast("int").alias("variable"),
        F.col("mean_value").cast("double").alias("mean_value"),
        as_col(processed_at).alias("processed_at"),
        as_col(source_date).alias("source_date"),
    )


def variable_code(name: Column) -> Column:
    """Code of a variable name, 0 when it is unknown."""
    lookup = F.create_map(*[F.lit(x) for kv in VARIABLE_CODES.items() for x in kv])
    return F.coalesce(F.element_at(lookup, name), F.lit(0))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Weighted mean over the rows that hold a value; NULL without weight."""
    used = F.sum(F.when(value.isNotNull(), weight))
    return F.sum(value * weight) / F.when(used > 0, used)


def latitude_weight(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def weighted_share(condition: Column, value: Column, weight: Column) -> Column:
    """Weighted share of the rows that hold a value and meet the condition."""
    used = F.sum(F.when(value.isNotNull(), weight))
    hit = F.sum(F.when(value.isNotNull(), F.when(condition, weight).otherwise(0.0)))
    return hit / F.when(used > 0, used)


def threshold_share(value: Column, weight: Column, at: float | Column, below: bool = False) -> Column:
    at = F.lit(at) if isinstance(at, (int, float)) else at
    return weighted_share(value <= at if below else value >= at, value, weight)


def weighted_series(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, name: str = "value"
) -> DataFrame:
    """Weighted mean per group; groups without any weight count every cell once."""
    v, w = F.col(value), F.col(weight)
    return (
        df.groupBy(*keys)
        .agg(
            weighted_mean(v, w).alias("_weighted"),
            F.sum(w).alias("_w"),
            F.avg(v).alias("_plain"),
        )
        .select(
            *keys,
            F.when(F.col("_w") > 0, F.col("_weighted")).otherwise(F.col("_plain")).alias(name),
        )
    )


def class_shares(
    df: DataFrame,
    keys: Sequence[str],
    klass: str,
    weight: str,
    classes: Sequence[int],
    prefix: str,
    active: str | None = None,
    gate: float = 0.25,
    neutral: int = 1,
) -> DataFrame:
    """Weighted share of each class.

    With ``active`` (mean cover per group) the shares are weakened by
    ``min(1, active / gate)`` and the rest goes to the neutral class; a group
    without weight is wholly neutral.
    """
    total = F.sum(F.when(F.col(klass).isNotNull(), F.col(weight)))
    aggs = [
        (F.sum(F.when(F.col(klass) == k, F.col(weight)).otherwise(0.0)) / F.when(total > 0, total)).alias(
            f"_s{k}"
        )
        for k in classes
    ]
    extra = [F.avg(active).alias("_active")] if active else []
    grouped = df.groupBy(*keys).agg(*aggs, *extra)
    strength = F.least(F.lit(1.0), F.col("_active") / gate) if active else F.lit(1.0)
    shares = []
    for k in classes:
        share = F.col(f"_s{k}") * strength
        if k == neutral:
            share = F.coalesce(share + (1.0 - strength), F.lit(1.0))
        shares.append(F.coalesce(share, F.lit(0.0)).alias(f"{prefix}{k}"))
    return grouped.select(*keys, *shares)


def tail_minimum(value: Column, weight: Column, floor: float = 0.10) -> Column:
    """Smallest value with at least ``floor`` weight, else the smallest of all."""
    return F.coalesce(F.min(F.when(weight >= floor, value)), F.min(value))


def class_summary(df: DataFrame, keys: Sequence[str], klass: str, level: str) -> DataFrame:
    """Worst level, worst class inside it, modal class and share at that level.

    Cells are first counted per class, so the second step sees a few rows per
    group however large the group is. Ties of the mode take the smallest class.
    """
    counts = df.groupBy(*keys, klass, level).agg(F.count("*").alias("_n"))
    per_class = counts.groupBy(*keys, klass).agg(
        F.sum("_n").alias("_n"), F.max(level).alias(level), F.map_from_entries(
            F.collect_list(F.struct(F.col(level), F.col("_n")))
        ).alias("_by_level"),
    )
    worst = per_class.groupBy(*keys).agg(
        F.max(F.struct(F.col(level), F.col(klass))).alias("_worst"),
        F.max_by(klass, F.struct(F.col("_n"), -F.col(klass))).alias("modal_class"),
        F.sum("_n").alias("_total"),
        F.collect_list(F.struct(F.col("_by_level"))).alias("_levels"),
    )
    at_level = F.aggregate(
        "_levels",
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + F.coalesce(F.element_at(x["_by_level"], F.col(f"_worst.{level}")), F.lit(0)),
    )
    return worst.select(
        *keys,
        F.col(f"_worst.{klass}").alias("max_class"),
        F.col(f"_worst.{level}").alias("max_level"),
        "modal_class",
        (at_level / F.col("_total")).alias("level_fraction"),
    )


def zonal_extremes(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def nearest_cells(zones: DataFrame, cells: DataFrame, zone: str, centre_lat: str, centre_lon: str) -> DataFrame:
    """``(zone, lat, lon)``: the cell nearest to the centre of each zone.

    The nearest row of the latitude axis and the nearest column of the
    longitude axis are found separately, as for a regular grid; the lower
    coordinate wins a tie.
    """
    from pluvion.operators.align import nearest_axis

    near_lat = nearest_axis(zones, centre_lat, cells.select("lat").distinct(), "lat", zone)
    near_lon = nearest_axis(zones, centre_lon, cells.select("lon").distinct(), "lon", zone)
    return near_lat.join(near_lon, zone)


def with_fallback_cells(
    zoned: DataFrame, zones: DataFrame, cells: DataFrame, zone: str, valid: str,
    centre_lat: str = "centre_lat", centre_lon: str = "centre_lon",
) -> DataFrame:
    """Zoned cells where every zone without a valid cell holds its nearest cell instead.

    ``zoned`` is ``cells`` plus the zone column; the result adds ``fallback``.
    Later reductions then need no special case for small zones.
    """
    alive = zoned.where(F.col(valid).isNotNull()).select(zone).distinct()
    empty = zones.join(alive, zone, "left_anti")
    picked = nearest_cells(empty, cells, zone, centre_lat, centre_lon).join(cells, ["lat", "lon"])
    columns = [c for c in zoned.columns]
    kept = zoned.join(alive, zone, "left_semi").withColumn("fallback", F.lit(False))
    return kept.unionByName(picked.select(*columns).withColumn("fallback", F.lit(True)))


def fill_empty_zones(
    zones: DataFrame,
    reduced: DataFrame,
    cells: DataFrame,
    zone: str,
    value: str,
    cell_value: str,
    centre_lat: str = "centre_lat",
    centre_lon: str = "centre_lon",
) -> DataFrame:
    """Zones whose reduction is missing take the value of the cell nearest to their centre."""
    joined = zones.join(reduced.select(zone, value), zone, "left")
    empty = joined.where(F.col(value).isNull()).select(zone, centre_lat, centre_lon)
    picked = (
        nearest_cells(empty, cells, zone, centre_lat, centre_lon)
        .join(cells.select("lat", "lon", F.col(cell_value).alias("_fallback")), ["lat", "lon"], "left")
        .select(zone, "_fallback")
    )
    return joined.join(picked, zone, "left").withColumn(
        value, F.coalesce(F.col(value), F.col("_fallback"))
    ).drop("_fallback")
