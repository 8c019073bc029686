"""Extents, site matching, overlap shares, rasters and gauges. Polygons are rows with a ring of points; see ``polygons``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvion.functions.decision import bound
from pluvion.operators.polygons import points_in_polygons


def bounding_box(ring: Column) -> Column:
    """Struct west, south, east, north of a point array."""
    x = F.transform(ring, lambda p: p["lon"])
    y = F.transform(ring, lambda p: p["lat"])
    return F.struct(
        F.array_min(x).alias("west"), F.array_min(y).alias("south"), F.array_max(x).alias("east"), F.array_max(y).alias("north")
    )


def snapped_extent(points: DataFrame, lon: str, lat: str, res: float) -> DataFrame:
    """Extent of all points widened to whole cells, with the grid size."""
    low = lambda c: F.floor(F.min(c) / res) * res
    high = lambda c: F.ceil(F.max(c) / res) * res
    box = points.agg(low(lon).alias("west"), low(lat).alias("south"), high(lon).alias("east"), high(lat).alias("north"))
    size = lambda a, b: F.round((F.col(b) - F.col(a)) / res).cast("bigint")
    return box.withColumns({"n_cols": size("west", "east"), "n_rows": size("south", "north")})


def rasterise(cells: DataFrame, polygons: DataFrame, key: str, ring: str, order: str, tile: float, cell: Sequence[str]) -> DataFrame:
    """Polygon of each cell centre; of overlapping ones the last in ``order`` wins."""
    hits = points_in_polygons(cells, polygons, key, ring, tile, carry=[order])
    return hits.groupBy(*cell).agg(F.max_by(key, order).alias(key))


def overlap_shares(basin_cells: DataFrame, country_cells: DataFrame, basin: str, country: str, cell: Sequence[str]) -> DataFrame:
    """Cells of each basin inside each country and their share of the basin's cells."""
    size = basin_cells.groupBy(basin).agg(F.count("*").alias("n_cells"))
    both = basin_cells.join(country_cells, list(cell)).groupBy(basin, country).agg(F.count("*").alias("n_shared"))
    return both.join(size, basin).select(basin, country, "n_shared", (F.col("n_shared") / F.col("n_cells")).alias("share"))


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two bounding boxes touch."""
    return (
        (a["west"] <= b["east"]) & (b["west"] <= a["east"]) & (a["south"] <= b["north"]) & (b["south"] <= a["north"])
    )


def nearest_site(
    sites: DataFrame, entries: DataFrame, site: str, entry: str, cutoff: float, lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """Nearest entry of each site within ``cutoff`` degrees; the lower id wins a tie.

    Both sides are keyed by squares of the cutoff size, so only neighbours meet.
    """
    at = lambda c: F.floor(F.col(c) / cutoff).cast("bigint")
    step = F.sequence(F.lit(-1), F.lit(1))
    asked = (
        sites.select(site, F.col(lon).alias("_x"), F.col(lat).alias("_y"), at(lon).alias("a"), at(lat).alias("b"))
        .withColumn("i", F.explode(step)).withColumn("j", F.explode(step))
        .select(site, "_x", "_y", (F.col("a") + F.col("i")).alias("sx"), (F.col("b") + F.col("j")).alias("sy"))
    )
    offered = entries.select(entry, F.col(lon).alias("_ex"), F.col(lat).alias("_ey"), at(lon).alias("sx"), at(lat).alias("sy"))
    dist = F.sqrt(F.pow(F.col("_x") - F.col("_ex"), 2) + F.pow(F.col("_y") - F.col("_ey"), 2))
    return (
        asked.join(offered, ["sx", "sy"])
        .withColumn("distance", dist)
        .where(F.col("distance") <= cutoff)
        .groupBy(site)
        .agg(F.min(F.struct("distance", entry)).alias("_m"))
        .select(site, F.col(f"_m.{entry}").alias(entry), F.col("_m.distance").alias("distance"))
    )


def inverse_distance(
    cells: DataFrame, gauges: DataFrame, cell: Sequence[str], x: str, y: str, value: str, power: int = 2, floor: float = 1e6, most: int = 1000
) -> DataFrame:
    """Gauge values spread over cells with weight 1 / max(d^2, floor)^power.

    Gauges are a short list (a handful of stations); they travel as one array,
    so the cells are read once and never shuffled. More than ``most`` gauges are
    refused: every gauge bears on every cell, and a larger network has to be
    thinned by its owner rather than here.
    """
    few = F.when(F.count("*") <= most, F.lit(True)).otherwise(F.raise_error(F.lit(f"more than {most} gauges")).cast("boolean"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("gauge"), F.col("x"), F.col("y"), F.col(value).alias("v"))))
    stations = gauges.limit(most + 1).agg(F.when(few, listed).alias("s")).scalar()
    weighted = F.transform(
        "_s",
        lambda g: F.struct(
            (1.0 / F.pow(F.greatest(F.pow(F.col(x) - g["x"], 2) + F.pow(F.col(y) - g["y"], 2), F.lit(floor)), F.lit(power))).alias("w"),
            g["v"].alias("v"),
        ),
    )
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda a, g: a + g["w"])
    mean = lambda w: bound(total(w), lambda t: F.aggregate(w, F.lit(0.0), lambda a, g: a + g["w"] / t * g["v"]))
    return cells.withColumn("_s", stations).select(*cell, bound(weighted, mean).alias(value))


def representative_inside(polygons: DataFrame, domain: DataFrame, key: str, dom_key: str, ring: str, tile: float) -> DataFrame:
    """Polygons whose representative point lies in the domain; all of them when none does."""
    pts = polygons.select(key, F.col("rep_lon").alias("lon"), F.col("rep_lat").alias("lat"))
    kept = points_in_polygons(pts, domain, dom_key, ring, tile).select(key).distinct()
    any_kept = kept.agg((F.count("*") > 0).alias("v")).scalar()
    marked = polygons.join(kept.withColumn("_in", F.lit(True)), key, "left")
    return marked.where(F.col("_in") | ~any_kept).drop("_in")
