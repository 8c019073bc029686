"""Land-surface parameters per cell: slope, rivers, soil, land cover, channel burn-in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values per land class: surface roughness, river roughness, light extinction,
# rooting depth (mm), paved share, leaf storage, wood storage, base leaf area.
LAND_COLUMNS = ["n_surface", "n_river", "kext", "rooting_depth", "path_frac", "leaf_storage", "wood_storage", "lai_base"]
LAND_CLASSES = {
    10: (0.15, 0.05, 0.65, 2000.0, 0.0, 0.12, 0.5, 5.0),
    20: (0.10, 0.04, 0.60, 1000.0, 0.0, 0.08, 0.2, 2.5),
    30: (0.05, 0.035, 0.50, 600.0, 0.0, 0.04, 0.0, 1.5),
    40: (0.04, 0.035, 0.55, 800.0, 0.05, 0.05, 0.05, 2.0),
    50: (0.02, 0.03, 0.60, 200.0, 0.60, 0.02, 0.0, 0.5),
    60: (0.03, 0.03, 0.50, 100.0, 0.1, 0.01, 0.0, 0.2),
    70: (0.03, None, None, None, None, None, None, None),
    80: (0.01, 0.03, 0.50, None, 0.0, None, 0.0, None),
    90: (0.10, 0.04, 0.55, 500.0, 0.0, 0.06, 0.1, 2.0),
    95: (0.08, None, None, None, None, None, None, None),
    100: (0.03, None, None, None, None, None, None, None),
}
LAND_DEFAULTS = (0.05, 0.035, 0.55, 500.0, 0.0, 0.04, 0.0, None)
# Share of the base leaf area in each month and the default leaf area.
LAI_MONTHS = (0.85, 0.90, 0.95, 1.00, 0.95, 0.80, 0.65, 0.55, 0.65, 0.80, 0.90, 0.90)
LAI_DEFAULT = 1.0
# Lower area limits (km2) of the stream orders 1 to 8.
ORDER_AREAS = (10, 50, 100, 500, 1000, 2000, 3000, 4000)
# Soil depths (mm) of the conductivity layers and the layer factors.
LAYER_DEPTHS = (25, 125, 300, 750)
LAYER_FACTORS = (1.0, 0.95, 0.90, 0.85)
# Medians used when no valid river value exists.
RIVER_DEFAULTS = {"river_length": 1000.0, "river_width": 30.0, "river_depth": 1.0, "river_slope": 1e-3, "n_river": 0.035}
# Channel width and depth (m) of the stream orders, upstream area (km2) of the entries.
ORDER_WIDTH = {2: 15.0, 3: 30.0, 4: 60.0, 5: 120.0, 6: 180.0, 7: 240.0}
ORDER_DEPTH = {2: 0.5, 3: 1.0, 4: 1.5, 5: 2.5, 6: 3.5, 7: 4.5}
ORDER_UPSTREAM = {2: 24.0, 3: 95.0, 4: 375.0, 5: 1500.0}
# Defaults of the orders the tables lack.
DEFAULT_WIDTH, DEFAULT_DEPTH, DEFAULT_UPSTREAM = 15.0, 0.5, 24.0
# Roughness of the daily land classes 0 to 8.
DAILY_ROUGHNESS = (0.025, 0.080, 0.035, 0.055, 0.038, 0.045, 0.013, 0.028, 0.010)
# Depth burned where only the drainage layer marks a channel (m).
GAP_DEPTH = 0.3


def clip(value: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def gradients(grid: DataFrame, height: str, spacing: float, block: int = 64) -> DataFrame:
    """``grid`` with ``dy`` and ``dx``: central differences along rows and columns, one-sided at the ends of the grid.

    Cells are dealt out once, by blocks of ``block`` x ``block``; a cell at the
    side of its block also goes to the block beside it, as its halo. Every
    neighbour then lies in the same block, so nothing else is shuffled. Missing
    neighbours inside the grid give NULL.
    """
    ends = grid.agg(F.struct(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("row", "col")])).scalar()
    br, bc = (F.floor(F.col(c) / block).cast("bigint") for c in ("row", "col"))
    place = lambda a, b, own: F.struct((br + a).alias("br"), (bc + b).alias("bc"), F.lit(own).alias("own"))
    at = lambda c, b, side: F.col(c) - b * block == side
    places = F.array_compact(F.array(
        place(0, 0, True), F.when(at("row", br, 0), place(-1, 0, False)), F.when(at("row", br, block - 1), place(1, 0, False)),
        F.when(at("col", bc, 0), place(0, -1, False)), F.when(at("col", bc, block - 1), place(0, 1, False)),
    ))
    dealt = grid.withColumn("_p", F.explode(places)).withColumns({"_br": F.col("_p.br"), "_bc": F.col("_p.bc")}).repartition("_br", "_bc")

    def gradient(along: str, across: str):
        line = Window.partitionBy("_br", "_bc", across).orderBy(along)
        h = F.col(height)
        before = F.when(F.lag(along).over(line) == F.col(along) - 1, F.lag(h).over(line))
        after = F.when(F.lead(along).over(line) == F.col(along) + 1, F.lead(h).over(line))
        return (
            F.when(F.col(along) == ends[f"min_{along}"], (after - h) / F.lit(spacing))
            .when(F.col(along) == ends[f"max_{along}"], (h - before) / F.lit(spacing))
            .otherwise((after - before) / F.lit(spacing * 2.0))
        )

    both = dealt.withColumn("dy", gradient("row", "col")).withColumn("dx", gradient("col", "row"))
    return both.where("_p.own").drop("_p", "_br", "_bc")


def slope(grid: DataFrame, height: str, spacing: float, zero_outside: bool = True) -> DataFrame:
    """Slope of the surface within 1e-4..1; missing heights count as 0 when asked."""
    filled = grid.withColumn("_h", F.coalesce(height, F.lit(0.0)) if zero_outside else F.col(height))
    both = gradients(filled, "_h", spacing)
    steep = clip(F.sqrt(F.pow("dx", 2) + F.pow("dy", 2)), 1e-4, 1.0)
    return both.withColumn("slope", F.when(F.col(height).isNotNull(), steep)).drop("_h", "dx", "dy")


def river_geometry(area: Column) -> dict[str, Column]:
    """Width and depth of a river from its upstream area."""
    return {
        "river_width": clip(1.22 * F.pow(area, F.lit(0.557)), 30.0, 500.0),
        "river_depth": clip(0.27 * F.pow(area, F.lit(0.39)), 1.0, 5.0),
    }


def stream_order(area: Column) -> Column:
    """Order 0 under 10 km2, then one more per band."""
    order = F.lit(0)
    for limit in ORDER_AREAS:
        order = order + F.when(area >= limit, 1).otherwise(0)
    return order


def soil_parameters(sand: Column, silt: Column, clay: Column) -> dict[str, Column]:
    """Water contents and the layer exponents from texture fractions."""
    total = sand + clay + silt
    s = F.when(total > 0, sand / total).otherwise(0.33)
    c = F.when(total > 0, clay / total).otherwise(0.33)
    index = clip(0.131 + 0.00125 * s * 100 - 0.00207 * c * 100, 0.1, 0.5)
    exponent = clip(1.0 / (1.0 + index), 0.05, 0.2)
    out = {
        "theta_s": clip(0.332 - 0.0007251 * s * 100 + 0.1276 * F.log10(c * 100 + 1), 0.35, 0.55),
        "theta_r": clip(0.01 + 0.003 * c * 100, 0.05, 0.25),
    }
    for i, factor in enumerate(LAYER_FACTORS, start=1):
        out[f"c_{i}"] = 7.5 + 6.5 * exponent * factor
    return out


def conductivity(sand: Column, clay: Column, thickness: Column) -> dict[str, Column]:
    """Base conductivity by texture, its decay with depth and the layer values."""
    base = F.when(sand > 0.6, 2000.0).when(clay > 0.4, 50.0).otherwise(500.0)
    decay = clip(0.001 + 0.003 * clay, 0.0003, 0.01)
    out = {"ksat": base, "decay": decay, "m_param": clip(thickness / decay, 50.0, 1500.0)}
    for i, depth in enumerate(LAYER_DEPTHS, start=1):
        out[f"kv_{i}"] = clip(base * F.exp(-decay * depth), 1.0, 5000.0)
    return out


def soil_fractions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Texture as fractions: percentages are divided by 100.

    The table mean of the sum decides: a sum that would fall under 0.5 after the
    division shows that the table holds fractions already.
    """
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    mean = df.agg((F.avg(total) / 100.0).alias("v")).scalar()
    return df.withColumns({c: F.when(mean < 0.5, F.col(c)).otherwise(F.col(c) / 100.0) for c in columns})


def soil_thickness(bedrock_cm: Column) -> Column:
    """Bedrock depth in cm to soil thickness in mm; 2000 where no depth is known."""
    return F.coalesce(clip(bedrock_cm * 10, 300.0, 2500.0), F.lit(2000.0))


def land_parameters(klass: Column) -> dict[str, Column]:
    """All land-class lookups with their defaults."""
    out = {}
    for i, name in enumerate(LAND_COLUMNS):
        known = {k: v[i] for k, v in LAND_CLASSES.items() if v[i] is not None}
        table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
        default = LAND_DEFAULTS[i]
        value = F.element_at(table, klass)
        out[name] = value if default is None else F.coalesce(value, F.lit(default))
    out["water_frac"] = F.when(klass == 80, 1.0).otherwise(0.0)
    return out


def monthly_leaf_area(df: DataFrame, key: Sequence[str], base: str) -> DataFrame:
    """``(key, month, lai)``; classes without leaf area take the default in every month."""
    months = F.array(*[F.struct(F.lit(m).alias("month"), F.lit(f).alias("f")) for m, f in enumerate(LAI_MONTHS, 1)])
    long = df.select(*key, base, F.inline(months))
    value = F.col(base) * F.col("f")
    return long.select(*key, "month", F.when(value > 0, value).otherwise(LAI_DEFAULT).alias("lai"))


def main_outlet(df: DataFrame, key: str, code: str, area: str) -> DataFrame:
    """Pit with the largest upstream area; the lower cell wins a tie."""
    pit = F.col(code) == 5
    return df.where(pit).agg(
        F.max_by(key, F.struct(F.coalesce(area, F.lit(0.0)), -F.col(key))).alias(key),
        F.max(F.coalesce(area, F.lit(0.0))).alias(area),
    )


def repair_river(df: DataFrame, river: str, columns: Sequence[str]) -> DataFrame:
    """River cells take the river median for missing values; other cells 0."""
    from pluvion.operators.quantiles import exact_quantiles

    out = {}
    for c in columns:
        on = F.col(river) & F.col(c).isNotNull()
        middle = exact_quantiles(df.where(on).select(c), [], c, [0.5], "m").agg(F.max("m").alias("v")).scalar()
        fill = F.coalesce(middle, F.lit(RIVER_DEFAULTS.get(c, 0.0)))
        out[c] = F.coalesce(c, F.when(F.col(river), fill).otherwise(0.0))
    return df.withColumns(out)


def repair_land(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing and zero values take the median of the others, 0 when there is none."""
    from pluvion.operators.quantiles import exact_quantiles

    out = {}
    for c in columns:
        valid = F.col(c).isNotNull() & (F.col(c) != 0)
        middle = exact_quantiles(df.where(valid).select(c), [], c, [0.5], "m").agg(F.max("m").alias("v")).scalar()
        out[c] = F.when(valid, F.col(c)).otherwise(F.coalesce(middle, F.lit(0.0)))
    return df.withColumns(out)


def box_area_km2(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Rough area of a degree box by the kilometres per degree at its middle."""
    mid = F.radians((south + north) * 0.5)
    return (east - west) * 111.0 * F.cos(mid) * (north - south) * 111.0


def grid_points(low: float, high: float, step: float) -> int:
    """Points of a target axis."""
    return int((high - low) / step) + 1


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG number of the UTM zone of a position."""
    zone = F.floor((lon + 180.0) / 6.0).cast("int") + 1
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def sealed_fraction(built: Column) -> Column:
    """Sealed share of a built-surface value in square metres per hectare."""
    return clip(built / 10000.0, 0.0, 1.0)


def burn_channels(
    cells: DataFrame, footprint: DataFrame, cell: Sequence[str], height: str, depth: str, drainage: str
) -> DataFrame:
    """Channel depth, burned height and initial water per cell.

    The deepest channel over a cell counts; cells on the drainage layer without
    a channel take the gap depth.
    """
    deepest = footprint.groupBy(*cell).agg(F.max(depth).alias("_d"))
    layer = F.when(F.col("_d").isNotNull(), F.col("_d")).when(F.col(drainage) == 0, GAP_DEPTH).otherwise(0.0)
    return (
        cells.join(deepest, list(cell), "left")
        .withColumn("channel_depth", layer)
        .withColumn("burned", F.col(height) - F.col("channel_depth"))
        .withColumn("initial_water", F.coalesce(F.greatest(F.col(height) - F.col("burned"), F.lit(0.0)), F.lit(0.0)))
        .drop("_d")
    )


def depth_above_ground(depth: Column, burned: Column, original: Column) -> Column:
    """Water over the ground before the burn-in, never negative; missing is 0."""
    return F.coalesce(F.greatest(burned + depth - original, F.lit(0.0)), F.lit(0.0))


def class_histogram(df: DataFrame, klass: str) -> DataFrame:
    """Cells and percentage per class."""
    total = df.agg(F.count("*").alias("v")).scalar()
    return df.groupBy(klass).agg(F.count("*").alias("n_cells")).withColumn("pct", 100.0 * F.col("n_cells") / total)


def code_lookup(code: Column, table: dict, default) -> Column:
    """Value of a code; codes outside the table take the default."""
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(known, code), F.lit(default))


def daily_roughness(df: DataFrame, klass: str, name: str = "roughness") -> DataFrame:
    """Roughness of the daily land classes; unknown classes take the median over the cells."""
    from pyspark.sql import Window as W

    table = dict(enumerate(DAILY_ROUGHNESS))
    value = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(klass))
    counts = df.select(value.alias("n")).where("n IS NOT NULL").groupBy("n").agg(F.count("*").alias("c"))
    # At most nine distinct values are left, so this window is tiny.
    order = W.partitionBy(F.lit(1)).orderBy("n")
    ranked = counts.withColumns(
        {"hi": F.sum("c").over(order), "total": F.sum("c").over(W.partitionBy(F.lit(1)))}
    )
    left, right = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = ranked.agg(
        ((F.min(F.when(F.col("hi") > left, F.col("n"))) + F.min(F.when(F.col("hi") > right, F.col("n")))) / 2).alias("v")
    ).scalar()
    return df.withColumn(name, F.coalesce(value, middle))
