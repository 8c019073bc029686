"""Static land-surface parameter table, one wide row per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.operators import terrain
from pluvion.operators.graph import d8_to_ldd

# Constants that are the same in every cell.
CONSTANTS = {
    "cfmax": 3.75653, "g_cfmax": 5.3, "tt": 0.0, "tti": 2.0, "ttm": 0.0, "g_tt": 1.3, "g_sifrac": 0.002, "whc": 0.1,
    "cf_soil": 0.038, "infilt_cap_path": 5.0, "infilt_cap_soil": 600.0,
}
RIVER_FROM_KM2 = 10.0


def parameter_table(cells: DataFrame, spacing_m: float) -> DataFrame:
    """All parameters from row, col, dem, worldcover, sand, silt, clay, bedrock_cm, upa and d8.

    Apart from the slope, which reads the four neighbours, every parameter is a
    row-local expression in one select chain; cells outside the mask (missing or
    non-positive height) keep NULL parameters. ``subcatchment`` is 1 in the
    mask; ``gauge`` and ``pit`` are 1 at the pit with the largest upstream area
    (the first by row and column of several) and NULL elsewhere.
    """
    size = cells.agg(F.struct((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))).scalar()
    rows, cols = size["rows"], size["cols"]
    masked = cells.withColumn("dem", F.when(F.col("dem") > 0, F.col("dem")))
    sloped = terrain.slope(terrain.soil_fractions(masked, ["sand", "silt", "clay"]), "dem", spacing_m)
    inside = F.col("dem").isNotNull()
    river = inside & (F.col("upa") >= RIVER_FROM_KM2)
    shape = terrain.river_geometry(F.col("upa"))
    thick = terrain.soil_thickness(F.col("bedrock_cm"))
    land = terrain.land_parameters(F.col("worldcover"))
    ldd = F.when(inside, d8_to_ldd(F.col("d8"), F.col("row"), F.col("col"), rows, cols))
    first = masked.where((ldd == 5) & F.col("upa").isNotNull()).agg(F.min(F.struct((-F.col("upa")).alias("a"), "row", "col")).alias("v")).scalar()
    outlet = F.when(inside & (F.col("row") == first["row"]) & (F.col("col") == first["col"]), F.lit(1.0))
    columns = {
        "ldd": ldd,
        "subcatchment": F.when(inside, F.lit(1.0)),
        "gauge": outlet,
        "pit": outlet,
        "landuse": F.when(inside, F.col("worldcover")),
        "river": river,
        **{n: F.when(river, c) for n, c in shape.items()},
        "river_bed": F.when(river, F.col("dem") - shape["river_depth"]),
        "river_slope": F.when(river, terrain.clip(F.col("slope"), 1e-5, 0.1)),
        "river_length": F.when(river, F.lit(spacing_m * 1.414)),
        "stream_order": F.when(river, terrain.stream_order(F.col("upa"))),
        **{n: F.when(inside, c) for n, c in terrain.soil_parameters(F.col("sand"), F.col("silt"), F.col("clay")).items()},
        "soil_thickness": F.when(inside, thick),
        "soil_rooting_depth": F.when(inside, terrain.clip(thick * 0.5, 100.0, 1500.0)),
        **{n: F.when(inside, c) for n, c in terrain.conductivity(F.col("sand"), F.col("clay"), thick).items()},
        **{n: F.when(river if n == "n_river" else inside, c) for n, c in land.items()},
        **{n: F.when(inside, F.lit(v)) for n, v in CONSTANTS.items()},
    }
    return sloped.withColumns(columns)
