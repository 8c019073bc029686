"""Basin nodes of the crop branch: water satisfaction, vegetation and crop phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvion.functions import categories as C
from pluvion.functions.soft import phase_soft
from pluvion.operators import temporal, zonal
from pluvion.operators.quantiles import weighted_median
from pluvion.session import cut_lineage

# Stress limit, cover gate, critical vegetation anomaly, guard share, warning share, maturity.
STRESS_BELOW, COVER_GATE = 80.0, 0.25
CRITICAL_Z, GUARD_SHARE, WARN_SHARE = -1.0, 0.10, 0.25
MATURITY_DEGREES = 1500.0


def _weighted(df: DataFrame, cover: str | None) -> DataFrame:
    return df.withColumn("_w", F.col(cover) if cover else F.lit(1.0))


def _median(df: DataFrame, zone: str, value: str, cover: str | None) -> DataFrame:
    """Weighted median by cover, plain interpolated median without."""
    from pluvion.operators.quantiles import exact_quantiles

    if cover:
        return weighted_median(df, [zone], value, "_w", "_median")
    return exact_quantiles(df, [zone], value, [0.5], "_median").drop("q")


def wrsi_node(
    zoned: DataFrame, zones: DataFrame, cells: DataFrame, zone: str = "zone_id", value: str = "wrsi", cover: str | None = "crop"
) -> DataFrame:
    """Water satisfaction node per basin.

    ``cells`` has lat, lon, the value and the cover; ``zoned`` adds the zone.
    Basins without a valid cell use the cell nearest to their centre.
    """
    rows = _weighted(zonal.with_fallback_cells(zoned, zones, cells, zone, value), cover)
    v, w = F.col(value), F.col("_w")
    rows = cut_lineage(rows.withColumn("_k", F.when(v.isNotNull(), C.wrsi_index(v))))  # three reductions read them
    live = rows.where(v.isNotNull())
    shares = zonal.class_shares(rows, [zone], "_k", "_w", [1, 2, 3, 4], "w10_p", "_w" if cover else None, COVER_GATE)
    stats = rows.groupBy(zone).agg(
        F.avg("_w").alias("_active"),
        zonal.tail_minimum(v, F.when(v.isNotNull(), w)).alias("_min"),
        zonal.weighted_share(v < STRESS_BELOW, v, w).alias("_stress"),
        F.sum(F.when(v.isNotNull(), w)).alias("_total"),
    )
    usable = F.coalesce(F.col("_total"), F.lit(0.0)) > 0
    out = zones.select(zone).join(stats, zone, "left").join(_median(live, zone, value, cover), zone, "left").join(shares, zone, "left")
    middle = F.when(usable, F.col("_median"))
    return out.select(
        zone,
        F.bround("_active", 4).alias("crop_active_frac") if cover else F.lit(None).cast("double").alias("crop_active_frac"),
        F.bround(middle, 2).alias("wrsi10_value"),
        C.state_label(C.wrsi_index(middle), C.WRSI_STATES).alias("wrsi10_class"),
        F.bround(F.when(usable, F.col("_min")), 2).alias("wrsi10_min"),
        F.bround("_stress", 4).alias("wrsi10_stress_prob"),
        *[F.bround(F.coalesce(f"w10_p{k}", F.lit(1.0 if k == 1 else 0.0)), 4).alias(f"w10_p{k}") for k in (1, 2, 3, 4)],
    )


def critical_cells(z: Column, change: Column | None = None, average: Column | None = None) -> Column:
    """Critical vegetation, with the drop guard where both guard grids are given."""
    critical = F.coalesce(z < CRITICAL_Z, F.lit(False))
    if change is None or average is None:
        return critical
    return critical & F.coalesce(change < -GUARD_SHARE * average, F.lit(False))


def vegetation_node(
    zoned: DataFrame, zones: DataFrame, zone: str = "zone_id", value: str = "z", critical: str = "critical",
    cover: str | None = "crop", guard: str = "none",
) -> DataFrame:
    """Vegetation node per basin; basins without data are Unknown."""
    rows = _weighted(zoned, cover)
    v, w = F.col(value), F.col("_w")
    rows = rows.withColumn("_k", F.when(v.isNotNull(), C.fpar_index(v)))
    shares = zonal.class_shares(rows, [zone], "_k", "_w", [1, 2, 3, 4, 5], "fpar_p", "_w" if cover else None, COVER_GATE)
    stats = rows.groupBy(zone).agg(
        F.avg("_w").alias("_active"),
        zonal.tail_minimum(v, F.when(v.isNotNull(), w)).alias("_min"),
        zonal.weighted_share(F.col(critical), v, w).alias("_crit"),
        F.sum(F.when(v.isNotNull(), w)).alias("_total"),
    )
    usable = F.coalesce(F.col("_total"), F.lit(0.0)) > 0
    live = rows.where(v.isNotNull())
    out = zones.select(zone).join(stats, zone, "left").join(_median(live, zone, value, cover), zone, "left").join(shares, zone, "left")
    middle = F.when(usable, F.col("_median"))
    return out.select(
        zone,
        F.bround("_active", 4).alias("crop_active_frac") if cover else F.lit(None).cast("double").alias("crop_active_frac"),
        F.bround(middle, 3).alias("fpar_value"),
        C.state_label(C.fpar_index(middle), C.FPAR_STATES).alias("fpar_class"),
        F.bround(F.when(usable, F.col("_min")), 3).alias("fpar_min"),
        F.bround("_crit", 4).alias("fpar_critical_share"),
        F.coalesce(F.col("_crit") > WARN_SHARE, F.lit(False)).alias("fpar_warn"),
        F.lit(guard).alias("fpar_guard"),
        *[F.bround(F.coalesce(f"fpar_p{k}", F.lit(1.0 if k == 1 else 0.0)), 4).alias(f"fpar_p{k}") for k in range(1, 6)],
    )


def phase_node(
    daily: DataFrame, zones: DataFrame, target: Column, zone: str = "zone_id", window_days: int = 150,
    onset_mm: float = 25.0, follow_mm: float = 20.0, base: float = 10.0, maturity: float = MATURITY_DEGREES,
) -> DataFrame:
    """Crop phase per basin from daily cells with zone, day, precip, temp and crop cover."""
    start = F.date_sub(target, window_days)
    inside = daily.where((F.col("day") >= start) & (F.col("day") <= target))
    rain = zonal.weighted_series(inside, [zone, "day"], "precip", "crop", "precip")
    warm = zonal.weighted_series(inside, [zone, "day"], "temp", "crop", "temp")
    bins = temporal.resample_days(rain, [zone], "day", ["precip"])
    onset = temporal.first_onset(bins, [zone], "bin", "precip", start, target, onset_mm, follow_mm)
    degrees = temporal.growing_degrees(warm, onset, [zone], "day", "temp", target, base)
    stage = F.col("gdd") / maturity
    active = F.coalesce(F.col("onset").isNotNull() & (stage <= 1.0), F.lit(False))
    out = zones.select(zone).join(degrees, zone, "left").withColumn("_p", phase_soft(F.when(active, stage)))
    return out.select(
        zone,
        F.date_format(target, "yyyy-MM-dd").alias("target_date"),
        F.coalesce(F.date_format("onset", "yyyy-MM-dd"), F.lit("")).alias("onset_date"),
        F.bround("gdd", 1).alias("gdd"),
        F.bround(stage, 3).alias("stage_frac"),
        C.state_label(F.array_position("_p", F.array_max("_p")), C.PHASE_STATES).alias("phase"),
        active.alias("season_active"),
        *[F.bround(F.col("_p")[i], 4).alias(f"phase_p{i + 1}") for i in range(3)],
    )
