"""Drought evidence table per district from observed and forecast index grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvion.functions import categories as C
from pluvion.functions import dates
from pluvion.functions.soft import add_soft_columns
from pluvion.operators import ensemble, temporal, zonal
from pluvion.operators.quantiles import exact_quantiles
from pluvion.session import cut_lineage


def observed(obs: DataFrame, last: Column, months: int = 6, clip_at: float = 4.0) -> DataFrame:
    """Current value and trend per zone from monthly cells.

    ``obs`` has zone_id, lat, m (month number), spi and fallback; ``last`` is the
    window's last month, one value or a column that is constant in a zone. Zones
    that stand on their nearest cell only have no trend.
    """
    window = obs.withColumns({"_last": last, "spi": ensemble.clip(F.col("spi"), clip_at)}).where(
        (F.col("m") > F.col("_last") - months) & (F.col("m") <= F.col("_last"))
    )
    monthly = cut_lineage(window.groupBy("zone_id", "m").agg(
        zonal.weighted_mean(F.col("spi"), zonal.latitude_weight(F.col("lat"))).alias("v"),
        F.bool_or("fallback").alias("fallback"), F.max("_last").alias("_last"),
    ))
    slopes = temporal.trend_slope(monthly.where(~F.col("fallback")), ["zone_id"], "m", "v", months, "slope")
    current = monthly.where(F.col("m") == F.col("_last")).select("zone_id", F.col("v").alias("current_spi3"))
    return current.join(slopes, "zone_id", "left")


def forecast_cells(fcst: DataFrame, threshold: str | float, rp: str = "rp", members: int = 25, clip_at: float = 4.0) -> DataFrame:
    """Ensemble statistics per cell over leads and members.

    ``threshold`` is the deficit limit: a number, or the name of a per-cell
    column for the seasonal form. The return-period crossing always uses ``rp``.
    """
    rows = ensemble.first_members(fcst, members).withColumn("spi", ensemble.clip(F.col("spi"), clip_at))
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    spi = F.col("spi")
    below = F.coalesce(spi <= limit, F.lit(False))
    per_lead = rows.groupBy("zone_id", "cell", "lat", "lead", "fallback").agg(
        F.avg(below.cast("double")).alias("p"), F.avg(spi).alias("mean"), F.min(spi).alias("low"), F.max(spi).alias("high"),
        F.stddev_pop(spi).alias("spread"), F.bool_or(F.coalesce(spi <= F.col(rp), F.lit(False))).alias("cross"),
    )
    first = lambda c: F.min_by(c, "lead")
    return per_lead.groupBy("zone_id", "cell", "lat", "fallback").agg(
        F.max("p").alias("p_deficit"), first("p").alias("p_lead1"), first("mean").alias("mean_l1"), first("low").alias("min_l1"),
        first("high").alias("max_l1"), first("spread").alias("spread"), F.min("low").alias("ens_min"),
        F.bool_or("cross").cast("double").alias("cross"),
    )


def forecast(cells: DataFrame) -> DataFrame:
    """Area-weighted district values of the cell statistics."""
    cells = cut_lineage(cells)  # means and quantiles read them, the members only this once
    w = zonal.latitude_weight(F.col("lat"))
    mean = lambda c: zonal.weighted_mean(F.col(c), w)
    share = lambda c: zonal.threshold_share(F.col(c), w, 0.5)
    own = F.when(~F.col("fallback"), F.col("spread"))
    means = cells.groupBy("zone_id").agg(
        mean("p_deficit").alias("forecast_deficit_prob"), mean("p_lead1").alias("deficit_prob_lead1"),
        share("p_deficit").alias("spatial_cov_mean_p"), share("cross").alias("hotspot_fraction"),
        zonal.weighted_mean(own, w).alias("forecast_spread"), mean("ens_min").alias("ens_min_spi_mean"),
        F.min("ens_min").alias("ens_min_spi_peak"), mean("mean_l1").alias("ens_mean_lead1_spi"),
        mean("min_l1").alias("ens_min_lead1_spi"), mean("max_l1").alias("ens_max_lead1_spi"),
    )
    tail = exact_quantiles(cells, ["zone_id"], "ens_min", [0.05], "ens_min_spi").drop("q")
    return means.join(tail, "zone_id", "left").withColumns(
        {
            "spatial_coverage": F.greatest("spatial_cov_mean_p", "hotspot_fraction"),
            "forecast_agreement": ensemble.agreement_label(F.col("forecast_spread")),
        }
    )


ROUNDED = [
    "current_spi3", "trend_slope_spi_per_month", "forecast_deficit_prob", "deficit_prob_lead1", "spatial_coverage", "spatial_cov_mean_p",
    "hotspot_fraction", "forecast_spread", "ens_min_spi", "ens_min_spi_mean", "ens_min_spi_peak", "ens_mean_lead1_spi", "ens_min_lead1_spi",
    "ens_max_lead1_spi",
]


def district_evidence(
    zones: DataFrame, obs: DataFrame, fcst_cells: DataFrame, last: Column, target_date: Column, months: int = 6,
    band: float = C.TREND_BAND, soft: bool = False,
) -> DataFrame:
    """One evidence row per district from its months up to ``last`` and all leads of the forecast."""
    rows = zones.join(observed(obs, last, months), "zone_id", "left").join(forecast(fcst_cells), "zone_id", "left")
    return _told(rows, target_date, band, soft)


def season_requests(requests: DataFrame) -> DataFrame:
    """``requests(zone_id, init_date, season)`` with ``lead``, ``target`` and the month numbers ``init_m`` and ``target_m``.

    The lead is the one whose three-month window ends with the season; it is
    NULL for an unknown season or one that no lead from 1 to 6 reaches.
    """
    number = lambda c: F.year(c) * 12 + F.month(c) - 1
    return requests.withColumns(
        {"lead": dates.season_lead(F.month("init_date"), F.col("season")), "target": dates.season_month(F.col("init_date"), F.col("season"))}
    ).withColumns({"init_m": number("init_date"), "target_m": number("target")})


def _latest(asked: DataFrame, held: DataFrame, wish: str, have: str, name: str) -> DataFrame:
    """``(wish, name)``: the largest held value up to each one asked for, from the union of both in order of their months."""
    both = asked.select(F.col(wish).alias("v"), F.lit(None).cast("int").alias("h")).where("v is not null").unionByName(
        held.select(F.col(have).alias("v"), F.col(have).cast("int").alias("h"))
    )
    span = both.groupBy("v").agg(F.max("h").alias("h"))  # at most one row a month
    filled = span.withColumn(name, F.max("h").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    return filled.select(F.col("v").alias(wish), name)


def seasonal_evidence(
    requests: DataFrame, obs: DataFrame, fcst: DataFrame, thresholds: DataFrame, months: int = 6, band: float = C.TREND_BAND,
    members: int = 25, soft: bool = False,
) -> DataFrame:
    """One evidence row per district for the season that it asks for, all districts in one plan.

    ``requests`` has zone_id, init_date and season. The forecast (``fcst``:
    zone_id, cell, lat, init_m, lead, member, spi, fallback) is read at the
    latest start up to the district's and at the one lead that reaches its
    season; ``thresholds(cell, lead, limit)`` gives the deficit limit and the
    return-period limit of a cell at that lead. The observed window ends with
    the latest month up to the season's. Districts whose season is out of reach
    have observed values up to their target and no forecast; cells without a
    limit have no deficit.
    """
    asked = season_requests(requests)
    asked = asked.join(_latest(asked, obs.select("m").distinct(), "target_m", "m", "last_m"), "target_m", "left")
    asked = asked.join(_latest(asked, fcst.select("init_m").distinct(), "init_m", "init_m", "start_m"), "init_m", "left")
    seen = observed(obs.join(asked.select("zone_id", "last_m"), "zone_id"), F.col("last_m"), months)
    wanted = asked.where("lead is not null").select("zone_id", F.col("start_m").alias("init_m"), "lead")
    rows = fcst.join(wanted, ["zone_id", "init_m", "lead"]).join(thresholds.select("cell", "lead", "limit"), ["cell", "lead"], "left")
    cells = forecast_cells(rows, "limit", "limit", members)
    joined = asked.select("zone_id", "season", "lead", "target").join(seen, "zone_id", "left").join(forecast(cells), "zone_id", "left")
    return _told(joined, F.col("target"), band, soft)


def _told(rows: DataFrame, target_date: Column, band: float, soft: bool) -> DataFrame:
    """Categories, labels, the date and the optional soft columns, values rounded."""
    rows = rows.withColumnRenamed("slope", "trend_slope_spi_per_month").withColumns(
        {
            "current_spi3_category": C.spi_label(F.col("current_spi3")),
            "spi3_trend": C.state_label(C.trend_index(F.col("trend_slope_spi_per_month"), band), C.TREND_STATES),
            "forecast_agreement": F.coalesce("forecast_agreement", F.lit("Medium")),
            "target_date": F.date_format(target_date, "yyyy-MM-dd"),
        }
    )
    if soft:
        rows = add_soft_columns(
            rows,
            {
                "cur": F.col("current_spi3"), "def": F.col("forecast_deficit_prob"), "spa": F.col("spatial_coverage"),
                "trn": F.col("trend_slope_spi_per_month"), "tail": F.col("ens_min_spi"),
            },
        )
    return rows.withColumns({c: F.bround(c, 4) for c in ROUNDED})
