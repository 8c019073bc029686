"""Rainfall to runoff to stage: profiles, unit hydrographs, convolution, ratings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvion.functions.decision import bound

# Burst weights of the storm profile and the shares of its four parts.
BURST = (0.04, 0.08, 0.14, 0.20, 0.20, 0.16, 0.11, 0.07)
STORM_SHARES = (0.05, 0.65, 0.15, 0.15)
STORM_STEPS = 48
DECLINE = (0.05, 0.04, 0.03, 0.02, 0.01)
# Channel of the event runs, culvert and open channel of the stage runs.
EVENT_CHANNEL = {"n": 0.035, "width": 15.0, "slope": 0.005}
RIVER_CHANNEL = {"n": 0.040, "width": 20.0, "slope": 0.003, "cap": 15.0}
CULVERT = {"n": 0.014, "width": 3.0, "height": 2.0, "slope": 0.002}
STAGE_CAP = 1.5
RUNOFF_SHARE = 0.85


def storm_profile() -> list[float]:
    """Shares of the daily total in 48 half hours, summing to 1."""
    before, burst, decline, night = STORM_SHARES
    parts = [before / 3] * 3 + [w * burst for w in BURST]
    parts += [w / sum(DECLINE) * decline for w in DECLINE]
    parts += [night / 32] * 32
    whole = sum(parts)
    return [p / whole for p in parts]


def rainfall_steps(df: DataFrame, keys: Sequence[str], total_mm: str, step_s: float = 1800.0) -> DataFrame:
    """``(keys, step, intensity)`` in m/s from a daily total; a fixed profile per row."""
    shares = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(p).alias("share")) for i, p in enumerate(storm_profile())])
    return df.select(*keys, total_mm, F.inline(shares)).select(
        *keys, "step", (F.col(total_mm) * F.col("share") / 1000.0 / step_s).alias("intensity")
    )


def concentration_hours(area_km2: Column) -> Column:
    return 0.3 * F.pow(area_km2, F.lit(0.4))


def base_flow(area_km2: Column, yield_per_km2: float) -> Column:
    return area_km2 * yield_per_km2


def runoff(intensity_mm_h: Column, area_m2: Column, share: float) -> Column:
    """Runoff in m3/s of a rain rate over an area."""
    return intensity_mm_h / (1000.0 * 3600.0) * area_m2 * share


def triangle(kind: str, tc_h: Column, dt_h: float, steps: int = STORM_STEPS) -> Column:
    """Ordinates of a triangular unit hydrograph as an array.

    ``fixed`` has ``steps`` ordinates, ``covering`` as many as the base needs,
    ``indexed`` counts steps instead of hours and ``long`` has a base of 2.67
    times the peak time and unit area in hours.
    """
    def shape(n, base_factor):
        t = lambda i: i * dt_h

        def ordinates(e):
            tc, base = e["tc"], e["tc"] * base_factor
            return F.transform(
                F.sequence(F.lit(0), e["n"] - 1),
                lambda i: F.when(t(i) <= tc, t(i) / tc).when(t(i) <= base, (base - t(i)) / (base - tc)).otherwise(0.0),
            )

        return bound(F.struct(tc_h.alias("tc"), n.alias("n")), ordinates)

    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    if kind == "fixed":
        raw, scale = shape(F.lit(steps), 2.0), 1.0
    elif kind == "covering":
        raw, scale = shape(F.ceil(tc_h * 2.0 / dt_h).cast("int") + 1, 2.0), 1.0
    elif kind == "long":
        raw, scale = shape(F.ceil(tc_h * 2.67 / dt_h).cast("int") + 1, 2.67), dt_h
    elif kind == "indexed":
        n = F.greatest(F.lit(3), F.ceil(tc_h * 2.0 / dt_h).cast("int"))
        peak = F.floor(n / 2).cast("int")
        raw = F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.when(i <= peak, i / peak).otherwise((n - 1 - i) / F.when(n - 1 - peak > 0, n - 1 - peak)),
        )
        scale = 1.0
    else:
        raise ValueError(kind)
    return bound(raw, lambda r: bound(total(r) * scale, lambda w: F.transform(r, lambda x: x / F.when(w > 0, w).otherwise(1.0))))


def convolve(flow: DataFrame, ordinates: DataFrame, keys: Sequence[str], step: str, value: str, steps: int | None = None) -> DataFrame:
    """Sum over k of flow[step - k] * ordinate[k], cut to the steps of the flow.

    Each step is sent ahead to the steps it feeds; a unit hydrograph has few
    ordinates, and the sums combine before the shuffle. ``ordinates`` has the
    keys, ``k`` and ``u``.
    """
    last = flow.groupBy(*keys).agg(F.max(step).alias("_last"))
    fed = (
        flow.join(ordinates.where(F.col("u") != 0), list(keys))
        .select(*keys, (F.col(step) + F.col("k")).alias(step), (F.col(value) * F.col("u")).alias("_v"))
        .groupBy(*keys, step)
        .agg(F.sum("_v").alias("_v"))
    )
    inside = fed.join(last, list(keys)).where(F.col(step) <= F.col("_last"))
    return flow.select(*keys, step).join(inside.select(*keys, step, "_v"), [*keys, step], "left").select(
        *keys, step, F.coalesce("_v", F.lit(0.0)).alias(value)
    )


def convolve_arrays(flow: Column, ordinates: Column) -> Column:
    """Convolution of two short arrays inside a row, as long as the flow.

    For event series that fit a row; ``convolve`` takes series of any length.
    Zeros at the end of the ordinates are left out of the sums.
    """
    def routed(e):
        q, u, n = e["q"], e["u"], e["n"]
        step = lambda i: F.aggregate(
            F.sequence(F.least(i, n - 1), F.lit(0)), F.lit(0.0), lambda a, k: a + F.get(q, i - k) * F.get(u, k)
        )
        return F.transform(F.sequence(F.lit(0), F.size(q) - 1), step)

    def held(e):
        last = F.array_max(F.transform(e["u"], lambda x, i: F.when(x == 0, 1).otherwise(i + 1)))
        return F.struct(e["q"].alias("q"), e["u"].alias("u"), last.alias("n"))

    return bound(bound(F.struct(flow.alias("q"), ordinates.alias("u")), held), routed)


def ordinate_rows(df: DataFrame, keys: Sequence[str], array: Column) -> DataFrame:
    """``(keys, k, u)`` of an ordinate array."""
    return df.select(*keys, F.posexplode(array).alias("k", "u"))


def wide_channel_stage(q: Column, bed: Column, n: float, width: float, slope: float, cap: float | None = None) -> Column:
    """Bed plus normal depth of a wide channel; the depth may be capped."""
    depth = F.pow(not_negative(q) * n / (width * math.sqrt(slope)), F.lit(0.6))
    return bed + (F.when(depth > cap, F.lit(cap)).otherwise(depth) if cap is not None else depth)


def section_flow(depth: Column | float, width: float, n: float, slope: float):
    """Flow of a rectangular section at a depth."""
    area, wet = depth * width, depth * 2.0 + width
    ratio = area / wet
    power = F.pow(ratio, F.lit(2.0 / 3.0)) if isinstance(depth, Column) else ratio ** (2.0 / 3.0)
    return area * power * (math.sqrt(slope) / n)


def culvert_capacity() -> float:
    """Flow of the full culvert."""
    c = CULVERT
    return section_flow(c["height"], c["width"], c["n"], c["slope"])


def rating_stage(
    df: DataFrame, q: str, bed: str, width: float, n: float, slope: float, top: float, cap: float | None = None, step: float = 0.001
) -> DataFrame:
    """Bed plus normal depth by a rating table: depth grid to flow, then the interval that holds q.

    The table has ``top / step`` rows, a fixed number. Its intervals and the
    flows are keyed by whole flow units, so each flow meets a few intervals only;
    inside an interval the depth is linear. Flows over the table take its top; a
    missing flow has no stage.
    """
    spark = df.sparkSession
    count = int(round(top / step))
    low = (F.col("id") * step).alias("d0")
    table = spark.range(count).select(low, ((F.col("id") + 1) * step).alias("d1"))
    table = table.withColumns(
        {"q0": section_flow(F.col("d0"), width, n, slope), "q1": section_flow(F.col("d1"), width, n, slope)}
    ).withColumn("_b", F.explode(F.sequence(F.floor("q0").cast("bigint"), F.floor("q1").cast("bigint"))))
    peak = section_flow(top, width, n, slope)
    held = df.withColumn("_q", F.when(F.col(q) < 0, 0.0).when(F.col(q).isNotNull(), F.least(F.col(q), F.lit(peak * (1 - 1e-12))))).withColumn(
        "_b", F.floor("_q").cast("bigint")
    )
    hit = (F.col("_q") >= F.col("q0")) & (F.col("_q") < F.col("q1")) & (held["_b"] == table["_b"])
    depth = F.col("d0") + (F.col("d1") - F.col("d0")) * (F.col("_q") - F.col("q0")) / (F.col("q1") - F.col("q0"))
    wet = F.when(F.col(q).isNotNull(), F.least(depth, F.lit(cap))) if cap is not None else depth
    joined = held.join(F.broadcast(table), hit, "left")
    return joined.select(*df.columns, (F.col(bed) + F.when(F.col(q) <= 0, 0.0).otherwise(wet)).alias("stage"))


def culvert_stage(df: DataFrame, q: str, bed: str, capped: bool = False) -> DataFrame:
    """Stage at the culvert: normal depth up to its capacity, then a weir over the top.

    The capped form holds the depth at a fixed head once the culvert is full.
    """
    c = CULVERT
    full = culvert_capacity()
    free = rating_stage(df, q, bed, c["width"], c["n"], c["slope"], c["height"])
    over = F.pow((F.col(q) - full) / (0.6 * c["width"] * math.sqrt(2 * 9.81)), F.lit(2.0 / 3.0))
    high = F.lit(STAGE_CAP) if capped else F.least(c["height"] + over, F.lit(10.0))
    return free.withColumn("stage", F.when(F.col(q) > full, F.col(bed) + high).otherwise(F.col("stage")))


def scale_flow(value: Column, new_factor: Column | float, base_factor: Column | float) -> Column:
    """Flow rescaled from one rain factor to another."""
    return value * (F.lit(new_factor) if not isinstance(new_factor, Column) else new_factor) / (
        F.lit(base_factor) if not isinstance(base_factor, Column) else base_factor
    )


def pad_first(df: DataFrame, keys: Sequence[str], step: str, value: str, steps: int) -> DataFrame:
    """Series moved one step later with a zero in front, exactly ``steps`` long."""
    axis = df.select(*keys).distinct().withColumn(step, F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    moved = df.select(*keys, (F.col(step) + 1).alias(step), F.col(value))
    return axis.join(moved, [*keys, step], "left").select(*keys, step, F.coalesce(value, F.lit(0.0)).alias(value))


def not_negative(value: Column) -> Column:
    """At least 0; NULL stays NULL (``greatest`` alone would turn it into 0)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def to_units(kind: str, value: Column) -> Column:
    """Kelvin to Celsius, J/m2 per day to W/m2, metres per day to mm per day; others unchanged."""
    if kind in ("2t", "mx2t", "mn2t", "2d"):
        return value - 273.15
    if kind == "ssrd":
        return not_negative(value / 86400.0)
    if kind == "tp":
        return not_negative(value * 1000.0)
    return value


def deaccumulate(df: DataFrame, keys: Sequence[str], step: str, value: str) -> DataFrame:
    """Differences between consecutive steps; the first step goes."""
    from pyspark.sql import Window as W

    before = F.lag(value).over(W.partitionBy(*keys).orderBy(step))
    return df.withColumn("_p", before).where(F.col("_p").isNotNull()).withColumn(value, F.col(value) - F.col("_p")).drop("_p")


def event_totals(df: DataFrame, keys: Sequence[str], step: str, rate: str, hours: float = 0.5, wet: float = 0.1) -> DataFrame:
    """Basin-mean rate per step, then total, peak and wet steps of the event."""
    per_step = df.groupBy(*keys, step).agg(F.avg(rate).alias("_r"))
    return per_step.groupBy(*keys).agg(
        (F.sum("_r") * hours).alias("total_mm"), F.max("_r").alias("peak_rate"), F.count_if(F.col("_r") > wet).alias("wet_steps")
    )
