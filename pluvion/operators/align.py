"""Alignment in time and space: as-of, nearest, bilinear, unified axes, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvion.session import cut_lineage, spread


# ---------------------------------------------------------------- time

def latest_on_or_before(df: DataFrame, time: str, target: Column) -> DataFrame:
    """Rows of the latest step at or before the target; fails when there is none."""
    upper = df.where(F.col(time) <= target)
    last = upper.agg(
        F.coalesce(F.max(time), F.raise_error(F.lit("no step at or before the target"))).alias("last")
    )
    return upper.where(F.col(time) == last.scalar())


def latest_value(
    df: DataFrame, keys: Sequence[str], time: str, value: str, target: Column, name: str = "value"
) -> DataFrame:
    """Per group the value of the latest step at or before the target."""
    return df.where(F.col(time) <= target).groupBy(*keys).agg(
        F.max(time).alias(time), F.max_by(value, time).alias(name)
    )


def with_previous_month(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Latest step per group beside the latest step a month or more before it.

    Falls back to the latest step itself when the series is too short. Steps
    are unique per group, so one aggregate over (group, step) pairs does it.
    """
    last = df.groupBy(*keys).agg(F.max(time).alias("_t"), F.max_by(value, time).alias("latest"))
    earlier = (
        df.join(last, list(keys))
        .where(F.col(time) <= F.add_months(F.col("_t"), -1))
        .groupBy(*keys)
        .agg(F.max(time).alias("_pt"), F.max_by(value, time).alias("_pv"))
    )
    return last.join(earlier, list(keys), "left").select(
        *keys,
        F.col("_t").alias("latest_time"),
        "latest",
        F.coalesce("_pt", "_t").alias("previous_time"),
        F.when(F.col("_pt").isNotNull(), F.col("_pv")).otherwise(F.col("latest")).alias("previous"),
    )


def bounded_asof(
    wanted: DataFrame,
    available: DataFrame,
    keys: Sequence[str],
    day: str,
    value: str,
    max_back: int,
    name: str = "value",
) -> DataFrame:
    """For each wanted day the last available day within ``max_back`` days.

    The look-back is bounded, so each wanted row asks for ``max_back + 1`` days
    by equality; no sort of a whole series is needed and a busy key spreads
    over its days.
    """
    asked = wanted.withColumn("_back", F.explode(F.sequence(F.lit(0), F.lit(max_back)))).withColumn(
        "_day", F.date_sub(F.col(day), F.col("_back"))
    )
    found = available.select(*keys, F.col(day).alias("_day"), F.col(value).alias("_value"))
    hit = asked.join(found, [*keys, "_day"]).groupBy(*keys, day).agg(
        F.max("_day").alias("source_day"), F.max_by("_value", "_day").alias(name)
    )
    return wanted.join(hit, [*keys, day], "left")


def unified_axis(*axes: DataFrame) -> DataFrame:
    """Distinct union of the time axes of several sources."""
    out = axes[0]
    for axis in axes[1:]:
        out = out.unionByName(axis)
    return out.distinct()


def onto_axis(axis: DataFrame, source: DataFrame, on: Sequence[str]) -> DataFrame:
    """Sparse source on a dense axis, missing steps NULL."""
    return axis.join(source, list(on), "left")


def overlap_window(df: DataFrame, source: str, time: str) -> DataFrame:
    """Rows inside the common window: latest first step to earliest last step."""
    spans = df.groupBy(source).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    start = spans.agg(F.max("first").alias("v")).scalar()
    end = spans.agg(F.min("last").alias("v")).scalar()
    return df.where((F.col(time) >= start) & (F.col(time) <= end))


def outer_sum(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Full join of two sources with 0 for a missing side, then the sum."""
    a = left.select(*keys, F.col(value).alias("_a"))
    b = right.select(*keys, F.col(value).alias("_b"))
    return a.join(b, list(keys), "full").select(
        *keys, (F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))).alias(name)
    )


# ---------------------------------------------------------------- space

def wrap_longitude(lon: Column) -> Column:
    """0..360 degrees to -180..180."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def nearest_axis(wanted: DataFrame, at: str, axis: DataFrame, coord: str, key: str) -> DataFrame:
    """``(key, coord)``: the axis coordinate nearest to each wanted position.

    The axis of a grid is short (degrees over resolution) and is read once as
    one sorted array; the lower coordinate wins a tie. Regular axes need no
    axis table, see ``nearest_on_regular_axis``; for an axis that grows with
    the data see ``nearest_value``.
    """
    points = axis.agg(F.array_sort(F.collect_set(coord)).alias("points")).scalar()
    best = F.array_min(
        F.transform("_points", lambda c: F.struct(F.abs(c - F.col("_at")).alias("d"), c.alias("c")))
    )
    return (
        wanted.select(key, F.col(at).alias("_at"))
        .withColumn("_points", points)
        .select(key, best["c"].alias(coord))
    )


def nearest_value(wanted: DataFrame, at: str, axis: DataFrame, coord: str, key: str) -> DataFrame:
    """``(key, coord)``: the value nearest to each wanted position, for an axis of any length.

    Distinct positions and values are sorted together by ranges; each position
    looks at the value before and after it, and a range takes over the last
    and first values of its neighbours from a table with one row per range.
    The lower value wins a tie. A missing position has no nearest value.
    """
    places = wanted.select(F.col(at).alias("_at")).where("_at is not null").distinct()
    values = axis.select(F.col(coord).alias("_at")).where("_at is not null").distinct()
    both = places.withColumn("_axis", F.lit(False)).unionByName(values.withColumn("_axis", F.lit(True)))
    ranged = cut_lineage(both.repartitionByRange("_at").withColumn("_part", F.spark_partition_id()))
    known = F.when(F.col("_axis"), F.col("_at"))
    parts = ranged.groupBy("_part").agg(F.min(known).alias("_lo"), F.max(known).alias("_hi"))
    order = W.partitionBy(F.lit(1)).orderBy("_part")
    carried = parts.select(
        "_part",
        F.last("_hi", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_left"),
        F.first("_lo", True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_right"),
    )
    inside = W.partitionBy("_part")
    upto = inside.orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)
    back = inside.orderBy(F.desc("_at")).rangeBetween(W.unboundedPreceding, W.currentRow)
    near = (
        ranged.withColumns({"_below": F.last(known, True).over(upto), "_above": F.last(known, True).over(back)})
        .where(~F.col("_axis"))
        .join(F.broadcast(carried), "_part")
        .withColumns({"_below": F.coalesce("_below", "_left"), "_above": F.coalesce("_above", "_right")})
    )
    lower = F.col("_above").isNull() | (F.col("_at") - F.col("_below") <= F.col("_above") - F.col("_at"))
    found = near.select("_at", F.when(lower, F.col("_below")).otherwise(F.col("_above")).alias(coord))
    return wanted.select(key, F.col(at).alias("_at")).join(found, "_at", "left").select(key, coord)


def nearest_on_regular_axis(pos: Column, start: float, step: float, count: int) -> Column:
    """Index of the nearest point of a regular axis; halves go to the lower index."""
    raw = F.ceil((pos - F.lit(start)) / F.lit(step) - 0.5)
    return F.greatest(F.lit(0), F.least(F.lit(count - 1), raw)).cast("int")


def bilinear_weights(
    targets: DataFrame,
    key: str,
    lat0: float,
    lon0: float,
    step: float,
    rows: int,
    cols: int,
    lat: str = "lat",
    lon: str = "lon",
    extrapolate: bool = False,
) -> DataFrame:
    """Reusable table ``(key, row, col, weight, corners)`` of a regular source grid.

    Targets outside the source get no rows unless ``extrapolate`` is set, which
    continues the edge cell linearly. Weights of zero are kept out, so a target
    on a grid line does not depend on the next line; ``corners`` counts those
    that a target keeps.
    """
    def axis(pos, count):
        cell = F.greatest(F.lit(0), F.least(F.lit(count - 2), F.floor(pos)))
        return cell, pos - cell

    y = (F.col(lat) - F.lit(lat0)) / F.lit(step)
    x = (F.col(lon) - F.lit(lon0)) / F.lit(step)
    inside = (y >= 0) & (y <= rows - 1) & (x >= 0) & (x <= cols - 1)
    source = targets if extrapolate else targets.where(inside)
    (r, fy), (c, fx) = axis(y, rows), axis(x, cols)
    corners = F.array(
        F.struct(r.alias("row"), c.alias("col"), ((1 - fy) * (1 - fx)).alias("weight")),
        F.struct(r.alias("row"), (c + 1).alias("col"), ((1 - fy) * fx).alias("weight")),
        F.struct((r + 1).alias("row"), c.alias("col"), (fy * (1 - fx)).alias("weight")),
        F.struct((r + 1).alias("row"), (c + 1).alias("col"), (fy * fx).alias("weight")),
    )
    return (
        source.select(key, F.filter(corners, lambda w: w["weight"] != 0).alias("_w"))
        .select(key, F.size("_w").alias("corners"), F.inline("_w"))
        .select(key, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "weight", "corners")
    )


def apply_weights(
    grid: DataFrame, weights: DataFrame, key: str, values: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Weighted sum over the corner cells; NULL when any of them is missing.

    All values go through one join and one aggregate; the number of corners
    comes from the weights. Without ``by`` every target appears, also one whose
    corners are all absent; with ``by`` the steps are those of the grid. Targets
    with the same corner cells share what the grid has there: the values of a
    set of corners are put together once a step, and a target meets one row a
    step that holds all it needs, so nothing is summed across a shuffle.
    """
    if by:
        corners = F.array_sort(F.collect_list(F.struct("row", "col", "weight")))
        of = lambda *names: F.transform("_c", lambda c: F.struct(*[c[n].alias(n) for n in names]) if len(names) > 1 else c[names[0]])
        targets = weights.groupBy(key).agg(F.max("corners").alias("_need"), corners.alias("_c")).select(
            key, "_need", of("row", "col").alias("_at"), of("weight").alias("_w")
        )
        places = targets.select("_at").distinct().select("_at", F.posexplode("_at").alias("_i", "_p")).select("_at", "_i", "_p.*")
        held = places.join(grid, ["row", "col"]).groupBy("_at", *by).agg(
            F.collect_list(F.struct("_i", *values)).alias("_f"), *[F.count(v).alias(f"_n_{v}") for v in values]
        )
        dot = lambda v: F.aggregate("_f", F.lit(0.0), lambda a, f: a + F.coalesce(F.get("_w", f["_i"]) * f[v], F.lit(0.0)))
        return spread(targets).join(held, "_at").select(
            key, *by, *[F.when(F.col(f"_n_{v}") == F.col("_need"), dot(v)).alias(v) for v in values]
        )
    summed = weights.join(grid, ["row", "col"], "left").groupBy(key).agg(
        F.max("corners").alias("_need"),
        *[F.sum(F.col("weight") * F.col(v)).alias(f"_s_{v}") for v in values],
        *[F.count(v).alias(f"_n_{v}") for v in values],
    )
    return summed.select(
        key, *[F.when(F.col(f"_n_{v}") == F.col("_need"), F.col(f"_s_{v}")).alias(v) for v in values]
    )


def snap(coord: Column, digits: int = 1) -> Column:
    """Integer key of a coordinate at ``digits`` decimals, safe for equality joins."""
    return F.round(coord * (10**digits)).cast("bigint")


def block_resample(df: DataFrame, row: str, col: str, factor: int, value: str, how: str = "avg") -> DataFrame:
    """Fine cells to coarse cells by average or maximum."""
    agg = F.max if how == "max" else F.avg
    return df.groupBy(
        F.floor(F.col(row) / factor).cast("int").alias("row"),
        F.floor(F.col(col) / factor).cast("int").alias("col"),
    ).agg(agg(value).alias(value))


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str], default: dict[str, object]) -> DataFrame:
    """Left join with a code table; codes it lacks take the defaults."""
    joined = df.join(table, list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in default.items()})
