"""Exact quantiles and weighted medians that never sort a whole group in one task.

A group (zone, boundary, basin) may hold a large part of all rows, so neither
``percentile`` (one hash map per group) nor a plain running sum over the group
is safe. The steps here are: collapse equal values, cut each group at sketch
percentiles into buckets of about equal size, add up the buckets, and sort only
the bucket that holds the wanted rank. The sketch only places the cuts; the
ranks are counted exactly, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Distinct values of a bucket; the number of buckets follows from the size of the group.
BUCKET_ROWS = 20_000
#: Buckets at most; the sketch places the cuts between them.
FINEST = 1024


def with_value_buckets(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add ``_bucket``, a number that grows with ``value`` inside each group.

    ``df`` has one row per distinct value. A group is cut into buckets of about
    ``BUCKET_ROWS`` values; beyond ``FINEST`` buckets they grow with the group,
    each still a thousandth of it. The bucket is found by halving the cuts.
    """
    sketch = F.percentile_approx(value, [i / FINEST for i in range(1, FINEST)], 10000)
    kind = df.schema[value].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    wanted = F.least(F.ceil(F.count("*") / BUCKET_ROWS), F.lit(FINEST))
    sized = df.groupBy(*keys).agg(sketch.alias("_all"), wanted.alias("_wanted"))
    place = lambda i: F.element_at("_all", F.ceil(i * FINEST / F.col("_wanted")).cast("int"))
    picked = F.when(F.col("_wanted") > 1, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("_wanted") - 1, F.lit(1).cast("long"))), place)).otherwise(none)
    cuts = sized.select(*keys, picked.alias("_cuts"))
    if keys:
        joined = df.join(cuts, list(keys))
    else:
        joined = df.withColumn("_cuts", cuts.select("_cuts").scalar())
    # Cuts at or under the value, by halving: a row looks at one cut per power of two, however many there are.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((FINEST - 1).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda n, s: n + F.when(F.get("_cuts", n + s - 1) <= F.col(value), s).otherwise(0))
    return joined.withColumn("_bucket", found).drop("_cuts")


def _running_buckets(bucketed: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Per group and bucket: weight before it, weight through it, group total."""
    sums = bucketed.groupBy(*keys, "_bucket").agg(F.sum(weight).alias("_in"))
    order = W.partitionBy(*keys).orderBy("_bucket")
    return sums.withColumns(
        {
            "_through": F.sum("_in").over(order.rowsBetween(W.unboundedPreceding, 0)),
            "_total": F.sum("_in").over(W.partitionBy(*keys)),
        }
    ).withColumn("_before", F.col("_through") - F.col("_in"))


def weighted_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str | Column,
    name: str = "median",
) -> DataFrame:
    """First value whose running weight reaches half of the group's weight.

    Missing values are skipped; a group without positive weight gives NULL.
    Running weights are compared at nine decimals so that the order of adding
    cannot decide a tie.
    """
    weight = F.col(weight) if isinstance(weight, str) else weight
    collapsed = (
        df.withColumn("_w", weight)
        .where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.sum("_w").alias("_w"))
    )
    bucketed = with_value_buckets(collapsed, keys, value)
    sums = _running_buckets(bucketed, keys, "_w")
    half = F.round(F.col("_total") * 0.5, 9)
    reached = F.round("_through", 9) >= half
    first = sums.groupBy(*keys).agg(
        F.min(F.when(reached, F.col("_bucket"))).alias("_bucket"),
        F.first("_total").alias("_total"),
        F.min_by("_before", F.when(reached, F.col("_bucket"))).alias("_before"),
    )
    order = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    inside = bucketed.join(first, [*keys, "_bucket"]).withColumn(
        "_cw", F.col("_before") + F.sum("_w").over(order)
    )
    return inside.groupBy(*keys).agg(
        F.min(
            F.when(
                (F.col("_total") > 0) & (F.round("_cw", 9) >= half),
                F.col(value),
            )
        ).alias(name)
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    name: str = "quantile",
) -> DataFrame:
    """Long result ``(keys, q, name)`` with linear interpolation between ranks."""
    collapsed = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_w"))
    )
    bucketed = with_value_buckets(collapsed, keys, value)
    sums = _running_buckets(bucketed, keys, "_w")
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in probs]))
    pos = F.col("q") * (F.col("_total") - 1)
    ranks = F.array(F.floor(pos), F.ceil(pos))
    targets = (
        sums.withColumn("q", wanted)
        .withColumn("_rank", F.explode(F.array_distinct(ranks)))
        .where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_through")))
        .select(*keys, "_bucket", "_before", "_total", "q", "_rank")
    )
    order = W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    needed = targets.select(*keys, "_bucket").distinct()
    inside = (
        bucketed.join(needed, [*keys, "_bucket"], "left_semi")
        .withColumn("_cum", F.sum("_w").over(order))
        .withColumn("_start", F.col("_cum") - F.col("_w"))
    )
    hit = targets.join(inside, [*keys, "_bucket"]).where(
        (F.col("_rank") - F.col("_before") >= F.col("_start"))
        & (F.col("_rank") - F.col("_before") < F.col("_cum"))
    )
    frac = pos - F.floor(pos)
    return (
        hit.groupBy(*keys, "q", "_total")
        .agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        .select(
            *keys,
            "q",
            (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).alias(name),
        )
    )
