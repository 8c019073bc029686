"""Statistics over ensemble members and leads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvion.operators.quantiles import exact_quantiles


def clip(value: Column, bound: float = 4.0) -> Column:
    """Limit to +-bound and keep NULL."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(-bound)), F.lit(bound)))


def first_members(df: DataFrame, count: int, member: str = "member") -> DataFrame:
    """Keep the first ``count`` members of a zero-based member position."""
    return df.where(F.col(member) < count)


def member_statistics(
    df: DataFrame, keys: Sequence[str], value: str, threshold: float | Column
) -> DataFrame:
    """Mean, minimum, maximum, population spread and share at or under the threshold."""
    threshold = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    below = F.coalesce(F.col(value) <= threshold, F.lit(False))
    return df.groupBy(*keys).agg(
        F.avg(value).alias("ens_mean"),
        F.min(value).alias("ens_min"),
        F.max(value).alias("ens_max"),
        F.stddev_pop(value).alias("ens_spread"),
        F.avg(below.cast("double")).alias("deficit_prob"),
        F.bool_or(below).alias("any_member"),
    )


def over_leads(stats: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Largest probability and smallest member value over the leads."""
    return stats.groupBy(*cell).agg(
        F.max("deficit_prob").alias("deficit_prob"),
        F.min("ens_min").alias("ens_min"),
        F.bool_or("any_member").alias("any_member"),
    )


def member_evidence(
    df: DataFrame, boundary: str, member: str, cell: Sequence[str], value: str, threshold: str
) -> DataFrame:
    """Per boundary and member: deficit share, coverage and p05 of the cell minimum."""
    cells = df.groupBy(boundary, member, *cell).agg(
        F.min(value).alias("_min"),
        F.max(F.coalesce(F.col(value) <= F.col(threshold), F.lit(False)).cast("double")).alias("_def"),
    )
    means = cells.groupBy(boundary, member).agg(
        F.avg("_def").alias("member_def_frac"),
        F.avg((F.col("_def") >= 0.5).cast("double")).alias("member_spa_cov"),
    )
    tail = exact_quantiles(cells, [boundary, member], "_min", [0.05], "member_min_spi").drop("q")
    return means.join(tail, [boundary, member], "left")


def agreement_label(spread: Column, high: float = 0.5, low: float = 0.9) -> Column:
    """Agreement from the member spread; unknown spread counts as Medium."""
    return (
        F.when(spread.isNull() | F.isnan(spread), "Medium")
        .when(spread < high, "High")
        .when(spread < low, "Medium")
        .otherwise("Low")
    )
