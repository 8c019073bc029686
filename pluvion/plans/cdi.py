"""Combined drought indicator: classes per cell, levels per district, posterior update."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvion.functions.categories import CDI_STATES, cdi_level, published_class, state_label
from pluvion.functions.decision import array_sum, attention, normalise, top_state
from pluvion.operators.zonal import class_summary

# Likelihood of each level (rows, least stressed first) given the risk state.
CDI_LIKELIHOOD = [
    (0.50, 0.30, 0.10, 0.05, 0.02),
    (0.25, 0.25, 0.15, 0.05, 0.03),
    (0.10, 0.20, 0.20, 0.10, 0.05),
    (0.10, 0.15, 0.25, 0.20, 0.15),
    (0.04, 0.08, 0.20, 0.30, 0.25),
    (0.01, 0.02, 0.10, 0.30, 0.50),
]
# First days of the two vegetation records and last day of the older one.
VEGETATION_START, OLD_VEGETATION_START, OLD_VEGETATION_END = "2012-02-01", "2001-01-01", "2015-12-31"


def vegetation_source(target: str, mode: str = "auto") -> str:
    """Vegetation record for a target day: ``gdo``, ``modis`` or ``none``."""
    if mode == "auto":
        return "gdo" if target >= VEGETATION_START else "modis" if target >= OLD_VEGETATION_START else "none"
    if mode == "gdo" and target < VEGETATION_START:
        raise ValueError(f"the gdo record starts {VEGETATION_START}")
    if mode == "modis" and not OLD_VEGETATION_START <= target <= OLD_VEGETATION_END:
        raise ValueError(f"the modis record covers {OLD_VEGETATION_START} to {OLD_VEGETATION_END}")
    return mode


def classify_cells(df: DataFrame) -> DataFrame:
    """Adds ``cdi_class`` and ``cdi_level_idx``; a missing input leaves its condition unmet.

    Limits, class numbers and their order are fixed values; the first class whose conditions are met counts.
    """

    def below(column: str, limit: float) -> Column:
        if column not in df.columns:
            return F.lit(False)
        return F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(None)) < limit, F.lit(False))

    dry_year, dry_quarter, dry_month = below("spi9_12", -1.0), below("spi3", -1.0), below("spi1", -2.0)
    was_dry_quarter, was_dry_month = below("spi3_prev", -1.0), below("spi1_prev", -2.0)
    dry_soil, poor_leaf = below("sma", -1.0), below("fapar", -1.0)
    klass = (
        F.when(poor_leaf & dry_soil & dry_year & dry_quarter, 10)
        .when(poor_leaf & dry_soil & dry_quarter, 9)
        .when(poor_leaf & dry_quarter, 8)
        .when(poor_leaf & dry_month, 7)
        .when(dry_soil & dry_year & dry_quarter, 6)
        .when(dry_soil & dry_quarter, 5)
        .when(dry_soil & dry_month, 4)
        .when(dry_year & dry_quarter, 3)
        .when(dry_quarter, 2)
        .when(dry_month, 1)
        .when(poor_leaf & was_dry_quarter, 12)
        .when(poor_leaf & was_dry_month, 11)
        .when(was_dry_quarter, 14)
        .when(was_dry_month, 13)
        .otherwise(0)
    )
    return df.withColumn("cdi_class", klass).withColumn("cdi_level_idx", cdi_level(F.col("cdi_class")))


def published_cells(df: DataFrame, value: str) -> DataFrame:
    out = df.withColumn("cdi_class", published_class(F.col(value)))
    return out.withColumn("cdi_level_idx", cdi_level(F.col("cdi_class")))


def district_levels(cells: DataFrame, keys: Sequence[str], suffix: str = "") -> DataFrame:
    """Worst level, worst class inside it, modal class and share per district."""
    out = class_summary(cells, keys, "cdi_class", "cdi_level_idx")
    return out.select(
        *keys,
        F.col("max_class").alias(f"cdi_class{suffix}"),
        F.col("max_level").alias(f"cdi_level_idx{suffix}"),
        state_label(F.col("max_level"), CDI_STATES).alias(f"cdi_level{suffix}"),
        F.bround("level_fraction", 4).alias(f"cdi_level_fraction{suffix}"),
        F.col("modal_class").alias(f"cdi_modal_class{suffix}"),
    )


def compare_sources(recomputed: DataFrame, published: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both sources side by side with the agreement flag."""
    return (
        district_levels(recomputed, keys, "_recomp")
        .join(district_levels(published, keys, "_published"), list(keys))
        .withColumn("cdi_agreement", F.col("cdi_level_idx_recomp") == F.col("cdi_level_idx_published"))
    )


def _likelihood(level: Column) -> Column:
    """Column-normalised likelihood row of a level; ones for a level outside 1..6."""
    sums = [sum(row[r] for row in CDI_LIKELIHOOD) for r in range(5)]
    rows = [F.array(*[F.lit(v / s) for v, s in zip(row, sums)]) for row in CDI_LIKELIHOOD]
    ones = F.array(*[F.lit(1.0)] * 5)
    return F.when(level.between(1, 6), F.element_at(F.array(*rows), level.cast("int"))).otherwise(ones)


def update_posterior(
    results: DataFrame, evidence: DataFrame, key: str, levels: Sequence[str], ratio: float = 0.2
) -> DataFrame:
    """Prior times the likelihood of each source, renormalised and decided again.

    Rows without evidence, with no usable level or with a vanishing product
    keep their old values. ``posterior`` and ``attention_state`` come in with
    the results; the old ones stay as ``*_pre``.
    """
    joined = results.join(evidence.select(key, *levels), key, "left")
    usable = F.lit(False)
    product = F.col("posterior")
    for level in levels:
        usable = usable | F.coalesce(F.col(level).between(1, 6), F.lit(False))
        product = F.zip_with(product, _likelihood(F.col(level)), lambda a, b: a * b)
    changed = usable & (array_sum(F.col("_product")) > 0)
    fresh = normalise(F.col("_product"))
    work = joined.withColumn("_product", product).withColumn("updated", changed)
    work = work.withColumn("posterior_pre", F.col("posterior")).withColumn(
        "posterior", F.when(F.col("updated"), fresh).otherwise(F.col("posterior"))
    )
    decided = attention(F.col("posterior"), ratio)
    return work.withColumn("_a", decided).select(
        *[c for c in results.columns if c not in ("posterior", "attention_state")],
        F.when(
            F.col("updated"), F.transform("posterior", lambda x: F.bround(x, 6))
        ).otherwise(F.col("posterior")).alias("posterior"),
        "posterior_pre",
        F.when(F.col("updated"), F.col("_a.state")).otherwise(F.col("attention_state")).alias("attention_state"),
        F.col("attention_state").alias("attention_state_pre"),
        F.when(F.col("updated"), top_state(F.col("posterior"))).alias("risk_level"),
        "updated",
    )


def change_counts(updated: DataFrame) -> DataFrame:
    """Rows, updated rows and rows whose attention state moved."""
    return updated.agg(
        F.count("*").alias("n_rows"),
        F.count_if("updated").alias("n_updated"),
        F.count_if(F.col("updated") & (F.col("attention_state") != F.col("attention_state_pre"))).alias("n_changed"),
    )
