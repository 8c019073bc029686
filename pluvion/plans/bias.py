"""Empirical quantile mapping of forecasts onto observed rainfall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.operators.quantiles import exact_quantiles

NODES = 50


def train(reference: DataFrame, history: DataFrame, keys: Sequence[str], value: str, nodes: int = NODES) -> DataFrame:
    """Factor per key at the middle of each of the equal probability steps.

    One row per key with ``nodes`` points; nodes where the history is 0 are
    left out, as no factor exists there.
    """
    probs = [(i + 0.5) / nodes for i in range(nodes)]
    ref = exact_quantiles(reference, keys, value, probs, "_r")
    hist = exact_quantiles(history, keys, value, probs, "_h")
    pairs = ref.join(hist, [*keys, "q"]).where(F.col("_h") != 0)
    point = F.struct(F.col("_h").alias("h"), (F.col("_r") / F.col("_h")).alias("f"), F.col("q").alias("q"))
    return pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("nodes"))


def adjust(forecast: DataFrame, mapping: DataFrame | None, keys: Sequence[str], value: str, name: str = "corrected") -> DataFrame:
    """Forecast times the factor at its value, linear between nodes and constant outside.

    Without a mapping, and for keys without history, the forecast passes through.
    """
    if mapping is None:
        return forecast.withColumn(name, F.col(value))
    joined = forecast.join(mapping, list(keys), "left")
    below = F.size(F.filter("nodes", lambda n: n["h"] <= F.col(value)))
    n = F.size("nodes")
    at = lambda i: F.element_at("nodes", i)
    low, high = at(F.greatest(F.col("_i"), F.lit(1))), at(F.least(F.col("_i") + 1, n))
    gap = high["h"] - low["h"]
    part = F.when((F.col("_i") >= 1) & (F.col("_i") < n) & (gap > 0), (F.col(value) - low["h"]) / gap).otherwise(0.0)
    factor = low["f"] + (high["f"] - low["f"]) * part
    return joined.withColumn("_i", below).withColumn(
        name, F.when(F.col("nodes").isNull(), F.col(value)).otherwise(F.col(value) * factor)
    ).drop("nodes", "_i")
