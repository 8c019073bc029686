"""Soft evidence: probability mass of an uncertain value over the states of a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvion.functions.categories import DEFICIT_EDGES, SPATIAL_EDGES, SPI_EDGES, TAIL_EDGES
from pluvion.functions.statistics import normal_cdf

# Fixed values per node: edges on the physical axis, default sigma, and whether the
# states run against the axis.
SOFT_NODES = {
    "cur": (SPI_EDGES, 0.3, True),
    "def": (DEFICIT_EDGES, 0.05, False),
    "spa": (SPATIAL_EDGES, 0.05, False),
    "trn": ((-0.3, 0.3), 0.1, True),
    "tail": (TAIL_EDGES, 0.2, True),
}

# Crop stage fractions at which flowering starts and ends, and the ramp half-width.
FLOWER_START, FLOWER_END, STAGE_RAMP = 0.55, 0.70, 0.07


def soft_bins(x: Column, node: str, sigma: float | None = None) -> Column:
    """Normal mass in each bin of the node; missing values spread evenly."""
    edges, default, against = SOFT_NODES[node]
    s = default if sigma is None else sigma
    k = len(edges) + 1
    inner = F.transform(F.array(*[F.lit(float(e)) for e in edges]), lambda e: normal_cdf((e - x) / s))
    upper = F.concat(inner, F.array(F.lit(1.0)))
    lower = F.concat(F.array(F.lit(0.0)), inner)
    mass = F.zip_with(upper, lower, lambda hi, lo: hi - lo)
    if against:
        mass = F.reverse(mass)
    known = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    even = F.array(*[F.lit(1.0 / k)] * k)
    return F.when(known, mass).otherwise(even)


def add_soft_columns(df: DataFrame, nodes: dict[str, Column], digits: int = 4) -> DataFrame:
    """Adds ``<node>_p1..`` rounded half to even, as the evidence tables hold them."""
    staged = df.withColumns({f"_{n}": soft_bins(x, n) for n, x in nodes.items()})
    bins = {
        f"{n}_p{i + 1}": F.bround(F.col(f"_{n}")[i], digits)
        for n in nodes
        for i in range(len(SOFT_NODES[n][0]) + 1)
    }
    return staged.withColumns(bins).drop(*[f"_{n}" for n in nodes])


def phase_soft(stage: Column) -> Column:
    """Vegetative, flowering and maturation with linear ramps; missing is vegetative."""
    def ramp(edge: float) -> Column:
        raw = (stage - (edge - STAGE_RAMP)) / (2 * STAGE_RAMP)
        return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))

    started, ended = ramp(FLOWER_START), ramp(FLOWER_END)
    parts = [1.0 - started, F.greatest(started - ended, F.lit(0.0)), ended]
    total = parts[0] + parts[1] + parts[2]
    unknown = stage.isNull() | F.isnan(stage)
    return F.when(unknown, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(*[p / total for p in parts]))
