"""Category indices of the evidence nodes, their labels and label parsers.

Index 1 is always the least stressed state. Every function takes a column and
states what a missing value means for its node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# State labels in increasing-stress order.
SPI_STATES = ["Above_Normal", "Normal", "Mild_Drought", "Moderate_Drought", "Severe_Drought"]
DEFICIT_STATES = ["Very_Low", "Low", "Medium", "High", "Very_High"]
SPATIAL_STATES = ["Localized", "Moderate", "Widespread"]
TREND_STATES = ["Improving", "Stable", "Deteriorating"]
AGREEMENT_STATES = ["Low", "Medium", "High"]
TAIL_STATES = ["Nil", "Low", "Moderate", "High"]
CDI_STATES = ["No_drought", "Full_recovery", "Partial_recovery", "Watch", "Warning", "Alert"]
RISK_STATES = ["Minimal", "Low", "Moderate", "High", "Extreme"]
WRSI_STATES = ["No_Stress", "Mild", "Moderate", "Severe"]
FPAR_STATES = ["Unknown", "Healthy", "Mild", "Moderate", "Severe_Decline"]
PHASE_STATES = ["Vegetative", "Flowering", "Maturation"]
ATTENTION_STATES = ["Monitor", "Evaluate", "Assess", "Review"]
ATTENTION_COLOURS = ["Green", "Yellow", "Orange", "Red"]

# Class boundaries.
SPI_EDGES = (-1.5, -1.0, -0.5, 0.5)
DEFICIT_EDGES = (0.2, 0.4, 0.6, 0.8)
SPATIAL_EDGES = (0.3, 0.6)
TAIL_EDGES = (-1.5, -1.0, -0.5)
WRSI_EDGES = (50.0, 65.0, 80.0)
FPAR_EDGES = (-1.5, -1.0, -0.5)
TREND_BAND = 0.1

# Level of each of the 15 drought indicator classes.
CDI_CLASS_LEVEL = [1, 4, 4, 4, 5, 5, 5, 6, 6, 6, 6, 3, 3, 2, 2]

# Country of the leading part of a district id.
COUNTRIES = {
    "BDI": "Burundi", "DJI": "Djibouti", "ERI": "Eritrea", "ETH": "Ethiopia", "KEN": "Kenya", "RWA": "Rwanda",
    "SOM": "Somalia", "SSD": "South Sudan", "SDN": "Sudan", "TZA": "Tanzania", "UGA": "Uganda",
}


def _missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def _edges_passed(x: Column, edges: Sequence[float]) -> Column:
    """How many edges are at or under the value."""
    count = F.lit(0)
    for e in edges:
        count = count + F.when(x >= e, 1).otherwise(0)
    return count


def rising(x: Column, edges: Sequence[float], missing: int) -> Column:
    """Index 1.. that grows with the value."""
    return F.when(_missing(x), missing).otherwise(_edges_passed(x, edges) + 1)


def falling(x: Column, edges: Sequence[float], missing: int, first: int = 1) -> Column:
    """Index that grows as the value falls; the highest values get ``first``."""
    return F.when(_missing(x), missing).otherwise(F.lit(first + len(edges)) - _edges_passed(x, edges))


def current_index(spi: Column) -> Column:
    return falling(spi, SPI_EDGES, 2)


def deficit_index(p: Column) -> Column:
    return rising(p, DEFICIT_EDGES, 1)


def spatial_index(share: Column) -> Column:
    return rising(share, SPATIAL_EDGES, 1)


def tail_index(spi: Column) -> Column:
    return falling(spi, TAIL_EDGES, 1)


def wrsi_index(w: Column) -> Column:
    return falling(w, WRSI_EDGES, 1)


def fpar_index(z: Column) -> Column:
    return falling(z, FPAR_EDGES, 1, first=2)


def trend_index(slope: Column, band: float = TREND_BAND) -> Column:
    return F.when(_missing(slope), 2).when(slope > band, 1).when(slope < -band, 3).otherwise(2)


def cdi_index(level: Column) -> Column:
    i = F.rint(level)
    return F.when(~_missing(level) & i.between(1, 6), i).otherwise(1).cast("int")


def label_index(label: Column, states: Sequence[str], default: int) -> Column:
    """Index of a label, case ignored; unknown and missing labels take the default."""
    at = F.array_position(F.array(*[F.lit(s.lower()) for s in states]), F.lower(F.trim(label)))
    return F.when(F.coalesce(at, F.lit(0)) > 0, at.cast("int")).otherwise(default)


def state_label(index: Column, states: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in states]), index.cast("int"))


def spi_label(spi: Column) -> Column:
    """Label of the evidence table, where missing is ``Unknown``."""
    return F.when(_missing(spi), "Unknown").otherwise(state_label(current_index(spi), SPI_STATES))


def cdi_level(klass: Column) -> Column:
    """Level 1..6 of a class 0..14; missing and out-of-range classes mean no drought."""
    c = F.coalesce(klass.cast("int"), F.lit(0))
    c = F.when(c.between(0, 14), c).otherwise(0)
    return F.element_at(F.array(*[F.lit(v) for v in CDI_CLASS_LEVEL]), c + 1)


def published_class(value: Column) -> Column:
    """Published class: missing is 0, anything else is cut to 0..14."""
    return F.when(_missing(value), 0).otherwise(F.least(F.greatest(value.cast("int"), F.lit(0)), F.lit(14)))


def country(district: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])
    return F.coalesce(F.element_at(table, F.split(district, r"\.")[0]), F.lit("Unknown"))
