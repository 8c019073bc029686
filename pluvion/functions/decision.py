"""Posterior sharpness and the cost-loss attention state."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pluvion.functions.categories import ATTENTION_COLOURS, ATTENTION_STATES, RISK_STATES, state_label


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def array_sum(probs: Column) -> Column:
    return F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)


def normalise(probs: Column) -> Column:
    """Divide by the sum; a vector that sums to 0 stays as it is."""
    divided = lambda p: bound(array_sum(p), lambda t: F.transform(p, lambda x: x / F.when(t > 0, t).otherwise(1.0)))
    return bound(probs, divided)


def confidence(probs: Column, states: int = 5) -> Column:
    """1 - H / ln k within 0..1: 0 for a flat vector, 1 for a certain one."""
    terms = F.transform(normalise(probs), lambda x: x * F.log(F.greatest(x, F.lit(1e-12))))
    sharp = 1.0 + array_sum(terms) / math.log(states)
    return F.when(array_sum(probs) > 0, F.least(F.greatest(sharp, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def top_state(probs: Column) -> Column:
    """Label of the largest probability, the first on ties."""
    return state_label(F.array_position(probs, F.array_max(probs)), RISK_STATES)


def attention(probs: Column, ratio: float = 0.2) -> Column:
    """Struct ``(state, colour, explanation)`` of the cost-loss rule.

    The masses above each rung are compared with the cost-loss ratio and its
    multiples, which have floors.
    """
    p = lambda i: F.element_at(probs, i)
    # The floors 0.40 and 0.30 and the texts of the rungs.
    rungs = [
        (4, p(4) + p(5), ratio, "High∪Extreme", "C/L="),
        (3, p(3) + p(4) + p(5), max(2 * ratio, 0.40), "Mod∪High∪Extreme", ""),
        (2, p(2) + p(3) + p(4) + p(5), max(3 * ratio, 0.30), "Low∪Mod∪High∪Extreme", ""),
    ]
    index = F.lit(1)
    text = F.lit("all conditional masses below thresholds")
    for k, mass, limit, name, tag in reversed(rungs):
        hit = mass >= limit
        index = F.when(hit, k).otherwise(index)
        shown = F.format_string(f"P({name})=%s ≥ {tag}{round(limit, 2)}", F.bround(mass, 2).cast("string"))
        text = F.when(hit, shown).otherwise(text)
    return F.struct(
        state_label(index, ATTENTION_STATES).alias("state"),
        state_label(index, ATTENTION_COLOURS).alias("colour"),
        text.alias("explanation"),
    )
