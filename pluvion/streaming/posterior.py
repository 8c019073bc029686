"""Posterior state per boundary carried from month to month over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def monthly_posteriors(stream: DataFrame, key: str, month: str, likelihood: str, decay: float = 0.6, lookback: int = 6) -> DataFrame:
    """``(key, month, posterior, temporal_prior)`` with the previous posterior as prior.

    The state of a boundary is its last posterior and its chain length, the
    same fold as ``plans.risk.monthly_sequence``. Months must arrive in order
    between batches; inside a batch they are put in order.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(month)
        previous, length = state.get if state.exists else (None, 0)
        out = []
        for when, lik in zip(rows[month], rows[likelihood]):
            post = np.asarray(lik, dtype=float)
            used = previous is not None and length < lookback
            if used:
                prior = decay * np.asarray(previous, dtype=float) + (1.0 - decay) * 0.2
                joint = post * (prior / prior.sum())
                post = joint / joint.sum() if joint.sum() > 0 else joint
            length = length + 1 if previous is not None else 1
            previous = post.tolist()
            out.append((keys[0], when, previous, used))
        state.update((previous, length))
        yield pd.DataFrame(out, columns=[key, month, "posterior", "temporal_prior"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(
        step,
        outputStructType=f"{key} {kind}, {month} string, posterior array<double>, temporal_prior boolean",
        stateStructType="posterior array<double>, length int",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )
