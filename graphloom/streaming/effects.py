"""The edge-effect moving average over a stream of history rows.

State is one small row for each (task, edge_type); a stream's answer after all
rows is the batch operator's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

KEEP = 0.7
OUT = "task long, edge_type string, usage long, successes long, total double, ema double"
STATE = "usage long, successes long, total double, ema double"


def streaming_effects(deltas: DataFrame) -> DataFrame:
    """Updates of (task, edge_type) from a stream of task, edge_type, iteration,
    delta; rows of one trigger are taken in the order of iteration."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        usage, successes, total, ema = state.get if state.exists else (0, 0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values("iteration")
        for delta in rows["delta"].tolist():
            ema = delta if usage == 0 else KEEP * ema + (1 - KEEP) * delta
            usage, successes, total = usage + 1, successes + (delta > 0), total + delta
        state.update((usage, int(successes), total, ema))
        yield pd.DataFrame([(*key, usage, int(successes), total, ema)], columns=["task", "edge_type", "usage", "successes", "total", "ema"])

    return deltas.groupBy("task", "edge_type").applyInPandasWithState(update, OUT, STATE, "update", "NoTimeout")
