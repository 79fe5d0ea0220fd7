"""Reward weights that adapt to the course of each task's run.

A task's state (weights, first weights, how many iterations there were, and at
which the weights last changed) goes through its iterations in order.  From the
third on, and two after the last change, a trend changes the weights: a plateau
weighs changes more, a decline the level, an oscillation the baseline, and an
improvement pulls all back to the first weights; the three then sum to one.

The same step runs in three ways: over a table (rows sorted by task and
iteration, the state carried from batch to batch, so a task's length doesn't
matter), over a stream with the state kept by Spark, and from a saved state on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = ("baseline", "relative", "raw", "bonus", "plateau")
COLUMNS = ", ".join(f"{n} double" for n in NAMES)
# Fixed values of the rule: the first iteration that may change weights, the
# iterations between changes, and the largest step.
WARM_UP, EVERY, STEP, PULL = 3, 2, 0.1, 0.3


@dataclass(frozen=True)
class Weights:
    """Shares of baseline, relative and raw reward; bonus and plateau penalty."""

    baseline: float = 0.1
    relative: float = 0.1
    raw: float = 0.8
    bonus: float = 0.0
    plateau: float = -0.05

    def shared(self) -> Weights:
        """With the three shares summing to one, where their sum isn't zero."""
        total = self.baseline + self.relative + self.raw
        return self if total == 0 else Weights(self.baseline / total, self.relative / total, self.raw / total, self.bonus, self.plateau)

    def after(self, trend: str, first: Weights, step: float = STEP, pull: float = PULL) -> Weights:
        b, r, w, bonus, plateau = self.baseline, self.relative, self.raw, self.bonus, self.plateau
        if trend == "plateau":
            r, bonus, plateau = min(0.7, r + step * 0.5), min(0.2, bonus + step * 0.3), max(-0.05, plateau - 0.01)
        elif trend == "declining":
            w, r = min(0.4, w + step * 0.3), max(0.3, r - step * 0.2)
        elif trend == "oscillating":
            b, bonus = min(0.5, b + step * 0.4), max(0.05, bonus - step * 0.2)
        elif trend == "improving":
            b, r, w = (x + pull * (y - x) for x, y in ((b, first.baseline), (r, first.relative), (w, first.raw)))
        else:
            return self
        return Weights(b, r, w, bonus, plateau).shared()


@dataclass(frozen=True)
class State:
    weights: Weights = field(default_factory=Weights)
    first: Weights = field(default_factory=Weights)
    count: int = 0
    changed: int = 0

    def update(self, trend: str | None, enabled: bool = True) -> State:
        n = self.count + 1
        if not enabled or n < WARM_UP or n - self.changed < EVERY:
            return State(self.weights, self.first, n, self.changed)
        new = self.weights.after(trend or "unknown", self.first)
        known = trend in ("plateau", "declining", "oscillating", "improving")
        return State(new, self.first, n, n if known else self.changed)

    def reset(self) -> State:
        return State(self.first, self.first)

    def saved(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def loaded(text: str | None, first: Weights | None = None) -> State:
        if not text:
            return State(first or Weights(), first or Weights())
        d = json.loads(text)
        return State(Weights(**d["weights"]), Weights(**d["first"]), d["count"], d["changed"])


def adapted(history: DataFrame, first: Weights | None = None, saved: DataFrame | None = None) -> DataFrame:
    """task, iteration, the five weights after it, and state (to be saved).

    history: task, iteration, trend; saved: task, state, where tasks go on from."""
    rows = history.select("task", "iteration", "trend")
    rows = rows.join(saved.select("task", "state"), "task", "left") if saved is not None else rows.withColumn("state", F.lit(None).cast("string"))
    kind = {f.name: f.dataType.simpleString() for f in history.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), None
        for b in batches:
            tasks, trends, saved = (b.column(k).to_pylist() for k in (0, 2, 3))
            out = []
            for task, trend, own in zip(tasks, trends, saved, strict=True):
                if state is None or task != at:
                    at, state = task, State.loaded(own, first)
                state = state.update(trend)
                out.append((*(getattr(state.weights, n) for n in NAMES), state.saved()))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, pa.float64()) for c in cols[:5]], pa.array(cols[5], pa.string())], names=["task", "iteration", *NAMES, "state"])

    ordered = rows.repartition("task").sortWithinPartitions("task", "iteration")
    return ordered.mapInArrow(run, f"task {kind['task']}, iteration {kind['iteration']}, {COLUMNS}, state string")


def last_states(found: DataFrame) -> DataFrame:
    """task, state after each task's last iteration."""
    return found.groupBy("task").agg(F.max_by("state", "iteration").alias("state"))


def streamed(history: DataFrame, first: Weights | None = None, mode: str = "update") -> DataFrame:
    """``adapted`` over a stream: state by task is Spark's, a trigger's rows of a
    task are taken in the order of iteration.  Needs the RocksDB state store."""
    from pyspark.sql.streaming import StatefulProcessor

    class Process(StatefulProcessor):
        def init(self, handle) -> None:
            self.held = handle.getValueState("state", "state string")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            state = State.loaded(self.held.get()[0] if self.held.exists() else None, first)
            out = []
            for r in pd.concat(list(rows)).sort_values("iteration").itertuples():
                state = state.update(r.trend)
                out.append((key[0], r.iteration, *(getattr(state.weights, n) for n in NAMES), state.saved()))
            self.held.update((state.saved(),))
            yield pd.DataFrame(out, columns=["task", "iteration", *NAMES, "state"])

        def close(self) -> None:
            pass

    kind = {f.name: f.dataType.simpleString() for f in history.schema.fields}
    return history.select("task", "iteration", "trend").groupBy("task").transformWithStateInPandas(Process(), f"task {kind['task']}, iteration {kind['iteration']}, {COLUMNS}, state string", mode, "None")
