"""A regression network with one hidden layer, trained where the rows lie.

Training is data-parallel: in a round every partition starts from the same
weights, goes through its own rows in batches by Adam, and hands on its weights
and moments times its number of rows; their sums (``partials.tree_sum``), divided
by all rows, are the next round's.  With one partition this is plain Adam.  A
partition's rows come in the order in which they were written, and its batches
depend on nothing else, so a task that is run again after a loss gives the same
weights.  A task holds ``CHUNK`` rows at once, over which it goes ``EPOCHS`` times.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.partials import collected, tree_sum, vectors
from graphloom.sources.graph_store import written

BATCH, CHUNK, EPOCHS, ROUNDS = 200, 65536, 5, 20
HIDDEN, RATE = 100, 0.01
# Adam's usual decays.
FIRST, SECOND, TINY = 0.9, 0.999, 1e-8


@dataclass
class Network:
    """flat weights, scale of features, and the mean loss of each round."""

    weights: np.ndarray
    mean: np.ndarray
    dev: np.ndarray
    hidden: int
    losses: list[float]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w, b, out, c = unpacked(self.weights, len(self.mean), self.hidden)
        return np.maximum((x - self.mean) / self.dev @ w + b, 0) @ out + c[0]


def unpacked(p: np.ndarray, width: int, hidden: int) -> tuple[np.ndarray, ...]:
    at = width * hidden
    return p[:at].reshape(width, hidden), p[at : at + hidden], p[at + hidden : at + 2 * hidden], p[at + 2 * hidden :]


def gradient(p: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int) -> tuple[np.ndarray, float]:
    """Of half the mean squared error, and that loss."""
    w, b, out, c = unpacked(p, x.shape[1], hidden)
    z = x @ w + b
    h = np.maximum(z, 0)
    miss = h @ out + c[0] - y
    d = miss / len(y)
    back = np.outer(d, out) * (z > 0)
    return np.concatenate([(x.T @ back).ravel(), back.sum(0), h.T @ d, [d.sum()]]), float(0.5 * (miss * miss).mean())


def trained(state: np.ndarray, steps: int, chunks: Iterator[tuple[np.ndarray, np.ndarray]], hidden: int, rate: float = RATE, batch: int = BATCH, epochs: int = EPOCHS) -> tuple[np.ndarray, int, int, float]:
    """state (weights, first and second moments) after all chunks; rows, steps in
    all, and the loss summed over rows of the last epochs."""
    p, m, v = np.split(state.copy(), 3)
    rows, loss = 0, 0.0
    for x, y in chunks:
        for epoch in range(epochs):
            for lo in range(0, len(y), batch):
                g, own = gradient(p, x[lo : lo + batch], y[lo : lo + batch], hidden)
                steps += 1
                m = FIRST * m + (1 - FIRST) * g
                v = SECOND * v + (1 - SECOND) * g * g
                p = p - rate * (m / (1 - FIRST**steps)) / (np.sqrt(v / (1 - SECOND**steps)) + TINY)
                if epoch == epochs - 1:
                    loss += own * len(y[lo : lo + batch])
        rows += len(y)
    return np.concatenate([p, m, v]), rows, steps, loss


def start(width: int, hidden: int, centre: float, seed: int) -> np.ndarray:
    """Weights drawn from the seed; the output begins at the mean."""
    rng = np.random.default_rng(seed)
    p = np.concatenate([rng.normal(0, (2 / width) ** 0.5, width * hidden), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, hidden), [centre]])
    return np.concatenate([p, np.zeros(2 * len(p))])


def fit(points: DataFrame, hidden: int = HIDDEN, rounds: int = ROUNDS, rate: float = RATE, seed: int = 42) -> Network | None:
    """points: id, x, y; rows without x or y are left out.  None without rows."""
    rows = points.where(F.col("y").isNotNull() & (F.size("x") > 0)).select(F.xxhash64(F.col("id"), F.lit(seed)).alias("h"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"))
    rows = written(rows.sortWithinPartitions("h"), "network").select("x", "y")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append((vectors(b, "x"), b.column(1).to_numpy(zero_copy_only=False)))
                n += b.num_rows
            if n >= CHUNK:
                yield np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
                held, n = [], 0
        if n:
            yield np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        n, total = 0, 0.0
        for x, y in read(batches):
            n, total = n + len(y), total + np.concatenate([x.sum(0), (x * x).sum(0), [y.sum()]])
        if n:
            yield 0, n, total

    got = collected(tree_sum(rows, moments))
    if not got:
        return None
    n, total = got[0]
    width = (len(total) - 1) // 2
    mean = total[:width] / n
    dev = np.sqrt(np.maximum(total[width:-1] / n - mean * mean, 0)) + 1e-9
    state, steps, losses = start(width, hidden, float(total[-1] / n), seed), 0, []
    for _ in range(rounds):

        def kernel(batches: Iterator[pa.RecordBatch], state=state, steps=steps) -> Iterator[tuple[int, int, np.ndarray]]:
            own, k, made, loss = trained(state, steps, (((x - mean) / dev, y) for x, y in read(batches)), hidden, rate)
            if k:
                yield 0, k, np.concatenate([own * k, [made * k, loss]])

        n, total = collected(tree_sum(rows, kernel))[0]
        state, steps = total[:-2] / n, round(total[-2] / n)
        losses.append(float(total[-1] / n))
    return Network(state[: len(state) // 3], mean, dev, hidden, losses)


def predict(net: Network | None, queries: DataFrame) -> DataFrame:
    """id, predicted of queries (id, x); null without a network."""
    if net is None:
        return queries.select("id", F.lit(None).cast("double").alias("predicted"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net(vectors(b, "x")) if b.num_rows else [], pa.float64())], names=["id", "predicted"])

    return queries.select("id", F.col("x").cast("array<double>").alias("x")).mapInArrow(apply, f"id {queries.schema['id'].dataType.simpleString()}, predicted double")
