"""Distributed k-means with several restarts.

All restarts go through the data together: a pass computes, for each of them,
the nearest centre of every point and adds up sums, counts and inertia by
partition (``partials.tree_sum``), so that an iteration moves restarts x k x
places numbers a partition and no points.  Seeds come from k-means||: in each of
a few passes every point is drawn with a probability of its share in the cost so
far, by a hash of its id, which gives some 2 k candidates a pass; candidates are
weighed by the points nearest to them and reduced to k by weighted k-means++ on
the driver.  The restart with the least inertia wins.

A restart has come to rest when its centres move by at most ``tol`` times the
mean variance of the places.  A centre without points stays where it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.partials import collected, tree_sum, vectors
from graphloom.sources.graph_store import written

#: Rows whose distances a task holds at once.
BLOCK = 4096


@dataclass
class Clusters:
    """centres[k, place], inertia of the best restart, and of all; passes made."""

    centres: np.ndarray
    inertia: float
    inertias: list[float]
    passes: int


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None], 0.0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK):
            yield b.slice(lo, BLOCK)


def uniform(ids: list[str], *salt: int) -> np.ndarray:
    """A number in [0, 1) for each id, by hash."""
    import xxhash

    head = ("|".join(map(str, salt)) + "|").encode()
    return np.array([xxhash.xxh64_intdigest(head + i.encode()) for i in ids], np.uint64).astype(np.float64) / 2.0**64


def lloyd_sums(points: DataFrame, starts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """sums[k, place], counts[k] and inertia for each set of centres, in one pass."""
    shape = [c.shape for c in starts]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        sums, counts, cost, n = [np.zeros(s) for s in shape], [np.zeros(s[0]) for s in shape], np.zeros(len(shape)), 0
        for b in _blocks(batches):
            x = vectors(b, "emb")
            n += len(x)
            for r, c in enumerate(starts):
                d = distances(x, c)
                own = d.argmin(1)
                counts[r] += np.bincount(own, minlength=len(c))
                np.add.at(sums[r], own, x)
                cost[r] += d[np.arange(len(x)), own].sum()
        for r in range(len(shape)):
            yield r, n, np.concatenate([sums[r].ravel(), counts[r], cost[r : r + 1]])

    got, out = collected(tree_sum(points.select("emb"), kernel)), []
    for r, (k, d) in enumerate(shape):
        v = got[r][1]
        out.append((v[: k * d].reshape(k, d), v[k * d : -1], float(v[-1])))
    return out


def drawn(points: DataFrame, sets: list[np.ndarray], costs: list[float], want: float, seed: int, turn: int) -> list[np.ndarray]:
    """Points drawn with probability ``want`` x their share in each set's cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            x, ids = vectors(b, "emb"), b.column(0).to_pylist()
            for r, c in enumerate(sets):
                hit = np.flatnonzero(uniform(ids, seed, r, turn) * costs[r] < want * distances(x, c).min(1))
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), r)), b.column(0).take(pa.array(hit)), b.column(1).take(pa.array(hit))], names=["r", "id", "emb"])

    rows = points.select("id", "emb").mapInArrow(run, "r long, id string, emb array<double>").collect()  # some 2 k points a restart
    return [np.array([x.emb for x in sorted((x for x in rows if x.r == r), key=lambda x: x.id)]).reshape(-1, sets[r].shape[1]) for r in range(len(sets))]


def reduced(candidates: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the candidates by weighted k-means++."""
    chosen = [candidates[rng.choice(len(candidates), p=weight / weight.sum())]]
    while len(chosen) < k:
        gain = weight * distances(candidates, np.array(chosen)).min(1)
        if gain.sum() <= 0:
            break  # fewer different points than clusters
        chosen.append(candidates[rng.choice(len(candidates), p=gain / gain.sum())])
    return np.array(chosen)


def seeded(points: DataFrame, k: int, restarts: int, seed: int, turns: int = 4) -> list[np.ndarray]:
    """Starting centres of each restart by k-means||."""
    firsts = points.agg(*[F.min_by("emb", F.struct(F.xxhash64("id", F.lit(seed), F.lit(r)), "id")) for r in range(restarts)]).first()
    sets = [np.array([f], np.float64) for f in firsts]
    for turn in range(turns):
        costs = [cost for _, _, cost in lloyd_sums(points, sets)]
        if max(costs) <= 0:
            break
        sets = [np.concatenate([c, new]) for c, new in zip(sets, drawn(points, sets, costs, 2.0 * k, seed, turn), strict=True)]
    weights = [counts for _, counts, _ in lloyd_sums(points, sets)]
    return [reduced(c, w, k, np.random.default_rng([seed, r])) for r, (c, w) in enumerate(zip(sets, weights, strict=True))]


def lloyd(points: DataFrame, starts: list[np.ndarray], most: int = 300, tol: float = 1e-4) -> Clusters:
    """Lloyd's iterations of all starts until each has come to rest."""
    centres, moving, passes, spread = [c.copy() for c in starts], list(range(len(starts))), 0, None
    inertia = [float("inf")] * len(starts)
    while moving and passes < most:
        found = lloyd_sums(points, [centres[r] for r in moving])
        passes += 1
        if spread is None:
            spread = _mean_variance(points)
        still = []
        for r, (sums, counts, cost) in zip(moving, found, strict=True):
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres[r])
            shift = ((new - centres[r]) ** 2).sum()
            centres[r], inertia[r] = new, cost
            if shift > tol * spread:
                still.append(r)
        moving = still
    inertia = [cost for _, _, cost in lloyd_sums(points, centres)]  # of the centres as they stand
    best = int(np.argmin(inertia))
    return Clusters(centres[best], inertia[best], inertia, passes)


def _mean_variance(points: DataFrame) -> float:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        n, s, q = 0, 0.0, 0.0
        for b in _blocks(batches):
            x = vectors(b, "emb")
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        if n:
            yield 0, n, np.concatenate([s, q])

    got = collected(tree_sum(points.select("emb"), kernel))
    n, v = got[0]
    s, q = np.split(v / n, 2)
    return float(np.maximum(q - s * s, 0).mean())


def assigned(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """``points`` with cluster (ties to the lower one) and distance2."""
    names = points.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            d = distances(vectors(b, "emb"), centres)
            own = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(d[np.arange(len(own)), own])], names=[*names, "cluster", "distance2"])

    schema = T.StructType([*points.schema.fields, T.StructField("cluster", T.LongType()), T.StructField("distance2", T.DoubleType())])
    return points.mapInArrow(run, schema)


def kmeans(points: DataFrame, k: int, restarts: int = 10, most: int = 300, seed: int = 42, tol: float = 1e-4) -> tuple[DataFrame, Clusters | None]:
    """points (id, emb and others) with cluster and distance2; and the centres.

    Rows without a vector, or with one of a rarer length than most, take no part."""
    own = points.where(F.size("emb") > 0).withColumns({"id": F.col("id").cast("string"), "emb": F.col("emb").cast("array<double>")})
    own = written(own, "kmeans")
    length = own.select(F.size("emb").alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not length:
        return own.withColumns({"cluster": F.lit(None).cast("long"), "distance2": F.lit(None).cast("double")}), None
    own = own.where(F.size("emb") == length[0].d)
    found = lloyd(own, seeded(own, k, restarts, seed), most, tol)
    return assigned(own, found.centres), found
