"""Random forests whose trees are grown on executors, and never pass the driver.

Features become numbers of bins, one byte each, by quantiles of all rows.  Rows go
once to each of a few groups of trees; a group's task grows its trees, fold by fold,
over all rows at once, level by level, scores the rows that the fold leaves out and
drops the trees: what leaves it is one sum a row.  What a tree draws (rows by a
Poisson law, a node's features) depends on ids and numbers only, so neither the
groups nor a task that is run again change a result.  Variance and Gini impurity of
two classes have the same best split, so both kinds of forest grow alike.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.graph_store import written

#: Bins of a feature, and bytes of bins that a task holds (more rows go to Spark's own forest).
BINS, TASK_BYTES = 32, 1 << 28
#: Cells of a level's histograms held at once.
CELLS = 1 << 20
#: Chances that a row is drawn so many times or fewer, by the Poisson law of mean 1.
DRAWN = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def fits(points: DataFrame, x: str) -> bool:
    """Whether all rows' bins fit a task."""
    n, width = points.agg(F.count("*"), F.max(F.size(x))).first()
    return n * max(1, width or 0) <= TASK_BYTES


def quantiles(points: DataFrame, x: str) -> list[np.ndarray]:
    """Each feature's bounds between bins."""
    shares = [k / BINS for k in range(1, BINS)]
    rows = points.select(F.posexplode(x).alias("f", "v")).groupBy("f").agg(F.percentile_approx("v", shares, 10000).alias("q")).collect()  # a row a feature
    return [np.unique(r.q) for r in sorted(rows, key=lambda r: r.f)]


def binned(points: DataFrame, bounds: list[np.ndarray], x: str) -> DataFrame:
    """``points`` with ``x`` as bytes: the number of bounds less than each value."""
    from pyspark.sql import types as T

    names, at = points.columns, points.columns.index(x)
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == x else f for f in points.schema.fields])

    def run(batches):
        for b in batches:
            v = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(bounds))
            out = np.empty(v.shape, np.uint8)
            for f, q in enumerate(bounds):
                out[:, f] = np.searchsorted(q, v[:, f], side="left")
            cols = list(b.columns)
            cols[at] = pa.array([r.tobytes() for r in out], pa.binary())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return points.mapInArrow(run, schema)


def draws(h: np.ndarray, seed: int, tree: int, fold: int) -> np.ndarray:
    """How often a tree draws each row, by the hash of its id."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(((seed * 1_000_003 + tree) * 1_009 + fold + 7) % 2**63)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return np.searchsorted(DRAWN, (z >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right")


def grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, features: int, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """feature (-1: a leaf), bin, left child (the right one follows) and mean of each
    node of a tree over rows of bins x, targets y and weights w above 0."""
    width = x.shape[1]
    feature, cut, left, value = [], [], [], []
    rows, node, nodes, made = np.arange(len(y)), np.zeros(len(y), np.int64), 1, 1
    for level in range(depth + 1):
        wn, sn = np.bincount(node, w[rows], nodes), np.bincount(node, w[rows] * y[rows], nodes)
        best_f, best_b, child = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        lo, hi = np.full(nodes, np.inf), np.full(nodes, -np.inf)
        if len(rows):  # rows lie by node
            first = np.searchsorted(node, np.arange(nodes))
            lo, hi = np.minimum.reduceat(y[rows], first), np.maximum.reduceat(y[rows], first)
        open_ = np.flatnonzero(hi > lo) if level < depth else np.zeros(0, np.int64)
        step = max(1, CELLS // (features * BINS))
        ends = np.append(first, len(rows)) if len(rows) else np.zeros(nodes + 1, np.int64)
        for at in range(0, len(open_), step):
            own = open_[at : at + step]
            sizes = ends[own + 1] - ends[own]
            of = np.repeat(np.arange(len(own)), sizes)
            r = rows[np.repeat(ends[own] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(len(of))]
            tried = np.argpartition(rng.random((len(own), width)), features - 1, axis=1)[:, :features] if features < width else np.tile(np.arange(width), (len(own), 1))
            place = ((of[:, None] * features + np.arange(features)) * BINS + x[r[:, None], tried[of]]).ravel()
            shape, total = (len(own), features, BINS), len(own) * features * BINS
            wl = np.bincount(place, np.repeat(w[r], features), total).reshape(shape).cumsum(axis=2)[:, :, :-1]
            sl = np.bincount(place, np.repeat(w[r] * y[r], features), total).reshape(shape).cumsum(axis=2)[:, :, :-1]
            wr, sr = wn[own][:, None, None] - wl, sn[own][:, None, None] - sl
            tiny = 1e-9 * wn[own][:, None, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((wl > tiny) & (wr > tiny), sl * sl / wl + sr * sr / wr, -np.inf).reshape(len(own), -1)
            best = gain.argmax(axis=1)
            base = sn[own] ** 2 / wn[own]
            good = gain[np.arange(len(own)), best] > base + 1e-12 * np.abs(base)
            best_f[own[good]] = tried[np.arange(len(own)), best // (BINS - 1)][good]
            best_b[own[good]] = (best % (BINS - 1))[good]
        split = np.flatnonzero(best_f >= 0)
        child[split] = made + 2 * np.arange(len(split))
        feature.append(best_f), cut.append(best_b), left.append(child), value.append(sn / wn)
        if not len(split):
            break
        stays = best_f[node] >= 0
        rows, node = rows[stays], node[stays]
        right = x[rows, best_f[node]] > best_b[node]
        node = child[node] - made + right
        order = np.argsort(node, kind="stable")
        rows, node, nodes = rows[order], node[order], 2 * len(split)
        made += nodes
    return tuple(np.concatenate(c) for c in (feature, cut, left, value))


def reached(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The mean of the leaf that each row comes to."""
    feature, cut, left, value = tree
    at, going = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(going):
        going = going[feature[at[going]] >= 0]
        now = at[going]
        at[going] = left[now] + (x[going, feature[now]] > cut[now])
    return value[at]


def held_out(points: DataFrame, folds: list[int], trees: int, depth: int, seed: int, features) -> DataFrame:
    """id, fold, y, predicted of the rows of each fold, by a forest over all others.

    points: id, fold, y, weight, x (an array); features: from the width to how many a node tries.
    Bounds of bins are those of rows that some fold learns from, whatever their targets."""
    bounds = quantiles(points if len(folds) > 1 else points.where(~F.col("fold").isin(folds)), "x")
    rows = binned(points.select("id", "fold", "y", "weight", "x"), bounds, "x")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "binned")
    groups = min(trees, 4 * points.sparkSession.sparkContext.defaultParallelism)
    m = max(1, min(len(bounds), features(len(bounds))))
    width = len(bounds)

    def grow(t: pa.Table) -> pa.Table:
        col = lambda c: t.column(c).to_numpy()
        order = np.lexsort((col("row"), col("h")))
        h, fold, y, weight, row = (col(c)[order] for c in ("h", "fold", "y", "weight", "row"))
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.uint8).reshape(len(y), width)[order]
        group, total = int(t.column("g")[0].as_py()), np.zeros(len(y))
        for f in folds:
            test = np.flatnonzero(fold == f)
            learn = np.flatnonzero(fold != f)
            if not len(test) or not len(learn):
                continue
            mean = float(np.average(y[learn], weights=weight[learn]))
            for k in range(group, trees, groups):
                w = draws(h[learn], seed, k, f) * weight[learn]
                own = learn[w > 0] if (w > 0).any() else learn
                w = w[w > 0] if (w > 0).any() else weight[learn]
                rng = np.random.default_rng([seed, k, f])
                total[test] += mean + reached(grown(x[own], y[own] - mean, w, m, depth, rng), x[test])
        asked = np.isin(fold, folds)
        return pa.table({"g": pa.array(np.full(asked.sum(), group), pa.int32()), "row": pa.array(row[asked], pa.int64()), "s": pa.array(total[asked], pa.float64())})

    dealt = rows.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "row", F.xxhash64("id").alias("h"), F.col("fold").cast("long").alias("fold"), F.col("y").cast("double").alias("y"), F.col("weight").cast("double").alias("weight"), "x")
    sums = written(dealt.repartition(groups, "g").groupBy("g").applyInArrow(grow, "g int, row long, s double"), "votes")
    # in the order of groups, so that sums are the same in every run
    mean = F.aggregate(F.array_sort(F.collect_list(F.struct("g", "s"))), F.lit(0.0), lambda a, v: a + v["s"]) / float(trees)
    return rows.drop("x").join(sums.groupBy("row").agg(mean.alias("predicted")), "row").select("id", "fold", "y", "predicted")
