"""Approximate nearest neighbours by learned partitions (largest inner product).

Fit, on a bounded sample of ``SAMPLE`` distinct vectors (least hashes first):
their neighbour graph is cut into balanced parts - recursive halving along
principal directions, then moves that lower the number of cut edges while parts
stay within 5 % of even - and a softmax classifier learns, from each vector,
the parts in which its neighbours lie.  A quarter of the sample is kept out of
both; the number of parts a query probes is the least that finds ``AIM`` of the
true neighbours among these unseen vectors, queries and candidates alike.

Index: every vector goes to the classifier's most probable part; a part is held
in blocks of at most about ``BLOCK`` vectors, so that no task gathers a part.
Search: a query goes to the blocks of its most probable parts, where inner
products in double precision rerank everything: a matrix product finds what may be
among the nearest, and each of these is then multiplied and summed by itself, so
that a pair's score is the same in whatever block it is computed.

Equal vectors are indexed once, with the 21 least ids that share them: no more
can be among a query's 20 nearest, so this is exact, and a vector that a third
of all rows share costs as much as any other.

Nulls and odd input.  Rows whose id is null, or whose vector is null, empty,
zero or holds null or non-finite components, take no part, nor do vectors of
another length than most (the greater length if as many).  Repeated rows (id
and vector) count once; ids that repeat with other vectors are searched with
each, and no row is a neighbour of its own id.  A query with fewer candidates
gets all.  Extra columns are ignored.  No vectors or no queries, no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import staged

SAMPLE = 8192
PART_ROWS = 4096
PARTS = (16, 1024)
BLOCK = 8192
GRAPH = 10
AIM = 0.93


@dataclass
class Router:
    """Softmax classifier over parts, and how many of them a query probes."""

    weights: np.ndarray  # dim x parts
    bias: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row, by blocks."""
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 20) -> np.ndarray:
    """A balanced partition of the neighbour graph into ``parts`` (a power of 2)."""
    own = np.zeros(len(x), np.int64)
    half = 1
    while half < parts:
        for p in range(half):
            rows = np.flatnonzero(own == p)
            c = x[rows] - x[rows].mean(axis=0)
            axis = np.linalg.eigh(c.T @ c)[1][:, -1] if len(rows) > 1 else np.zeros(x.shape[1])
            order = rows[np.argsort(c @ axis, kind="stable")]
            own[order[len(order) // 2 :]] += half
        half *= 2
    src, dst = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    low, high = int(0.95 * len(x) / parts), int(np.ceil(1.05 * len(x) / parts))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (src, own[dst]), 1)
        to = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), to] - votes[np.arange(len(x)), own]
        sizes, moved = np.bincount(own, minlength=parts), 0
        # a third of the best movers at a time, since neighbours move as well
        movers = np.flatnonzero(gain > 0)
        movers = movers[np.argsort(-gain[movers], kind="stable")][: max(1, len(movers) // 3)]
        for v in movers:
            if sizes[to[v]] < high and sizes[own[v]] > low:
                sizes[own[v]] -= 1
                sizes[to[v]] += 1
                own[v], moved = to[v], moved + 1
        if not moved:
            break
    return own


def train_router(x: np.ndarray, parts: int, steps: int = 150, k: int = 20) -> Router:
    """Router from sampled vectors.  Fewer than are needed to fill the parts can't
    be partitioned: they are one part."""
    held_out = np.arange(len(x)) % 4 == 0
    learn, unseen = x[~held_out], x[held_out]
    if len(learn) <= max(2 * parts, GRAPH + 1):
        return Router(np.zeros((x.shape[1] if len(x) else 0, 1)), np.zeros(1), 1)
    near = nearest(learn, GRAPH)
    own = balanced_parts(learn, near, parts)
    target = np.zeros((len(learn), parts))
    target[np.arange(len(learn)), own] = GRAPH / 2
    np.add.at(target, (np.repeat(np.arange(len(learn)), GRAPH), own[near].ravel()), 1)
    target /= target.sum(axis=1, keepdims=True)
    scale = np.sqrt((x**2).sum(axis=1).mean())
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, steps + 1):
        z = learn @ w / scale + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True) - target) / len(learn)
        for k_, (g, par) in enumerate(((learn.T @ p / scale + 1e-5 * w, w), (p.sum(axis=0), b))):
            m[k_] += 0.1 * (g - m[k_])
            v[k_] += 0.01 * (g * g - v[k_])
            par -= 0.3 * (m[k_] / (1 - 0.9**t)) / (np.sqrt(v[k_] / (1 - 0.99**t)) + 1e-9)
    router = Router(w / scale, b, parts)
    logits = router.logits(unseen)
    home, true = logits.argmax(axis=1), nearest(unseen, min(k, len(unseen) - 1))
    place = np.argsort(np.argsort(-logits, axis=1, kind="stable"), axis=1)
    found = np.sort(place[np.arange(len(unseen))[:, None], home[true]].ravel())
    router.probes = int(found[min(len(found) - 1, int(np.ceil(AIM * len(found))))]) + 1
    return router


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, e (doubles), k1, k2 (hashes of the vector), once for each id and vector."""
    e = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), e.alias("e")).where(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).where(F.coalesce(sound, F.lit(False)))
    dim = rows.groupBy(F.size("e").alias("d")).count().agg(F.max_by("d", F.struct("count", "d"))).first()[0]
    rows = rows.where(F.size("e") == F.lit(dim)) if dim is not None else rows
    return rows.select("vec_id", "e", F.xxhash64("e").alias("k1"), F.xxhash64(F.lit(1), "e").alias("k2")).dropDuplicates(["vec_id", "k1", "k2"])


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row.

    is_query: a condition on vec_id."""
    rows = staged(usable(vectors, id_col, vec_col), "vectors")
    nth = Window.partitionBy("k1", "k2").orderBy("vec_id")
    few = rows.withColumn("_r", F.row_number().over(nth)).where(F.col("_r") <= k + 1)
    units = few.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.any_value("e").alias("e"))
    asked = rows.where(is_query).select("k1", "k2").distinct().withColumn("q", F.lit(True))
    units = staged(units.join(asked, ["k1", "k2"], "left").withColumn("q", F.coalesce("q", F.lit(False))), "units")
    count = units.count()
    parts = PARTS[0]
    while parts < PARTS[1] and parts * PART_ROWS < count:
        parts *= 2
    sample = [r[0] for r in units.orderBy("k1", "k2").limit(SAMPLE).select("e").collect()]
    router = train_router(np.array(sample, np.float64).reshape(len(sample), len(sample[0]) if sample else 0), parts)
    held = units.sparkSession.sparkContext.broadcast(router)

    def route(batches):
        for batch in batches:
            logits = held.value.logits(_matrix(batch.column(3)))
            order = np.argsort(-logits, axis=1, kind="stable")[:, : held.value.probes].astype(np.int32)
            probes = [o.tolist() if q else [] for o, q in zip(order, batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(order[:, 0], pa.int32()), pa.array(probes, pa.list_(pa.int32()))], names=["k1", "k2", "ids", "e", "part", "probes"])

    placed = staged(units.select("k1", "k2", "ids", "e", "q").mapInArrow(route, "k1 long, k2 long, ids array<long>, e array<double>, part int, probes array<int>"), "placed")
    # at most one row for each part: blocks of its vectors, chunks of its queries
    pieces = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    routed = placed.select(F.explode("probes").alias("part")).groupBy("part").agg(pieces(F.count("*")).alias("chunks"))
    sizes = F.broadcast(placed.groupBy("part").agg(pieces(F.count("*")).alias("blocks")).join(routed, "part"))
    data = placed.join(sizes, "part").select("part", F.pmod("k1", "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "ids", "e")
    asks = placed.select("k1", "k2", "e", F.explode("probes").alias("part")).join(sizes, "part")
    asks = asks.select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod("k2", "chunks").cast("int").alias("chunk"), "k1", "k2", F.col("e").alias("asked"))

    def rerank(queries: pa.Table, own: pa.Table) -> pa.Table:
        empty = pa.table({"k1": pa.array([], pa.int64()), "k2": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        if not len(queries) or not len(own):
            return empty
        q, x = _matrix(queries.column("asked").combine_chunks()), _matrix(own.column("e").combine_chunks())
        k1, k2, ids = queries.column("k1").to_numpy(), queries.column("k2").to_numpy(), own.column("ids").combine_chunks()
        first, top = np.array(ids.values)[np.array(ids.offsets)[:-1]], min(k + 1, len(x))
        out, longest = [], (x**2).sum(axis=1).max()
        for lo in range(0, len(q), 256):
            s = q[lo : lo + 256] @ x.T
            edge = -np.partition(-s, top - 1, axis=1)[:, top - 1]
            # sums of a matrix product may differ in their last bits from block to block
            slack = 1e-12 * np.sqrt((q[lo : lo + 256] ** 2).sum(axis=1) * longest)
            r, c = np.nonzero(s >= (edge - slack)[:, None])
            score = (q[lo + r] * x[c]).sum(axis=1)
            order = np.lexsort((first[c], -score, r))  # ties go by id
            r, c, score = r[order], c[order], score[order]
            start = np.searchsorted(r, np.arange(len(s)))
            keep = np.arange(len(r)) - start[r] < top
            r, c = r[keep], c[keep]
            out.append(pa.table({"k1": k1[lo + r], "k2": k2[lo + r], "ids": ids.take(pa.array(c)), "score": score[keep]}))
        return pa.concat_tables(out)

    found = asks.groupBy("part", "block", "chunk").cogroup(data.groupBy("part", "block", "chunk")).applyInArrow(rerank, "k1 long, k2 long, ids array<long>, score double")
    best = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), F.col("ids")[0])
    groups = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    hits = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("vec_id")))
    lists = groups.groupBy("k1", "k2").agg(F.slice(F.array_sort(F.flatten(F.collect_list(hits))), 1, k + 1).alias("hits"))
    answers = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "k1", "k2").join(lists, ["k1", "k2"])
    others = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    flat = answers.select("query_id", F.posexplode(others).alias("at", "hit"))
    return flat.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
