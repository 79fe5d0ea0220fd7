"""Metrics and evaluation plans: ranks, contingency tables, sums; no collection.

A scored table has y (0/1), score; a clustered one has truth, cluster.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.sampling import numbered


def ranked(scored: DataFrame, by: list[str]) -> DataFrame:
    """A row for each distinct score in ``by``: n, p (rows, and positive ones, of
    that score), below_n, below_p (of smaller scores), all_n, all_p.

    Scores are dealt to ranges and summed by range first; the running sums run
    within a range and start at the sums of the ranges before, so no task holds
    more than its range.  The ranges are kept, since they are read twice."""
    from graphloom.sources.graph_store import written

    per = scored.groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    per = written(per.repartitionByRange(*by, "score").withColumn("_p", F.spark_partition_id()), "ranges")
    group, before = Window.partitionBy(*by), lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = per.groupBy(*by, "_p").agg(F.sum("n").alias("sn"), F.sum("p").alias("sp"))
    upto = before(group.orderBy("_p"))
    totals = totals.select(*by, "_p", F.coalesce(F.sum("sn").over(upto), F.lit(0)).alias("fn"), F.coalesce(F.sum("sp").over(upto), F.lit(0)).alias("fp"), F.sum("sn").over(group).alias("all_n"), F.sum("sp").over(group).alias("all_p"))
    within = before(Window.partitionBy(*by, "_p").orderBy("score"))
    run = per.withColumn("wn", F.coalesce(F.sum("n").over(within), F.lit(0))).withColumn("wp", F.coalesce(F.sum("p").over(within), F.lit(0)))
    return run.join(totals, [*by, "_p"]).select(*by, "score", "n", "p", (F.col("fn") + F.col("wn")).alias("below_n"), (F.col("fp") + F.col("wp")).alias("below_p"), "all_n", "all_p")


def auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve by the rank sum, ties sharing their mean rank."""
    return areas(scored, by).select(*by, "auc")


def average_precision(scored: DataFrame, by: list[str]) -> DataFrame:
    return areas(scored, by).select(*by, "ap")


def areas(scored: DataFrame, by: list[str]) -> DataFrame:
    """auc and ap of each group, from one ranking."""
    r, n1, n0 = ranked(scored, by), F.col("n1"), F.col("n") - F.col("n1")
    rank = F.col("below_n") + (F.col("n") + 1) / 2.0
    tp, seen = F.col("all_p") - F.col("below_p"), F.col("all_n") - F.col("below_n")
    gain = F.when(F.col("all_p") > 0, F.col("p") / F.greatest(F.col("all_p"), F.lit(1)) * tp / seen).otherwise(0.0)
    s = r.groupBy(*by).agg(F.sum(rank * F.col("p")).alias("s"), F.sum("p").alias("n1"), F.sum("n").alias("n"), F.sum(gain).alias("ap"))
    value = F.when((n1 > 0) & (n0 > 0), (F.col("s") - n1 * (n1 + 1) / 2.0) / F.greatest(n1 * n0, F.lit(1))).otherwise(0.5)
    return s.select(*by, value.alias("auc"), "ap")


def one_vs_rest(scores: DataFrame, by: list[str]) -> DataFrame:
    """Macro average of each class's area against all others.

    scores: truth, class, score: a row for each example and class.  Classes that
    no example has, or all have, say nothing and are left out; 0.5 if none is left."""
    y = scores.withColumn("y", (F.col("truth") == F.col("class")).cast("long"))
    each = areas(y, [*by, "class"]).join(y.groupBy(*by, "class").agg(F.min("y").alias("lo"), F.max("y").alias("hi")), [*by, "class"])
    return each.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("lo") < F.col("hi"), F.col("auc"))), F.lit(0.5)).alias("auc"))


def classification(predicted: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy and macro F1 (0 where a class has none) of truth, predicted."""
    cells = predicted.groupBy(*by, "truth", "predicted").agg(F.count("*").alias("n"))
    classes = cells.select(*by, F.explode(F.array("truth", "predicted")).alias("c"), "n", (F.col("truth") == F.col("predicted")).alias("right"), "truth", "predicted")
    per = classes.distinct().groupBy(*by, "c").agg(F.sum(F.when((F.col("truth") == F.col("c")) & F.col("right"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("truth") == F.col("c"), F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("predicted") == F.col("c"), F.col("n")).otherwise(0)).alias("p"))
    f1 = F.col("tp") * 2.0 / F.greatest(F.col("t") + F.col("p"), F.lit(1))
    return per.groupBy(*by).agg((F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def clustering(assigned: DataFrame, by: list[str]) -> DataFrame:
    """Adjusted Rand index, homogeneity, completeness and V (equal to the
    arithmetic NMI) from the contingency table."""
    cells = assigned.groupBy(*by, "truth", "cluster").agg(F.count("*").alias("n"))
    a = cells.groupBy(*by, "truth").agg(F.sum("n").alias("a"))
    b = cells.groupBy(*by, "cluster").agg(F.sum("n").alias("b"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("all"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    ent = lambda c: -F.sum(F.col(c) / F.col("all") * F.log(F.col(c) / F.col("all")))
    sa = a.join(total, by).groupBy(*by).agg(F.sum(two("a")).alias("ca"), ent("a").alias("ha"))
    sb = b.join(total, by).groupBy(*by).agg(F.sum(two("b")).alias("cb"), ent("b").alias("hb"))
    joint = cells.withColumnRenamed("n", "m").join(a, [*by, "truth"]).join(b, [*by, "cluster"]).join(total, by)
    mi = F.sum(F.col("m") / F.col("all") * F.log(F.col("m").cast("double") * F.col("all") / (F.col("a") * F.col("b"))))
    sj = joint.groupBy(*by).agg(F.sum(two("m")).alias("cj"), mi.alias("mi"), F.max("all").alias("all"))
    s = sj.join(sa, by).join(sb, by)
    expected = F.col("ca") * F.col("cb") / F.greatest(F.col("all") * (F.col("all") - 1) / 2.0, F.lit(1.0))
    top = (F.col("ca") + F.col("cb")) / 2.0 - expected
    ari = F.when(F.abs(top) < 1e-12, 1.0).otherwise((F.col("cj") - expected) / F.when(F.abs(top) < 1e-12, 1.0).otherwise(top))
    h = F.when(F.col("ha") > 0, F.col("mi") / F.when(F.col("ha") > 0, F.col("ha")).otherwise(1.0)).otherwise(1.0)
    c = F.when(F.col("hb") > 0, F.col("mi") / F.when(F.col("hb") > 0, F.col("hb")).otherwise(1.0)).otherwise(1.0)
    s = s.withColumn("h", h).withColumn("c", c)
    v = F.when(F.col("h") + F.col("c") > 0, F.col("h") * F.col("c") * 2 / F.when(F.col("h") + F.col("c") > 0, F.col("h") + F.col("c")).otherwise(1.0)).otherwise(0.0)
    return s.select(*by, ari.alias("ari"), F.col("h").alias("homogeneity"), F.col("c").alias("completeness"), v.alias("v_measure"))


def folds(rows: DataFrame, k: int, label: str | None, key: str, seed: str = "42") -> DataFrame:
    """A fold for each row, dealt in a seeded hash order within its class."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    lead = F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / 4294967296.0
    own = numbered(rows, [label] if label else [], lead, [order, F.col(key)])
    return own.withColumn("fold", F.pmod(F.col("_r") - 1, F.lit(k)).cast("long")).drop("_r", "_n")


def regression(pairs: DataFrame, row: str, top: int = 50) -> DataFrame:
    """For each row of (row, place, truth, predicted): correlation (0 where none),
    MSE, and the same over the ``top`` places with the largest change."""
    w = Window.partitionBy(row).orderBy(F.desc(F.abs("truth")), "place")
    r = pairs.withColumn("r", F.row_number().over(w))
    square = (F.col("truth") - F.col("predicted")) * (F.col("truth") - F.col("predicted"))
    near = F.col("r") <= top
    corr = lambda c: F.coalesce(F.nanvl(F.corr(F.when(c, F.col("truth")), F.when(c, F.col("predicted"))), F.lit(0.0)), F.lit(0.0))
    return r.groupBy(row).agg(corr(F.lit(True)).alias("corr"), F.avg(square).alias("mse"), corr(near).alias("de_corr"), F.avg(F.when(near, square)).alias("de_mse"))


def regression_summary(per_row: DataFrame) -> DataFrame:
    return per_row.agg(F.avg("corr").alias("delta_correlation"), F.avg("mse").alias("mse"), F.sqrt(F.avg("mse")).alias("rmse"), F.avg("de_corr").alias("de_correlation"), F.avg("de_mse").alias("de_mse"), F.stddev_pop("corr").alias("delta_correlation_std"))


def centroid_geometry(points: DataFrame, label: str, emb: str) -> DataFrame:
    """label, n, within: mean distance of a class's points to its centroid, and
    the squared sums of the variance ratio.  points: id, label, emb."""
    long = points.select("id", label, F.posexplode(emb).alias("dim", "x"))
    cent = long.groupBy(label, "dim").agg(F.avg("x").alias("c"))
    d = long.join(cent, [label, "dim"]).groupBy("id", label).agg(F.sum((F.col("x") - F.col("c")) * (F.col("x") - F.col("c"))).alias("d2"))
    return d.groupBy(label).agg(F.count("*").alias("n"), F.avg(F.sqrt("d2")).alias("within"), F.sum("d2").alias("ssw"))


def calinski_harabasz(points: DataFrame, label: str, emb: str) -> DataFrame:
    """Between- to within-class variance, each by its degrees of freedom."""
    geo = centroid_geometry(points, label, emb).agg(F.sum("ssw").alias("w"), F.count("*").alias("k"), F.sum("n").alias("n"))
    long = points.select(F.posexplode(emb).alias("dim", "x"))
    t = long.groupBy("dim").agg((F.var_pop("x") * F.count("*")).alias("t")).agg(F.sum("t").alias("t"))
    both = geo.crossJoin(t)  # one row each
    return both.select(((F.col("t") - F.col("w")) / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))


def ridge(points: DataFrame, features: str, target: str, alpha: float = 1.0):
    """Weights and intercept of a ridge regression, of any width.

    Each partition adds up its Gram matrix, a row a key; these are summed in a
    tree (``partials``), and the driver solves width x width equations."""

    from graphloom.operators.partials import collected, tree_sum, vectors

    def kernel(batches):
        g = s = None
        for b in batches:
            if not b.num_rows:
                continue
            x, y = vectors(b, "x"), b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            z = np.concatenate([x, y[:, None], np.ones((len(x), 1))], axis=1)
            g, s = (z.T @ z, len(x)) if g is None else (g + z.T @ z, s + len(x))
        if g is not None:
            for k, row in enumerate(g):
                yield k, s, row

    rows = points.where(F.col(target).isNotNull()).select(F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"))
    got = collected(tree_sum(rows, kernel))
    if not got:
        return np.zeros(0), 0.0
    g = np.stack([got[k][1] for k in range(len(got))])
    m, sx, sy = g[-1, -1], g[-1, :-2], g[-1, -2]
    inner = g[:-2, :-2] - np.outer(sx, sx) / m + alpha * np.eye(len(sx))
    right = g[:-2, -2] - sx * sy / m
    try:
        low = np.linalg.cholesky(inner)
        w = np.linalg.solve(low.T, np.linalg.solve(low, right))
    except np.linalg.LinAlgError:  # without a penalty, features may hang together
        w = np.linalg.lstsq(inner, right, rcond=None)[0]
    return w, float(sy / m - sx @ w / m)


#: Rows of a task that fits a forest or a regression.
FIT_ROWS = 4096


def cross_validated(points: DataFrame, k: int = 5, seed: str = "42", trees: int = 100, depth: int = 30):
    """Fold metrics of a balanced logistic regression and a random forest.

    points: id, label (0/1), emb.  Returns rows of model, fold, auc, ap."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from graphloom.operators import forest
    from graphloom.sources.graph_store import written

    n = points.groupBy("label").agg(F.count("*").alias("_c"))
    total = F.sum("_c").over(Window.partitionBy())
    weights = n.select("label", (total / (F.lit(2) * F.col("_c"))).alias("weight"))
    data = folds(points, k, "label", "id", seed).join(F.broadcast(weights), "label").select("id", F.col("label").cast("double").alias("y"), "fold", "weight", "emb")
    # every fold reads the rows again: from a written table, not from executors' memory
    size = max(1, points.count())
    data = data.repartition(-(-size // FIT_ROWS), "id").sortWithinPartitions("id")
    data = written(data, "folds").withColumn("features", array_to_vector("emb"))
    out, on_executors = None, forest.fits(data, "emb")
    # rows keep the node they have reached in each tree: without that, every level ships the
    # trees so far to all tasks and sends each row through them again
    models = {"logistic": LogisticRegression(labelCol="y", weightCol="weight", maxIter=1000, regParam=1.0 / size, standardization=False), "forest": RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=trees, seed=42, maxDepth=depth, cacheNodeIds=True)}
    if on_executors:  # the same settings, by trees that the driver never sees
        own = models.pop("forest")
        s = forest.held_out(data.select("id", "fold", "y", "weight", F.col("emb").alias("x")), list(range(k)), own.getNumTrees(), own.getMaxDepth(), own.getSeed(), lambda width: math.ceil(math.sqrt(width)))
        out = written(s.select(F.lit("forest").alias("model"), F.col("fold").cast("long").alias("fold"), F.round("predicted", 9).alias("score"), "y"), "scored")
    for f in range(k):
        for name, model in models.items():
            test = model.fit(data.where(F.col("fold") != f)).transform(data.where(F.col("fold") == f))
            s = test.select(F.lit(name).alias("model"), F.lit(f).cast("long").alias("fold"), F.round(vector_to_array("probability")[1], 9).alias("score"), "y")
            s = written(s, "scored")  # so that one fold's model is held at a time
            out = s if out is None else out.unionByName(s)
    return areas(out, ["model", "fold"])


#: Points of a block: a cell holds two, and distances of a slice of one to the other.
SILHOUETTE_BLOCK, SILHOUETTE_SLICE = 16384, 128


def silhouette(points: DataFrame, label: str, emb: str) -> DataFrame:
    """Mean Euclidean silhouette of all points, exactly.

    Points are dealt to blocks; each pair of blocks is one task's bounded
    distances, taken once for both, of which only sums by point and class leave
    the task, so no pair of points is ever a row.  The work is quadratic, as the
    measure is; a point travels once for each block."""
    n = points.count()
    # small sets in blocks enough for their tasks
    blocks = max(1, -(-n // SILHOUETTE_BLOCK), min(12, -(-n // 1024)))
    own = points.select("id", F.col(label).cast("string").alias("label"), F.col(emb).alias("emb"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("home"))
    left = own.select("id", "label", "emb", F.col("home").alias("i"), F.explode(F.sequence(F.col("home"), F.lit(blocks - 1))).alias("j"))
    right = own.where("home > 0").select("id", "label", "emb", F.explode(F.sequence(F.lit(0), F.col("home") - 1)).alias("i"), F.col("home").alias("j"))
    kind = pa.schema([("id", pa.string()), ("label", pa.string()), ("to", pa.string()), ("s", pa.float64()), ("n", pa.int64())])

    def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Euclidean distances of all rows of x to all of y, by one product of matrices;
        those that it would blur, of close rows, by their differences."""
        a, b = (x * x).sum(axis=1)[:, None], (y * y).sum(axis=1)[None]
        d = np.maximum(a + b - 2 * (x @ y.T), 0.0)
        close = d < 1e-6 * (a + b)
        for k in np.flatnonzero(close.any(axis=1)):
            at = np.flatnonzero(close[k])
            d[k, at] = ((y[at] - x[k]) ** 2).sum(axis=1)
        return np.sqrt(d)

    def by_class(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, labels and vectors in the order of labels, and where each label begins."""
        names = np.array(t.column("label").to_pylist())
        order = np.argsort(names, kind="stable")
        flat = t.column("emb").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return np.array(t.column("id").to_pylist())[order], names[order], flat.reshape(len(t), -1)[order], np.unique(names[order], return_index=True)[1]

    def sums(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not (len(y) or x.column("i")[0].as_py() == x.column("j")[0].as_py()):
            return kind.empty_table()
        same = not len(y)
        xs, out = by_class(x), []
        ys = xs if same else by_class(y)
        center = ys[2].mean(axis=0)
        p, q = xs[2] - center, ys[2] - center
        back = np.zeros((len(xs[3]), len(q)))
        for lo in range(0, len(p), SILHOUETTE_SLICE):
            d = distances(p[lo : lo + SILHOUETTE_SLICE], q)
            if same:
                d[np.arange(len(d)), lo + np.arange(len(d))] = 0.0
            else:
                place = np.searchsorted(xs[3], lo + np.arange(len(d)), side="right") - 1
                first = np.flatnonzero(np.diff(place, prepend=-1))
                back[place[first]] += np.add.reduceat(d, first, axis=0)
            out.append(np.add.reduceat(d, ys[3], axis=1))
        ends = [(xs, ys, np.concatenate(out))] + ([] if same else [(ys, xs, back.T)])
        tables = []
        for a, b, total in ends:
            to, each = b[1][b[3]], np.diff(np.append(b[3], len(b[1])))
            count = np.broadcast_to(each, total.shape) - (same & (a[1][:, None] == to[None]))
            met = count > 0
            r, c = np.nonzero(met)
            tables.append(pa.Table.from_arrays([pa.array(a[0][r], pa.string()), pa.array(a[1][r], pa.string()), pa.array(to[c], pa.string()), pa.array(total[met]), pa.array(count[met].astype(np.int64))], schema=kind))
        return pa.concat_tables(tables)

    parts = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(sums, "id string, label string, to string, s double, n long")
    mean = parts.groupBy("id", "label", "to").agg((F.sum("s") / F.sum("n")).alias("m"))
    ab = mean.groupBy("id", "label").agg(F.max(F.when(F.col("to") == F.col("label"), F.col("m"))).alias("a"), F.min(F.when(F.col("to") != F.col("label"), F.col("m"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-12)))
    return ab.agg(F.avg(s).alias("silhouette"))


def davies_bouldin(points: DataFrame, label: str, emb: str) -> DataFrame:
    """Mean over classes of the worst ratio of spreads to centroid distance."""
    from graphloom.operators.scoring import dot

    geo = centroid_geometry(points, label, emb)
    long = points.select(label, F.posexplode(emb).alias("dim", "x")).groupBy(label, "dim").agg(F.avg("x").alias("c"))
    cent = long.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "c"))), lambda x: x["c"]).alias("v")).join(geo, label)
    a, b = cent.select(F.col(label).alias("i"), F.col("v").alias("vi"), F.col("within").alias("si")), cent.select(F.col(label).alias("j"), F.col("v").alias("vj"), F.col("within").alias("sj"))
    gap = F.zip_with("vi", "vj", lambda x, y: x - y)
    r = a.join(b, F.col("i") != F.col("j")).select("i", ((F.col("si") + F.col("sj")) / F.sqrt(dot(gap, gap))).alias("r"))
    return r.groupBy("i").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def knn_regression(neighbors: DataFrame, targets: DataFrame) -> DataFrame:
    """query_id, predicted: means of the neighbours' targets weighed by inverse
    distance; a neighbour at distance 0 decides alone.

    neighbors: query_id, id, distance; targets: id, y."""
    w = Window.partitionBy("query_id")
    n = neighbors.join(targets, "id").withColumn("zero", F.max((F.col("distance") == 0).cast("int")).over(w))
    weight = F.when(F.col("zero") == 1, (F.col("distance") == 0).cast("double")).otherwise(1.0 / F.when(F.col("distance") == 0, 1.0).otherwise(F.col("distance")))
    return n.withColumn("w", weight).groupBy("query_id").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("predicted"))
