"""Forests that are grown on executors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import evaluation as E
from graphloom.operators import forest
from graphloom.operators import tasks as T


def test_a_tree_takes_the_best_split_and_parts_all_rows():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 8, (300, 3)).astype(np.uint8)
    y, w = rng.normal(size=300) + (x[:, 1] > 4), rng.integers(1, 4, 300).astype(float)
    feature, cut, left, value = forest.grown(x, y, w, 3, 1, np.random.default_rng(0))

    def miss(f, b):
        out = 0.0
        for side in (x[:, f] <= b, x[:, f] > b):
            out += (w[side] * (y[side] - np.average(y[side], weights=w[side])) ** 2).sum() if side.any() else 0.0
        return out

    best = min(((f, b) for f in range(3) for b in range(7)), key=lambda p: miss(*p))
    assert (feature[0], cut[0]) == best and list(feature[1:]) == [-1, -1] and left[0] == 1
    assert value[1] == pytest.approx(np.average(y[x[:, best[0]] <= best[1]], weights=w[x[:, best[0]] <= best[1]]))
    deep = forest.grown(x, y, w, 2, 30, np.random.default_rng(0))
    means = {}  # a full tree: rows alike in all bins share a leaf, others of one target's leaf don't differ
    for k in range(300):
        means.setdefault(tuple(x[k]), []).append((y[k], w[k]))
    got = forest.reached(deep, x)
    whole = np.array([np.average([a for a, _ in means[tuple(r)]], weights=[b for _, b in means[tuple(r)]]) for r in x])
    assert np.corrcoef(got, whole)[0, 1] > 0.95


def test_rows_are_drawn_by_a_poisson_law():
    n = forest.draws(np.random.default_rng(1).integers(-(2**62), 2**62, 200_000), 42, 3, 1)
    assert np.bincount(n)[:4] / 200_000 == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.005)


def _points(spark, n=600):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 6))
    y = x[:, 0] * 2 + np.abs(x[:, 1]) * 3
    return spark.createDataFrame([(f"p{k}", x[k].tolist(), float(y[k])) for k in range(n)], "id string, x array<double>, y double"), y


def test_trees_never_pass_the_driver_and_do_as_well_as_spark_s(spark, monkeypatch):
    df, y = _points(spark)
    test = F.substring("id", 2, 9).cast("int") % 3 == 0
    run = lambda: {r.id: r.predicted for r in T.forest_regression(df.where(~test), df.where(test).select("id", "x"), trees=40).collect()}
    from pyspark.ml.regression import RandomForestRegressor

    theirs_of, fit = None, RandomForestRegressor.fit
    monkeypatch.setattr(forest, "TASK_BYTES", 0)
    theirs_of = run()
    monkeypatch.setattr(forest, "TASK_BYTES", 1 << 28)

    def refused(*a):
        raise AssertionError("the driver was to hold a forest")

    monkeypatch.setattr(RandomForestRegressor, "fit", refused)
    got = run()
    monkeypatch.setattr(RandomForestRegressor, "fit", fit)
    assert set(got) == set(theirs_of) and len(got) == 200
    miss = lambda p: np.mean([(v - y[int(k[1:])]) ** 2 for k, v in p.items()])
    assert miss(got) < 1.25 * miss(theirs_of) and miss(got) < 0.35 * y.var()


def test_groups_of_trees_change_nothing(spark):
    df, _ = _points(spark, 90)
    rows = df.select("id", (F.xxhash64("id") % 3 + 3).alias("fold"), F.col("y"), F.lit(1.0).alias("weight"), "x")
    rows = rows.withColumn("fold", F.pmod("fold", F.lit(3)))
    run = lambda d: sorted(tuple(r) for r in forest.held_out(d, [0, 1, 2], 18, 5, 42, lambda w: 2).select("id", "predicted").collect())
    a, b = run(rows), run(rows.repartition(7))
    assert len(a) == 90 and [x[0] for x in a] == [x[0] for x in b] and [x[1] for x in a] == pytest.approx([x[1] for x in b], abs=1e-12)


def test_folds_of_a_forest_tell_classes_apart(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 200)
    df = spark.createDataFrame([(f"p{k}", int(t), [float(v) for v in rng.normal(size=4) + [2 * t, 0, 0, 0]]) for k, t in enumerate(y)], "id string, label int, emb array<double>")
    got = [r for r in E.cross_validated(df, 3, trees=10).collect() if r.model == "forest"]
    assert sorted(r.fold for r in got) == [0, 1, 2] and all(r.auc > 0.75 for r in got), got
