"""Fitted operators against numpy, and sampling and ranking against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import clustering as C
from graphloom.operators import evaluation as E
from graphloom.operators import network, partials
from graphloom.operators import retrieval as V
from graphloom.operators import sampling as S
from graphloom.operators import tasks as T


def points(spark, n=240, dim=3, seed=1, parts=3):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.4, (n // 4, dim)) for c in (0, 4, 8, 12)])
    df = spark.createDataFrame([(f"p{k:03}", [float(v) for v in r], k // (n // 4)) for k, r in enumerate(x)], "id string, emb array<double>, label long")
    return x, df.repartition(parts, "id")


def numpy_lloyd(x, c, tol=1e-4, most=300):
    spread = x.var(axis=0).mean()
    for _ in range(most):
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[own == k].mean(0) if (own == k).any() else c[k] for k in range(len(c))])
        shift, c = ((new - c) ** 2).sum(), new
        if shift <= tol * spread:
            break
    return c, ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()


def test_kmeans_equals_numpy_from_equal_seeds(spark):
    x, df = points(spark)
    starts = C.seeded(df, 4, 5, 42)
    assert len(starts) == 5 and all(s.shape == (4, 3) for s in starts)
    found = C.lloyd(df, starts)
    want = [numpy_lloyd(x, s) for s in starts]
    assert found.inertias == pytest.approx([w[1] for w in want])
    best = int(np.argmin([w[1] for w in want]))
    assert np.allclose(found.centres, want[best][0]) and found.inertia == pytest.approx(want[best][1])


def test_kmeans_finds_clusters_and_reruns_agree(spark):
    _, df = points(spark)
    rows, found = C.kmeans(df, 4)
    got = {(r.label, r.cluster) for r in rows.collect()}
    assert len(got) == 4 and len({c for _, c in got}) == 4 and len(found.inertias) == 10
    again, _ = C.kmeans(df, 4)
    key = lambda d: {r.id: r.cluster for r in d.collect()}
    assert key(rows) == key(again)
    assert E.clustering(rows.select(F.lit(1).alias("g"), F.col("label").alias("truth"), "cluster"), ["g"]).first().ari == pytest.approx(1.0)


def test_kmeans_of_odd_rows(spark):
    same = spark.createDataFrame([(f"a{k}", [1.0, 1.0]) for k in range(9)] + [("n", None), ("s", [1.0]), (None, [1.0, 1.0])], "id string, emb array<double>")
    rows, found = C.kmeans(same, 3, restarts=2)
    assert rows.count() == 10 and found.inertia == 0 and {r.cluster for r in rows.collect()} == {0}
    none, nothing = C.kmeans(same.where("false"), 3)
    assert none.count() == 0 and nothing is None and "cluster" in none.columns


@pytest.mark.parametrize(("fan", "few"), [(4, 2), (64, 2), (64, 30)])
def test_tree_sum_in_two_steps(spark, monkeypatch, fan, few):
    monkeypatch.setattr(partials, "FAN", fan)
    monkeypatch.setattr(partials, "FEW", few)
    df = spark.range(0, 1000, 1, 11).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("emb"))

    def kernel(batches):
        total = sum((partials.vectors(b, "emb").sum(0) for b in batches), np.zeros(2))
        yield 7, int(total[1]), total

    assert {k: (n, v.tolist()) for k, (n, v) in partials.collected(partials.tree_sum(df, kernel)).items()} == {7: (1000, [499500.0, 1000.0])}


@pytest.mark.parametrize("ties", [False, True])
def test_all_genes_as_queries(spark, monkeypatch, ties):
    monkeypatch.setattr(V, "QUERY_BLOCK", 37)
    monkeypatch.setattr(V, "INDEX_BLOCK", 11)
    monkeypatch.setattr(V, "MERGE", 3)
    monkeypatch.setattr(V, "PRODUCTS", 50)
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (150, 4)).astype(float)
    index = spark.createDataFrame([(f"i{k:03}", [float(v) for v in r], k % 3) for k, r in enumerate(x)] + [("none", None, 0), ("short", [1.0], 0)], "id string, emb array<double>, kind long")
    asked = index.select(F.col("id").alias("query_id"), F.col("emb").alias("q_emb"))
    got = {}
    for r in V.top_k(asked, index, 6, ties).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score, r.kind))
    assert set(got) == {f"i{k:03}" for k in range(150)} | {"short"}
    for k in range(150):
        order = sorted(((-float(x[k] @ y), f"i{j:03}") for j, y in enumerate(x)))
        best = [p for p in order if p[0] <= order[5][0]] if ties else order[:6]
        assert sorted(g[1] for g in got[f"i{k:03}"]) == sorted(i for _, i in best)
        if not ties:
            assert [(p, -s) for p, _, s, _ in sorted(got[f"i{k:03}"])] == [(n + 1, s) for n, (s, _) in enumerate(best)]


def test_rows_that_share_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (20, 3)).astype(float)
    vectors = spark.createDataFrame([(f"v{k}", [float(v) for v in r]) for k, r in enumerate(x)], "key string, emb array<double>")
    rows = [(f"e{k:02}", f"v{k * 7 % 15}") for k in range(60)]
    table = spark.createDataFrame(rows, "id string, key string")
    queries = vectors.select(F.col("key").alias("query_id"), F.col("emb").alias("q_emb"))
    got = {}
    for r in V.top_k_of(queries, vectors, table, 7).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for k in range(20):
        assert got[f"v{k}"] == [i for _, i in sorted((-float(x[k] @ x[int(v[1:])]), i) for i, v in rows)][:7]


def test_ridge_of_many_features(spark):
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=(300, 90)), rng.normal(size=90)
    y = x @ w + 2
    df = spark.createDataFrame([([float(v) for v in r], float(t)) for r, t in zip(x, y, strict=True)], "x array<double>, y double").repartition(5)
    got, b = E.ridge(df, "x", "y", 1.0)
    c = x - x.mean(0)
    want = np.linalg.solve(c.T @ c + np.eye(90), c.T @ (y - y.mean()))
    assert np.allclose(got, want) and b == pytest.approx(y.mean() - x.mean(0) @ want)
    assert E.ridge(df.where("false"), "x", "y")[0].tolist() == []
    twice = df.select(F.concat("x", "x").alias("x"), "y")
    assert E.ridge(twice, "x", "y", 0.0)[0].shape == (180,)


def test_network_on_one_partition_is_plain_adam(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 3))
    y = np.sin(x[:, 0]) + x[:, 1] ** 2
    df = spark.createDataFrame([(k, [float(v) for v in r], float(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double").coalesce(1)
    net = network.fit(df, hidden=16, rounds=6)
    order = [r.id for r in df.select("id", F.xxhash64(F.col("id"), F.lit(42)).alias("h")).orderBy("h").collect()]
    z, t = (x[order] - x.mean(0)) / (np.sqrt((x * x).mean(0) - x.mean(0) ** 2) + 1e-9), y[order]
    state, steps, losses = network.start(3, 16, t.mean(), 42), 0, []
    for _ in range(6):
        state, n, steps, loss = network.trained(state, steps, [(z, t)], 16)
        losses.append(loss / n)
    assert np.allclose(net.weights, state[: len(state) // 3], atol=1e-8) and net.losses == pytest.approx(losses) and losses[-1] < losses[0] / 2
    many = network.fit(df.repartition(4, "id"), hidden=16, rounds=30)
    assert many.losses[-1] < 0.1 * many.losses[0]


def test_network_gradient(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(7, 3)), rng.normal(size=7)
    p = rng.normal(size=3 * 5 + 5 + 5 + 1)
    g, _ = network.gradient(p, x, y, 5)
    for k in range(len(p)):
        e = np.zeros(len(p))
        e[k] = 1e-6
        assert g[k] == pytest.approx((network.gradient(p + e, x, y, 5)[1] - network.gradient(p - e, x, y, 5)[1]) / 2e-6, abs=1e-5)


def test_permutation_and_pairs(spark):
    got = [r[0] for r in spark.range(256).select(S.permuted(F.col("id"), 4, "7")).collect()]
    assert sorted(got) == list(range(256)) and got != list(range(256))
    i, j = S.pair_of(F.col("id"))
    assert [tuple(r) for r in spark.range(45).select(i, j).collect()] == [(a, b) for a in range(10) for b in range(a)]
    far = (1 << 61) - 5
    r = spark.range(far, far + 3).select("id", i.alias("i"), j.alias("j")).collect()
    assert all(0 <= x.j < x.i and x.i * (x.i - 1) // 2 + x.j == x.id for x in r)


@pytest.mark.parametrize(("ratio", "dense"), [(1.0, False), (2.5, False), (1.0, True), (0.0, False)])
def test_negative_pairs(spark, ratio, dense):
    names, rng = [f"g{k}" for k in range(30)], random.Random(1)
    all_pairs = list(itertools.combinations(sorted(names), 2))
    positive = set(rng.sample(all_pairs, 400 if dense else 60))
    genes = spark.createDataFrame([(n,) for n in [*names, "g1", None]], "gene string")
    given = [(b, a) if k % 2 else (a, b) for k, (a, b) in enumerate(sorted(positive))] + [("g1", "g1"), ("g1", "unknown"), (None, "g2")]
    pos = spark.createDataFrame(given + given[:5], "g1 string, g2 string")
    rows = S.negative_pairs(genes, pos, ratio).collect()
    got = [(r.g1, r.g2) for r in rows]
    want = min(math.floor(len(positive) * ratio), 435 - len(positive))
    assert len(got) == len(set(got)) == want and not set(got) & positive and set(got) <= set(all_pairs)
    again = S.negative_pairs(genes.repartition(3), pos, ratio).collect()
    assert sorted(rows) == sorted(again)
    if 0 < want < 435 - len(positive):
        other = {(r.g1, r.g2) for r in S.negative_pairs(genes, pos, ratio, "43").collect()}
        assert other != set(got)


def test_negative_pairs_of_nothing(spark):
    one = spark.createDataFrame([("a",)], "gene string")
    pos = spark.createDataFrame([("a", "b")], "g1 string, g2 string")
    assert S.negative_pairs(one, pos).count() == 0 and S.negative_pairs(one.where("false"), pos).count() == 0


def test_numbering_in_parallel(spark):
    rows = [(k, k % 3 if k % 7 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, g long")
    got = S.numbered(df, ["g"], (F.col("id") * 0.37) % 1.0, ["id"]).collect()
    for g in (0, 1, 2, None):
        own = sorted((r for r in got if r.g == g), key=lambda r: ((r.id * 0.37) % 1.0, r.id))
        assert [r._r for r in own] == list(range(1, len(own) + 1)) and {r._n for r in own} == {len(own)}


def test_areas_over_continuous_scores(spark):
    rng = random.Random(2)
    rows = [(g, round(rng.random(), 2 if g else 6), int(rng.random() < 0.3)) for g in (0, 1) for _ in range(400)] + [(2, 0.5, 1)]
    df = spark.createDataFrame(rows, "g long, score double, y long").repartition(4)
    got = {r.g: r for r in E.areas(df, ["g"]).collect()}
    for g in (0, 1):
        own = [(s, y) for h, s, y in rows if h == g]
        pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert got[g].auc == pytest.approx(want)
        ap = sum(sum(y for s, y in own if s == t) / len(pos) * sum(y for s, y in own if s >= t) / sum(1 for s, _ in own if s >= t) for t in {s for s, _ in own})
        assert got[g].ap == pytest.approx(ap)
    assert got[2].auc == 0.5


def test_one_vs_rest(spark):
    truth, scores = [0, 1, 2, 0], [[0.9, 0.05, 0.05], [0.2, 0.5, 0.3], [0.4, 0.3, 0.3], [0.3, 0.4, 0.3]]
    rows = [(1, t, c, s[c]) for t, s in zip(truth, scores, strict=True) for c in range(3)]
    got = E.one_vs_rest(spark.createDataFrame(rows, "g long, truth long, class long, score double"), ["g"]).first().auc
    each = []
    for c in range(3):
        pos, neg = [s[c] for t, s in zip(truth, scores, strict=True) if t == c], [s[c] for t, s in zip(truth, scores, strict=True) if t != c]
        each.append(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)))
    assert got == pytest.approx(sum(each) / 3)
    assert E.one_vs_rest(spark.createDataFrame([(1, 0, 0, 0.3)], "g long, truth long, class long, score double"), ["g"]).first().auc == 0.5


def test_split_has_no_window_over_all_rows(spark):
    df = spark.range(1000).select("id", (F.col("id") % 2).alias("label"))
    for label in (None, "label"):
        assert T.train_test(df, "id", label).where("test").count() == 200


def test_noise_is_seeded_and_normal(spark):
    df = spark.range(4000).select(V.noise(F.col("id"), F.lit(1), "s").alias("x"))
    x = np.array([r.x for r in df.collect()])
    assert abs(x.mean()) < 0.06 and abs(x.std() - 1) < 0.05 and (x == np.array([r.x for r in df.collect()])).all()


def test_logistic_of_all_folds_at_once(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from graphloom.operators import logistic

    rng = np.random.default_rng(7)
    rows = [(g, k % 3, int(rng.random() < 0.3 + 0.4 * (x[0] > 0)), 1.0 + k % 2, [float(v) for v in x]) for g in (0, 1) for k, x in enumerate(rng.normal(size=(90, 4)) + g)]
    df = spark.createDataFrame(rows, "g int, fold long, y int, weight double, emb array<double>").repartition(3)
    w = logistic.fitted(df, 2, 3, 4)
    for g in (0, 1):
        own = df.where((F.col("g") == g) & (F.col("fold") != 1)).withColumn("features", array_to_vector("emb")).withColumn("label", F.col("y").cast("double"))
        total = own.agg(F.sum("weight")).first()[0]
        want = LogisticRegression(weightCol="weight", maxIter=500, tol=1e-12, regParam=1.0 / total, standardization=False).fit(own)
        assert np.allclose(w[g, 1], [*want.coefficients, want.intercept], atol=1e-4)
    got = {(r.g, tuple(r.emb)): r.score for r in logistic.scored(df, w).collect()}
    for g, fold, _, _, x in rows:
        assert got[g, tuple(x)] == pytest.approx(1 / (1 + math.exp(-(np.array([*x, 1.0]) @ w[g, fold]))))
    assert logistic.fitted(df.where("false"), 1, 2, 4).tolist() == np.zeros((1, 2, 5)).tolist()


def test_four_methods_from_graph_to_metric(spark):
    from graphloom.functions import llm_client as L
    from graphloom.operators import experiments as X

    genes = [f"g{k:02}" for k in range(40)]
    # what a gene's label is shows in its pathway alone
    edges = [(g, f"R-HSA-{'up' if k % 2 else 'down'}", "Reactome", None, "TAS") for k, g in enumerate(genes)] + [(g, f"GO:T{k % 5}", "GO", None, "IEA") for k, g in enumerate(genes)]
    e = spark.createDataFrame(edges, "src string, dst string, edge_type string, score double, evidence string")
    nodes = spark.createDataFrame([(g, "gene", g, None) for g in genes] + [(f"R-HSA-{w}", "pathway", w, None) for w in ("up", "down")], "node_id string, node_label string, name string, definition string")
    labels = spark.createDataFrame([(g, k % 2) for k, g in enumerate(genes)], "gene string, label int")
    own = labels.select("gene", F.col("gene").alias("name"), F.lit(None).cast("string").alias("summary"))
    encode = L.encoder(L.HashingEncoder(32))
    prompts = X.method_texts(own, e, nodes, encode, 4).cache()
    text = {(r.method, r.gene): r.prompt for r in prompts.collect()}
    assert len(text) == 160 and "up" in text["full_kg", "g01"] and "up" not in text["rule_rag", "g01"] and text["no_kg", "g01"] == "Describe gene g01.\ng01 "
    rows = {r.method: r for r in X.compared_methods(prompts, labels, lambda ps: ps, encode, folds=4).collect()}
    assert {m: r.genes for m, r in rows.items()} == dict.fromkeys(("no_kg", "full_kg", "rule_rag", "true_rag"), 40)
    assert rows["full_kg"].auc > 0.9 and rows["full_kg"].place == 1 and rows["no_kg"].gain == 0.0 and rows["full_kg"].gain > 0.3 and rows["rule_rag"].auc < 0.7


def test_fold_metrics_of_a_separate_fit(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 60)
    df = spark.createDataFrame([(f"p{k:02}", int(t), [float(v) for v in rng.normal(size=3) + t]) for k, t in enumerate(y)], "id string, label int, emb array<double>")
    got = {r.fold: r for r in E.cross_validated(df, 3, trees=5).where("model = 'logistic'").collect()}
    assert set(got) == {0, 1, 2}
    dealt = E.folds(df, 3, "label", "id")
    assert dealt.groupBy("label", "fold").count().agg((F.max("count") - F.min("count")).alias("d")).first().d <= 11
    n = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    data = dealt.withColumn("features", array_to_vector("emb")).withColumn("y", F.col("label").cast("double")).withColumn("weight", F.when(F.col("label") == 1, 30.0 / n[1]).otherwise(30.0 / n[0]))
    for f in range(3):
        model = LogisticRegression(labelCol="y", weightCol="weight", maxIter=1000, regParam=1 / 60, standardization=False).fit(data.where(F.col("fold") != f))
        rows = [(r.label, round(r.s, 9)) for r in model.transform(data.where(F.col("fold") == f)).select("label", vector_to_array("probability")[1].alias("s")).collect()]
        pos, neg = [s for t, s in rows if t], [s for t, s in rows if not t]
        assert got[f].auc == pytest.approx(sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg)))
        ap = sum(sum(t for t, s in rows if s == c) / len(pos) * sum(t for t, s in rows if s >= c) / sum(1 for _, s in rows if s >= c) for c in {s for _, s in rows})
        assert got[f].ap == pytest.approx(ap)


LOST = """
import numpy as np
from pyspark import TaskContext
from pyspark.sql import SparkSession
from graphloom.operators import network

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
rng = np.random.default_rng(1)
x = rng.normal(size=(200, 2))
df = spark.createDataFrame([(k, [float(v) for v in r], float(r[0] - r[1] ** 2)) for k, r in enumerate(x)], "id long, x array<double>, y double").repartition(2, "id")
whole, lost = network.written, spark.sparkContext.accumulator(0)

def losing(rows, name):
    def run(batches):
        context = TaskContext.get()
        if context.attemptNumber() == 0 and context.partitionId() == 0:
            raise RuntimeError("lost")
        yield from batches
    return whole(rows, name).mapInArrow(run, rows.schema)

calm = network.fit(df, hidden=8, rounds=3)
network.written = losing
assert (network.fit(df, hidden=8, rounds=3).weights == calm.weights).all()
print("SAME WEIGHTS")
"""


def test_network_after_lost_tasks():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", LOST], capture_output=True, text=True, timeout=300)
    assert "SAME WEIGHTS" in done.stdout, done.stderr[-2000:]
