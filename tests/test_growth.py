"""Plans whose work must not grow faster than their tables."""

import re

from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import scoring as C


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_hub_is_ranked_once_not_for_each_centre(spark):
    e = spark.createDataFrame([(f"g{i}", "hub", "PPI", i / 100, None) for i in range(40)], "src string, dst string, edge_type string, score double, evidence string")
    out = G.expand(e, e.select(F.col("src").alias("center")), 2, 5)
    assert not re.search(r"windowspecdefinition\(center#\d+, node#\d+", plan(out))
    got = out.where("center = 'g0' AND hop = 2").select("node").orderBy("node").collect()
    assert [r.node for r in got] == [f"g{i}" for i in range(30, 40)]


def test_texts_to_encode_are_dealt_by_number(spark, monkeypatch):
    from graphloom.operators import experiments as X

    monkeypatch.setattr(X, "CALL_ROWS", 10)
    own = X.spread(spark.range(95).selectExpr("id", "'t' AS text"), "id")
    assert own.rdd.getNumPartitions() == 10 and own.count() == 95


def test_vectors_travel_as_stored(spark):
    from graphloom.plans.queries import QUERIES
    from graphloom.plans import catalogue  # noqa: F401

    lines = plan(QUERIES["j6_pair_features"](spark, "/root/testdata/sf0.001")).splitlines()
    join = next(k for k, line in enumerate(lines) if "Join" in line)
    assert not any("transform(" in line for line in lines[join:])


def test_a_source_s_edges_past_its_best_are_not_ranked_again(spark):
    rows = [("a", f"n{i}", "PPI", 1 - i / 100, None, i + 1) for i in range(9)] + [("a", f"n{i}", "TRRUST", None, None, i + 1) for i in range(9)] + [("a", "t", "GO", None, None, None)]
    e = spark.createDataFrame(rows, "src string, dst string, edge_type string, score double, evidence string, place int")
    got = {(r.center, r.neighbor, r.edge_type) for r in G.incident(e, best=5).collect()}
    out = {("a", f"n{i}", t) for i in range(5) for t in ("PPI", "TRRUST")} | {("a", "t", "GO")}
    assert got == out | {(f"n{i}", "a", "PPI") for i in range(9)}
    near = lambda df: sorted(map(tuple, G.typed_neighbors(df, 5).collect()), key=repr)
    assert near(e) == near(e.drop("place"))


def test_places_are_ranks_among_a_source_s_edges(spark):
    from graphloom.plans import projection as P

    for t in ("PPI", "TRRUST"):
        e = P.edges(spark, "/root/testdata/sf0.001", (t,), places=True)
        w = F.row_number().over(G.Window.partitionBy("src").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "dst"))
        assert e.count() and e.withColumn("r", w).where("place IS NULL OR place <> r").count() == 0


def test_rows_of_a_hub_are_dealt_over_tasks(spark):
    rows = spark.createDataFrame([(f"c{i}", "hub") for i in range(400)] + [("c1", "x"), ("c2", None), ("c3", "lost")], "center string, neighbor string")
    facts = spark.createDataFrame([("hub", 7), ("x", 8), ("y", 9)], "neighbor string, v int")
    counts = rows.groupBy("neighbor").agg(F.count("*").alias("n"))
    out = G.looked_up(rows, facts, "neighbor", "center", counts)
    assert out.where("neighbor = 'hub'").select(F.spark_partition_id()).distinct().count() > 1
    want = rows.join(facts, "neighbor", "left").select("center", "neighbor", "v")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_nothing_is_sorted_below_the_shuffle_of_neighbourhoods(spark):
    from graphloom.plans import projection as P

    near = G.typed_neighbors(P.edges(spark, "/root/testdata/sf0.001"), 10)
    text = near._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in text[text.index("Exchange") :]


def test_silhouette_in_blocks_equals_all_pairs(spark, monkeypatch):
    import numpy as np

    from graphloom.operators import evaluation as E

    monkeypatch.setattr(E, "SILHOUETTE_BLOCK", 40)
    monkeypatch.setattr(E, "SILHOUETTE_SLICE", 7)
    rng = np.random.default_rng(3)
    x, label = rng.normal(0, 1, (150, 3)) + 1000, rng.integers(0, 3, 150)
    x[10:30] = x[10]  # copies
    label[0] = 9  # a class of one
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    of = lambda k, c: d[k, (label == c) & (np.arange(150) != k)]
    s = []
    for k in range(150):
        a, b = of(k, label[k]), min(of(k, c).mean() for c in set(label) - {label[k]})
        s.append((b - a.mean()) / max(a.mean(), b) if len(a) else 0.0)
    df = spark.createDataFrame([(f"P{k}", int(label[k]), x[k].tolist()) for k in range(150)], "id string, label int, emb array<double>")
    got = E.silhouette(df, "label", "emb")
    assert abs(got.first().silhouette - np.mean(s)) < 1e-9


def test_tasks_have_a_bound_whatever_the_shuffle_partitions(spark, monkeypatch):
    from graphloom.sources import graph_store as S

    monkeypatch.setattr(S, "TASK_ROWS", 5)
    monkeypatch.setattr(S, "MOST_ROWS", 10)
    assert S.dealt(spark.range(95), 95, "id").rdd.getNumPartitions() == 10
    assert S.dealt(spark.range(8), 8, "id").rdd.getNumPartitions() <= 4 and S.dealt(spark.range(95), None, "id").rdd.getNumPartitions() == 4


def test_cells_are_placed_among_a_source_s_edges(spark):
    from graphloom.plans import projection as P

    e = P.edges(spark, "/root/testdata/sf0.001", ("CellMarker",), places=True)
    w = F.row_number().over(G.Window.partitionBy("src").orderBy("dst"))
    assert e.count() and e.withColumn("r", w).where("place IS NULL OR place <> r").count() == 0


def test_scores_tell_of_all_edges(spark):
    rows = [("c", "n", "PPI", "in"), ("c", "n", "PPI", "out"), ("c", "n", "TRRUST", "out"), ("c", "m", "GO", "out"), ("d", "n", "PPI", "in")]
    near = spark.createDataFrame(rows, "center string, neighbor string, edge_type string, direction string")
    deg = spark.createDataFrame([("n", 3)], "node string, degree long")
    nodes = spark.createDataFrame([("n", "gene")], "node_id string, node_label string")
    emb = spark.createDataFrame([], "id string, emb array<double>")
    s = C.score_neighbors(near, deg, nodes, None, emb, None)
    assert sorted(tuple(r) for r in s.select("center", "neighbor", "edge_type", "direction").collect()) == [("c", "m", "GO", "out"), ("c", "n", "TRRUST", "out"), ("d", "n", "PPI", "in")]
    assert sorted(map(tuple, C.edges_of(s, tuple(C.IMPORTANCE)).collect())) == sorted(rows)


def test_selected_subgraphs_read_scores_alone(spark):
    from graphloom.plans import catalogue

    text = plan(catalogue.QUERIES["g6_selected_subgraph"](spark, "/root/testdata/sf0.001"))
    assert "Join" not in text and text.count("Relation") == 1


def test_draws_are_hashed_once_and_equal_the_fold(spark):
    from graphloom.operators import sampling as Sa

    t = Sa.drawn(5, 200, 4, "42", spark).where("x < 100")
    assert plan(t).count("md5(") == Sa.FEISTEL
    fold = spark.range(5, 200).select(F.col("id").alias("draw"), Sa.permuted(F.col("id"), 4, "42").alias("x")).where("x < 100")
    assert sorted(map(tuple, t.collect())) == sorted(map(tuple, fold.collect()))


def test_the_nth_least_is_found_by_counts(spark):
    from graphloom.operators import sampling as Sa

    rows = spark.createDataFrame([(x,) for x in range(7, 5_000_000, 49_999)], "x long")
    assert [Sa.nth_least(rows, "x", n, 5_000_000) for n in (1, 2, 57, 100)] == [7, 50_006, 7 + 56 * 49_999, 7 + 99 * 49_999]


def test_negative_pairs_are_numbers_until_the_sample_is_known(spark):
    from graphloom.operators import sampling as Sa

    genes = spark.createDataFrame([(f"g{k}",) for k in range(30)], "gene string")
    known = spark.createDataFrame([("g1", "g2"), ("g2", "g1"), ("g3", "g3"), ("g4", "zz"), ("g5", "g6"), ("g9", "g7")], "g1 string, g2 string")
    out = Sa.negative_pairs(genes, known, 20.0)
    assert "Window" not in plan(out)
    got = {(r.g1, r.g2) for r in out.collect()}
    assert len(got) == out.count() == 60 and not got & {("g1", "g2"), ("g5", "g6"), ("g7", "g9")} and all(a < b for a, b in got)


def test_a_vector_s_length_is_taken_once(spark):
    from graphloom.operators import retrieval as V

    df = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 0.0]), ("c", None)], "id string, emb array<double>")
    out = V.normalised(df)
    assert "/ greatest(aggregate" not in plan(out)
    assert [r.emb for r in out.orderBy("id").collect()] == [[0.6, 0.8], [0.0, 0.0], None]


def test_nearest_rows_equal_those_of_all_products():
    import numpy as np

    from graphloom.operators import retrieval as V

    rng = np.random.default_rng(5)
    for x in (rng.normal(size=(3000, 8)), rng.integers(-2, 3, (3000, 8)).astype(float), 1000 + 1e-9 * rng.normal(size=(700, 8)), np.ones((50, 8)), 1e25 * rng.normal(size=(90, 8))):
        q = np.concatenate([rng.normal(size=(20, 8)), x[:5], np.zeros((1, 8))])
        for k in (1, 7, 49, 5000):
            of, row, score = V.nearest(q, x, x.astype(np.float32), float(np.sqrt((x * x).sum(axis=1).max())), k)
            s = np.round(np.einsum("ij,kj->ik", q, x), 9)
            least = np.sort(s, axis=1)[:, -k][:, None] if k < len(x) else -np.inf
            want = s >= (least - 1e-9 * (1 + abs(least)) if k < len(x) else least)
            assert np.allclose(score, s[of, row], rtol=1e-12, atol=1e-9) and want[of, row].all()
            assert (np.bincount(of, minlength=len(q)) >= min(k, len(x))).all()


def test_large_indexes_come_in_few_cells(spark, monkeypatch):
    from graphloom.operators import retrieval as V

    cells, made = spark.sparkContext.accumulator(0), V._cell

    def counting(*a):
        run = made(*a)

        def counted(left, right):
            cells.add(1)
            return run(left, right)

        return counted

    monkeypatch.setattr(V, "_cell", counting)
    monkeypatch.setattr(V, "LARGEST_BLOCK", 200)
    monkeypatch.setattr(V, "INDEX_BLOCK", 20)
    index = spark.range(1000).selectExpr("concat('i', id) AS id", "array(double(id % 7), double(id % 11)) AS emb")
    queries = spark.createDataFrame([("q", [1.0, 0.5]), ("r", [0.0, 1.0])], "query_id string, q_emb array<double>")
    out = V.top_k(queries, index, 5)
    got = [(r.query_id, r.id) for r in out.orderBy("query_id", "rank").collect()]
    of = lambda a, b: [f"i{k}" for _, _, k in sorted((-(a * (k % 7) + b * (k % 11)), f"i{k}", k) for k in range(1000))[:5]]
    assert got == [("q", i) for i in of(1.0, 0.5)] + [("r", i) for i in of(0.0, 1.0)]
    assert 5 <= cells.value <= 8


def test_sections_come_together_in_one_shuffle(spark):
    from graphloom.operators import rendering as R

    edges = spark.createDataFrame(
        [("a", f"b{k:02}", "PPI", k / 100, "STRING") for k in range(14)] + [("z", "a", "TRRUST", None, "Activation"), ("a", "T:x", "GO", None, "IEA"), ("b01", "T:y", "GO", None, "IEA")],
        "src string, dst string, edge_type string, score double, evidence string",
    )
    nodes = spark.createDataFrame([("T:x", "ex"), ("a", "gene a")], "node_id string, name string")

    def texts(few):
        import unittest.mock

        with unittest.mock.patch.object(R, "HUBS", few):
            return R.sections(edges, nodes)

    one, many = texts(1024), texts(0)
    p = one._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("RepartitionByExpression") == 1
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(one) == rows(many)
    got = {(r.center, r.section): (r.n, r.text) for r in one.collect()}
    assert got["a", "PPI"][0] == 14 and got["a", "PPI"][1].startswith("Found 14 protein interaction partners:\n  1. b13 (") and got["a", "PPI"][1].endswith("... and 4 more")
    assert got["a", "GO"][1].endswith("1. ex") and got["b01", "GO"][1].endswith("1. T:y") and got["a", "TRRUST_IN"] == (1, "Regulated by 1 transcription factors:\n  1. z (Activation)")


def test_edges_to_hubs_travel_once(spark, monkeypatch):
    from graphloom.operators import rendering as R

    monkeypatch.setattr(R, "HUBS", 2)
    edges = spark.createDataFrame(
        [(f"a{k}", "HP:1", "HPO", None, "3") for k in range(6)] + [(f"a{k}", "lost", "HPO", None, None) for k in range(5)] + [("a1", "a2", "PPI", 0.5, None), ("a2", None, "TRRUST", None, "Activation")],
        "src string, dst string, edge_type string, score double, evidence string",
    )
    nodes = spark.createDataFrame([("HP:1", "one", None), ("a1", "gene 1", None), ("a2", "gene 2", None)], "node_id string, name string, definition string")
    out = R.sentences(edges, nodes)
    p = out._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("RepartitionByExpression") == 3 and "Union" in p  # two by source, one by target
    got = sorted(r.text for r in out.collect() if r.text is not None)
    want = [f"{x} is associated with phenotype one (frequency: 3)" for x in ("a0", "gene 1", "gene 2", "a3", "a4", "a5")] + [f"{x} is associated with phenotype lost" for x in ("a0", "gene 1", "gene 2", "a3", "a4")]
    assert got == sorted([*want, "gene 1 physically interacts with gene 2 (confidence: 0.50)"]) and out.count() == 13


def test_texts_of_genes_take_the_sections_one_shuffle(spark):
    from graphloom.plans import catalogue

    for name in ("x7_format_subgraph", "x15_feature_selection", "x17_styled_prompt", "x18_style_context"):
        df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert plan(df).count("RepartitionByExpression") == 1, name
        text = df._jdf.queryExecution().executedPlan().toString()
        # one by centre, and at most the genes' own beside it
        assert sum("Exchange" in line and "Broadcast" not in line for line in text.split("Initial Plan")[0].splitlines()) <= 3, text
