"""Fixtures of readers, kept tables, logs, indexes, tasks and generation."""

import gzip
import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import generation as Ge
from graphloom.operators import policy as Po
from graphloom.operators import rendering as R
from graphloom.operators import retrieval as V
from graphloom.operators import tasks as T
from graphloom.sources import adapters as A
from graphloom.sources import biofiles as B
from graphloom.sources import graph_store, stores


def test_kept_tables_are_made_once_and_anew_for_other_files(spark, tmp_path):
    src, made = str(tmp_path / "in"), []
    spark.range(3).write.parquet(src)

    def make():
        made.append(1)
        return spark.read.parquet(src).withColumn("x", F.col("id") + 1)

    for _ in range(3):
        assert graph_store.kept(spark, "t", [src], make).count() == 3
    spark.range(2).write.mode("append").parquet(src)
    assert graph_store.kept(spark, "t", [src], make).count() == 5 and len(made) == 2
    # one kept table may be made from another
    assert graph_store.kept(spark, "u", [src], lambda: graph_store.kept(spark, "t", [src], make)).count() == 5


def test_lines_of_several_files_are_in_file_order(spark, tmp_path):
    for name, rows in (("b.txt", ["b0", "b1"]), ("a.txt.gz", ["a0", "a1", "a2"]), ("c.txt", ["c0" * 100])):
        data = ("\n".join(rows) + "\n").encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    got = B.numbered(B.lines(spark, str(tmp_path)), "value").orderBy("i").collect()
    assert [(r.i, r.value) for r in got] == list(enumerate(["a0", "a1", "a2", "b0", "b1", "c0" * 100]))


def test_pairs_of_parallel_files(spark, tmp_path):
    (tmp_path / "t").write_text("a b\nc d\ne\nf g\n")
    (tmp_path / "l").write_text("1\n0\n1\n")
    got = B.gene_pairs(B.lines(spark, str(tmp_path / "t")), B.lines(spark, str(tmp_path / "l"))).collect()
    assert sorted(map(tuple, got)) == [("A", "B", 1), ("C", "D", 0)]


def test_gct_and_expression_tables(spark, tmp_path):
    (tmp_path / "x.gct").write_text("#1.2\n2\t2\nName\tDescription\tLung\tBrain\nE1\tG1\t10\t0\nE2\tG2\t3\t3\n")
    table, gene = A.expression_table(A.gct(spark, str(tmp_path / "x.gct")))
    assert gene == "Description" and set(table.columns) == {"Description", "pos", "Lung", "Brain"}
    got = {(r.src, r.tissue): (r.tpm, r.tau) for r in B.tissue_edges(table, gene).collect()}
    assert got == {("G1", "Lung"): (10.0, 1.0), ("G2", "Lung"): (3.0, 0.0), ("G2", "Brain"): (3.0, 0.0)}


def test_missing_files_and_layouts(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        A.existing(spark, str(tmp_path / "none"))
    assert A.existing(spark, str(tmp_path)) == str(tmp_path)
    assert [A.omim_kind(p) for p in ("/a/morbidmap.txt", "GeneMap2.txt", "x.csv")] == ["morbidmap", "genemap", "generic"]


def test_phenotype_columns_by_place(spark):
    rows = spark.createDataFrame([("9", "g1", "HP:1", "n", "f", 0), ("9", " ", "HP:2", "n", "f", 1)], "a string, b string, c string, d string, e string, pos long")
    assert [tuple(r) for r in A.hpo_edges(A.hpo_rows(rows)).collect()] == [("G1", "HP:1", "f")]


def test_index_and_log(spark, tmp_path):
    t = spark.createDataFrame([("t_0", "A", "B", "PPI", "x"), ("t_1", "A", "G", "GO", "y"), ("t_2", "A", "H", "GO", "z")], "triplet_id string, src string, dst string, edge_type string, text string")
    v = spark.createDataFrame([("t_0", [1.0, 0.0]), ("t_1", [0.0, 1.0])], "triplet_id string, emb array<double>")
    path = str(tmp_path / "index")
    stores.save_index(t, v, path)
    assert {r.triplet_id for r in stores.load_index(spark, path).collect()} == {"t_0", "t_1"}
    stores.Store(spark, path).commit({"counts": spark.createDataFrame([("GO", 7, 2)], "edge_type string, n long, dim int")}, "overwrite")
    with pytest.raises(ValueError, match="counts"):
        stores.load_index(spark, path)
    assert stores.load_index(spark, path, 1).count() == 2
    log = stores.RunLog(spark, str(tmp_path / "log"), "r1")
    log.log("baseline", 0, metric=0.5)
    log.log("evaluation", 1, metric=0.7, edge="GO")
    log.log("evaluation", 2, metric=0.6)
    other = stores.RunLog(spark, str(tmp_path / "log"), "r2")
    other.log("evaluation", 1, metric=0.9)
    assert log.best() == {"metric": 0.7, "edge": "GO"} and {r.kind: (r.n, r.first, r["last"]) for r in log.report().collect()} == {"baseline": (1, 0, 0), "evaluation": (2, 1, 2)}
    with pytest.raises(ValueError, match="kind"):
        log.log("other", 1)


def test_retrieval_against_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(V, "PRODUCTS", 30)
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (60, 4)).astype(float)
    index = spark.createDataFrame([(f"i{k:02}", [float(v) for v in e], "PPI") for k, e in enumerate(x)] + [("none", None, "GO"), ("short", [1.0], "GO")], "id string, emb array<double>, edge_type string")
    queries = spark.createDataFrame([(f"q{k}", [float(v) for v in x[k]]) for k in range(8)], "query_id string, q_emb array<double>")
    got = {}
    for r in V.top_k(queries, index.repartition(3), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    for k in range(8):
        want = sorted(((f"i{j:02}", float(x[k] @ x[j])) for j in range(60)), key=lambda p: (-p[1], p[0]))[:5]
        assert got[f"q{k}"] == want
    assert V.top_k(queries.where("false"), index, 5).count() == 0


def test_fixed_decimals(spark):
    df = spark.createDataFrame([(0.125,), (0.145,), (-0.005,), (2.0,)], "x double")
    assert [r[0] for r in df.select(R.fixed(F.col("x"), 2)).collect()] == ["0.13", "0.15", "-0.01", "2.00"]


def test_regressors_learn(spark):
    rows = [(k, [k / 100.0, (k * 7 % 10) / 10.0], 3.0 * k / 100 - (k * 7 % 10) / 10) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double")
    for name in T.REGRESSORS:
        got = {r.id: r.predicted for r in T.regressor(name)(df, df.select("id", "x")).collect()}
        assert math.sqrt(sum((got[k] - y) ** 2 for k, _, y in rows) / 300) < 0.6, name
    assert T.mlp_regression(df.where("false"), df.select("id", "x")).where("predicted IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="regressor"):
        T.regressor("other")
    with pytest.raises(ValueError, match="classifier"):
        T.classifier_metrics(df, "other")


def test_guards(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([1.0, float("inf")],)], "x array<double>")
    s = T.usable(rows).first()
    assert (s.n, s.finite) == (2, False) and T.usable(rows.limit(1)).first().finite and not T.usable(rows.where("false")).first().finite
    m = spark.createDataFrame([(1.0, 2.0, 3.0)], "delta_correlation double, mse double, de_correlation double")
    assert tuple(T.guarded(m, T.usable(rows), T.EMPTY_REGRESSION).first()) == (0.0, float("inf"), 0.0)


def test_one_row_of_a_class_splits_all(spark):
    rows = spark.createDataFrame([(k, 0 if k else 1) for k in range(10)], "id long, label int")
    assert T.train_test(rows, "id", "label").where("test").count() == 2
    more = rows.withColumn("label", F.col("id") % 2)
    assert T.train_test(more, "id", "label").where("test").groupBy("label").count().count() == 2


def test_generation(spark):
    dual = Ge.DualClient(spark, lambda ps: [f"fast {p}" for p in ps], lambda ps: (_ for _ in ()).throw(RuntimeError()))
    df = spark.createDataFrame([("g1", "p1"), ("g2", "p2")], "gene string, prompt string").coalesce(1)
    assert [r[0] for r in df.select(dual.generate_strong(F.col("prompt"))).collect()] == ["fast p1", "fast p2"]
    assert dual.stats()["fast_prompts"] >= 2 and dual.stats()["strong_calls"] >= 1
    assert df.select(dual.with_system("sys", F.col("prompt"))).first()[0] == "fast sys\n\np1"
    calls = [r[0] for r in df.select(Ge.in_passes(F.col("gene"), F.col("prompt"), lambda ps: [f"<{len(p)}>" if "\n" not in p else "" for p in ps], 3)).collect()]
    assert calls == ["<2>", "<2>"]
    assert Ge.mock_client(["give JSON", "x"])[0].startswith("{") and Ge.mock_client(["x"])[0].endswith("asked for.")


def test_rag(spark):
    index = spark.createDataFrame([("t1", [1.0, 0.0], "PPI", "A binds B"), ("t2", [0.0, 1.0], "GO", "A does x")], "id string, emb array<double>, edge_type string, text string")
    queries = spark.createDataFrame([("A", [1.0, 0.1])], "query_id string, q_emb array<double>")
    genes = spark.createDataFrame([("A", "name a"), ("Z", None)], "gene string, name string")
    got = {r.gene: (r.prompt, r.text) for r in Ge.rag_descriptions(genes, queries, index, "{gene_id}|{gene_name}|{context}", lambda ps: [p.upper() for p in ps], 1).collect()}
    assert got["Z"][0] == "Z|Z|No context was retrieved." and "- A binds B (relevance: 1.00)" in got["A"][0] and got["A"][1] == got["A"][0].upper()


def test_memory_score_and_free_task(spark):
    from graphloom.operators import scoring as C

    near = spark.createDataFrame([("c", "n", "PPI", "out"), ("c", "m", "GO", "out")], "center string, neighbor string, edge_type string, direction string")
    deg = spark.createDataFrame([("n", 3)], "node string, degree long")
    nodes = spark.createDataFrame([("n", "gene")], "node_id string, node_label string")
    emb = spark.createDataFrame([("c", [1.0])], "id string, emb array<double>")
    got = {r.neighbor: r for r in C.score_neighbors(near, deg, nodes, None, emb, None).collect()}
    assert got["n"].task_relevance == 0.5 and got["n"].memory == 0.5 and got["n"].confidence == pytest.approx(0.4) and got["m"].semantic == 0.3
    ema = spark.createDataFrame([("PPI", 0.2)], "edge_type string, ema double")
    sug = spark.createDataFrame([("n", 1.0)], "neighbor string, suggestion double")
    task = spark.createDataFrame([("n",)], "node string")
    got = {r.neighbor: r for r in C.score_neighbors(near, deg, nodes, task, emb, ema, sug).collect()}
    assert got["n"].memory == pytest.approx(0.6 * 0.6 + 0.4) and got["n"].task_relevance == 1.0 and got["m"].task_relevance == 0.2
    assert got["n"].confidence == pytest.approx(0.75)


def test_value_keys(spark):
    df = spark.createDataFrame([(["b", "a"], {"y": 1, "x": 2}, True)], "l array<string>, m map<string,int>, f boolean")
    r = df.select(Po.value_key(F.col("l"), "list"), Po.value_key(F.col("m"), "map"), Po.value_key(F.col("f"), "flag")).first()
    assert tuple(r) == ('["a","b"]', '{"x":2,"y":1}', "true")
