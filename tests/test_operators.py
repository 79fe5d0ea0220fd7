"""Hand-worked cases of the formulas and of the source readers."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import leakage as L
from graphloom.functions import llm_client
from graphloom.operators import evaluation as E
from graphloom.operators import graph as G
from graphloom.operators import history as H
from graphloom.operators import identifiers as I
from graphloom.operators import rendering as R
from graphloom.operators import retrieval as V
from graphloom.operators import scoring as C
from graphloom.operators import strategy as St
from graphloom.sources import biofiles as S
from graphloom.streaming.effects import streaming_effects


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, edge_type string, score double, evidence string")


def test_ties_go_by_name_and_the_least_cap_is_five(spark):
    e = edges(spark, [("A", x, "PPI", 0.5, None) for x in "FEDCBGH"])
    got = G.typed_neighbors(e, 3, weights={"PPI": 0.1}).where("center = 'A'").orderBy("rank").collect()
    assert [r.neighbor for r in got] == list("BCDEF")
    assert G.typed_neighbors(e, 3, "other").count() == 0


@pytest.mark.parametrize("method", ["random", "weighted"])
def test_samples_are_subsets_and_repeat(spark, method):
    e = edges(spark, [("A", f"n{i}", "PPI", i / 40, None) for i in range(40)])
    one, two = (sorted(r.neighbor for r in G.typed_neighbors(e, 8, method, seed="5").where("center = 'A'").collect()) for _ in range(2))
    assert one == two and len(one) == 8 == len(set(one))


def test_expansion_goes_on_or_stops(spark):
    e = edges(spark, [("A", "B", "PPI", 0.9, None), ("B", "C", "PPI", 0.9, None), ("C", "D", "PPI", 0.9, None)])
    c = spark.createDataFrame([("A",)], "center string")
    hops = lambda mode: {r.node: r.hop for r in G.expand(e, c, 3, 10, mode).collect()}
    assert hops("intended") == {"A": 0, "B": 1, "C": 2, "D": 3} and hops("reference") == {"A": 0, "B": 1}


def test_hub_penalty(spark):
    df = spark.createDataFrame([(500, False, "PPI"), (500, True, "PPI"), (100, False, "x")], "d int, t boolean, edge_type string")
    got = [r[0] for r in df.select(C.structural(F.col("d"), F.col("t"))).collect()]
    assert got == pytest.approx([0.4 + 0.28 + 0.1 - 0.3, 0.78, 0.4 * math.log1p(100) / math.log1p(500) + 0.2 + 0.1])


def test_semantic(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], None), (None, [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    score = C.semantic(C.dot(F.col("a"), F.col("b")), C.norm(F.col("a")), C.norm(F.col("b")))
    assert [r[0] for r in df.select(score).collect()] == [0.5, 0.3, 0.5, 0.5]


def test_selection_after_limits(spark):
    s = spark.createDataFrame([("c", f"n{i}", "PPI" if i < 4 else "GO", i / 10) for i in range(8)], "center string, neighbor string, edge_type string, total double")
    got = {r.neighbor for r in C.select(s, "top_k", 6, per_type={"GO": 1}).where("selected").collect()}
    assert got == {"n7", "n3", "n2"}
    assert C.select(s, "threshold", threshold=0.0).where("selected").count() == 4
    assert C.select(s, "unknown").where("selected").count() == 8


def history(spark, metrics, **more):
    return spark.createDataFrame([(1, i, m, *(v[i] for v in more.values())) for i, m in enumerate(metrics)], "task long, iteration long, metric double" + "".join(f", {k} {t}" for k, t in (("edge_types", "array<string>"), ("max_neighbors", "long"), ("max_hops", "long"), ("sampling", "string")) if k in more))


def test_rewards(spark):
    r = H.gated_rewards(history(spark, [0.8, 0.85, 0.84])).orderBy("iteration").collect()
    assert r[0].reward == pytest.approx(0.48) and r[1].improved and r[2].reward <= -0.2
    r = H.gated_rewards(history(spark, [0.5, 0.9, 0.9, 0.9, 0.9, 0.85, 0.85, 0.95])).orderBy("iteration").collect()
    assert [x.plateau_duration for x in r] == [0, 0, 0, 0, 1, 1, 0, 0]
    assert all(-1 <= x.reward <= 1 for x in r)


def test_ema_is_the_recursion(spark):
    df = spark.createDataFrame([(1, i, d) for i, d in enumerate([0.1, 0.2, -0.1])], "task long, iteration long, delta double")
    r = H.ema(df, ["task"], "iteration", "delta").first()
    assert (r.usage, r.successes) == (3, 2) and r.ema == pytest.approx(0.061)


def test_gae(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 0.0), (1, 1, 1.0, 0.0)], "task long, iteration long, reward double, value double")
    assert [r.advantage for r in H.gae(df).orderBy("iteration").collect()] == pytest.approx([1.9405, 1.0])


def test_ucb_and_distance(spark):
    df = spark.createDataFrame([(1, "a", 1.0)] + [(1, "b", 1.0)] * 3, "task long, k string, r double")
    got = {r.k: r.ucb for r in H.ucb(df, ["task", "k"], "r").collect()}
    assert got == pytest.approx({"a": 1 + 1.414 * math.sqrt(math.log(4)), "b": 1 + 1.414 * math.sqrt(math.log(4) / 3)})
    h = history(spark, [0.1, 0.2, 0.3], edge_types=[["x"], ["x"], ["y"]], max_neighbors=[5, 5, 5], max_hops=[1, 1, 1], sampling=["top_k"] * 3)
    assert [r.distance for r in H.strategy_distance(h).orderBy("iteration").collect()] == pytest.approx([1.0, 0.0, 0.3])


def test_ablation(spark):
    h = history(spark, [0.5, 0.6], edge_types=[["PPI", "GO"], ["PPI", "HPO"]])
    got = {r.edge_type: (r.n_added, r.n_removed, round(r.net, 6)) for r in H.ablation(h).collect()}
    assert got == {"HPO": (1, 0, 0.1), "GO": (0, 1, -0.1)}


def test_auc_ap(spark):
    s = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.8), ("a", 1, 0.7)], "g string, y int, score double")
    assert E.auc(s, ["g"]).first().auc == 0.5 and E.average_precision(s, ["g"]).first().ap == pytest.approx(0.5 + 0.5 * 2 / 3)
    flip = s.withColumn("score", -F.col("score"))
    assert E.auc(flip, ["g"]).first().auc == pytest.approx(0.5)


def test_ari(spark):
    same = spark.createDataFrame([("a", i % 3, i % 3) for i in range(9)], "g string, truth int, cluster int")
    assert E.clustering(same, ["g"]).first().ari == pytest.approx(1.0)
    flat = same.withColumn("cluster", F.lit(0))
    r = E.clustering(flat, ["g"]).first()
    assert r.ari == pytest.approx(0.0) and r.homogeneity == pytest.approx(0.0) and r.completeness == 1.0


def test_regression_and_ridge(spark):
    rows = spark.createDataFrame([(1, i, float(i), 2.0 * i) for i in range(3)], "id long, place long, truth double, predicted double")
    r = E.regression(rows, "id", 1).first()
    assert r["corr"] == pytest.approx(1.0) and r.mse == pytest.approx(5 / 3) and r.de_mse == 4.0 and r.de_corr == 0.0
    pts = spark.createDataFrame([([float(i), float(i * i % 7)], 3.0 * i + 1) for i in range(30)], "x array<double>, y double")
    w, b = E.ridge(pts, "x", "y", 1e-6)
    assert w[0] == pytest.approx(3, abs=1e-3) and b == pytest.approx(1, abs=1e-2)


def test_leak(spark):
    df = spark.createDataFrame([("This is an essential gene, ok",), (None,), ("",)], "text string")
    r = L.filtered(df).collect()
    assert (r[0].filtered, r[0].changes, r[0].reasons) == ("This , ok", 1, ["explicit essentiality label"])
    assert (r[1].filtered, r[1].changes) == ("", 0)
    assert L.filtered(df, strict=False).first().filtered == "This is an essential gene, ok"


def test_scores_in_text(spark):
    df = spark.createDataFrame([(1.0,), (0.95,)], "s double")
    assert [r[0] for r in df.select(R.scaled_score(F.col("s"))).collect()] == ["1.0", "950"]


def test_diversity(spark):
    rows = [("q", f"{t}{i}", t, 1 - k / 10, k + 1) for k, (t, i) in enumerate([("a", 0), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 0), ("c", 0)])]
    df = spark.createDataFrame(rows, "query_id string, id string, edge_type string, score double, rank long")
    assert [r.id for r in V.diverse(df, 4).orderBy("rank").collect()] == ["a0", "a1", "b0", "c0"]


def test_string_edges(spark):
    links = spark.createDataFrame([(f"9606.{a}", f"9606.{b}", s, i) for i, (a, b, s) in enumerate([("A", "B", "900"), ("B", "A", "900"), ("A", "A", "800"), ("A", "C", "699"), ("A", "Z", "999")])], "protein1 string, protein2 string, combined_score string, pos long")
    alias = spark.createDataFrame([(f"9606.{x}", x.lower(), "BioMart_HUGO", i) for i, x in enumerate("ABC")] + [("9606.A", "other", "BioMart_HUGO", 9)], "ensp string, alias string, source string, pos long")
    assert [tuple(r) for r in S.string_edges(links, alias).collect()] == [("A", "B", 0.9)]


def test_tau(spark):
    long = spark.createDataFrame([("g1", 0, t, v) for t, v in zip("abc", (10, 0, 0), strict=True)] + [("g2", 0, t, 5) for t in "abc"] + [("g3", 0, "a", 7)] + [("g4", 0, "a", 2), ("g4", 1, "a", 5)], "src string, pos long, tissue string, tpm long")
    got = {r.src: (r.tau, r.tpm) for r in S.expression(long).collect()}
    assert got == {"g1": (1.0, 10.0), "g2": (0.0, 5.0), "g3": (0.0, 7.0), "g4": (0.0, 5.0)}


def test_parsers(spark, tmp_path):
    df = spark.createDataFrame([("TP53(P04637);MDM2;3ABC",), ("a b",), ("x,y",)], "t string")
    assert [r[0] for r in df.select(S.subunits(F.col("t"))).collect()] == [["TP53", "MDM2"], ["A", "B"], ["X", "Y"]]
    name, kind = S.phenotype(F.col("t"))
    r = spark.createDataFrame([("{Foo syndrome (AD), 123456",)], "t string").select(name, kind).first()
    assert tuple(r) == ("Foo syndrome (AD)", "Autosomal dominant")
    obo = spark.createDataFrame([('[Term]\nid: GO:1\nname: a\nnamespace: p\ndef: "text" [x]',), ("[Term]\nid: GO:2\nname: b\nis_obsolete: true",), ("format: 1",)], "value string")
    assert [(r.id, r.definition, r.obsolete) for r in S.obo_terms(obo).orderBy("id").collect()] == [("GO:1", "text", False), ("GO:2", None, True)]
    (tmp_path / "g.txt").write_text("# c\nabc\n\nABC \nx\n")
    assert sorted(r.gene for r in S.gene_list(S.lines(spark, str(tmp_path / "g.txt"))).collect()) == ["ABC", "X"]


def test_chromatin_and_overlap(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "gene string") for xs in ("xy", "yz"))
    assert {r.gene: r.state for r in S.chromatin_states(a, b).collect()} == {"x": "lys4_only", "y": "bivalent", "z": "lys27_only"}
    assert {r.gene: r.label for r in S.without_overlap(a, b).collect()} == {"x": 1, "z": 0}


def test_reactome_backfill(spark):
    paths = spark.createDataFrame([("R-HSA-1", "one", 0), ("R-MMU-1", "m", 1)], "id string, name string, pos long")
    genes = spark.createDataFrame([("5", "R-HSA-2", "two", "Homo sapiens", "TAS", 0), ("5", "R-HSA-1", "one", "Homo sapiens", "IEA", 1), ("6", "R-HSA-1", "one", "Homo sapiens", "IEA", 2)], "entrez string, pathway string, name string, species string, evidence string, pos long")
    ids = spark.createDataFrame([("5", "OLD", 0), ("5", "G5", 1)], "entrez string, symbol string, pos long")
    nodes, e = S.reactome_edges(paths, genes, ids)
    assert {r.id for r in nodes.collect()} == {"R-HSA-1", "R-HSA-2"} and {(r.src, r.dst) for r in e.collect()} == {("G5", "R-HSA-1"), ("G5", "R-HSA-2")}


def test_identifier_mapping(spark):
    g = spark.createDataFrame([("A", "E1", "1", "U1|U2", None, "aa|bb", 0), ("B", "E2", "2", "U2", "OLD", None, 1)], "symbol string, ensembl string, entrez string, uniprot string, prev string, alias string, pos long")
    m = {(r.kind, r.key): r.symbol for r in I.mapper(g).collect()}
    assert m["uniprot", "U2"] == "B" and m["alias", "OLD"] == "B" and m["alias", "aa"] == "A"


def test_header_roles():
    roles = {"gene": ("symbol",), "term": ("hpo_id", "term"), "freq": ("freq",)}
    assert S.resolve_header(["Gene Symbol", "x", "HPO-ID"], roles, {"freq": 1}) == {"gene": "Gene Symbol", "term": "HPO-ID", "freq": "x"}


def test_graph_round_trip(spark, tmp_path):
    e = edges(spark, [("A", "B", "PPI", 0.9, None), ("A", "G", "GO", None, "IEA")])
    n = spark.createDataFrame([("A", "gene")], "node_id string, node_label string")
    S.write_graph(n, e, str(tmp_path / "kg"))
    nodes, back = S.read_graph(spark, str(tmp_path / "kg"))
    assert nodes.count() == 1 and back.where("edge_type = 'GO'").count() == 1


def test_offline_client(spark):
    df = spark.createDataFrame([("g1", "p"), ("g2", None)], "gene string, prompt string")

    def fails(prompts):
        raise RuntimeError

    assert [r[0] for r in df.select(llm_client.described(F.col("gene"), F.col("prompt"), lambda ps: [p.upper() for p in ps])).collect()] == ["P", ""]
    assert [r[0] for r in df.select(llm_client.described(F.col("gene"), F.col("prompt"), fails)).collect()] == ["Gene g1", "Gene g2"]
    v = df.select(llm_client.hashed_embedding(F.lit("Alpha beta alpha"), 8)).first()[0]
    assert len(v) == 8 and sum(abs(x) for x in v) in (1.0, 3.0)


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(t, "PPI" if i % 2 else "GO", i, (i * 7 % 5 - 2) / 10) for t in (1, 2) for i in range(12)]
    df = spark.createDataFrame(rows, "task long, edge_type string, iteration long, delta double")
    for k in range(3):
        df.where((F.col("iteration") >= 4 * k) & (F.col("iteration") < 4 * k + 4)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = streaming_effects(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: b.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "out")).groupBy("task", "edge_type").agg(F.max_by("ema", "usage").alias("ema"), F.max("usage").alias("usage"))
    want = H.ema(df, ["task", "edge_type"], "iteration", "delta")
    assert {(r.task, r.edge_type): (r.usage, round(r.ema, 9)) for r in last.collect()} == {(r.task, r.edge_type): (r.usage, round(r.ema, 9)) for r in want.collect()}


def test_expand_of_all_parts(spark):
    from graphloom.plans import projection as P
    from graphloom.plans.queries import g4_expand

    sf, inc, best = "/root/testdata/sf0.001", {}, {}
    for e in P.edges(spark, sf, ("PPI", "TRRUST")).collect():
        ends = [(e.src, e.dst, "out")] + ([(e.dst, e.src, "in")] if e.edge_type == "PPI" else [])
        for a, b, way in ends:
            inc.setdefault((a, e.edge_type), []).append((-(e.score or 0), b, way))
            best.setdefault(a, {})[b] = max(e.score or 0, best.get(a, {}).get(b, 0))
    want, centers = set(), ["P" + str(r.p_partkey) for r in P.table(spark, sf, "part").collect()]
    for c in centers:
        h1 = {b for t in ("PPI", "TRRUST") for _, b, _ in sorted(inc.get((c, t), []))[:5]} - {c}
        h2 = {b for n in h1 for b in sorted(best.get(n, {}), key=lambda b: (-best[n][b], b))[: max(5, 10 // len(h1))]} - h1 - {c}
        want |= {(c, c, 0)} | {(c, n, 1) for n in h1} | {(c, n, 2) for n in h2}
    got = [tuple(r) for r in g4_expand(spark, sf).select("center", "node", "hop").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({r[0] for r in got}) == len(centers) > 100


def test_suggestions_past_a_hot_edge_type(spark):
    # the 100 best tasks' bests are all of the type that the asking tasks have now
    s = spark.createDataFrame([(t, t, "PPI", 0.9) for t in range(100)] + [(100 + t, 100 + t, "GO", 0.5 - t / 100) for t in range(5)], "task long, family long, edge_types string, improvement double")
    now = spark.createDataFrame([(t, t, "PPI") for t in (0, 7, 100)], "task long, family long, edge_types string")
    got = {}
    for r in St.suggestions(s, now).orderBy("for_task", "rank").collect():
        got.setdefault(r.for_task, []).append((r.source, r.task))
    best = [("best_from", t) for t in (100, 101, 102, 103)]
    assert got == {0: best[:3], 7: best[:3], 100: [("same_task", 100), *best[1:3]]}


def test_gae_to_the_end_of_a_task(spark):
    df = spark.range(1500).selectExpr("1 AS task", "id AS iteration", "cast(id % 7 AS double) AS reward", "cast(id % 3 AS double) AS value")
    want, after, ahead = [], 0.0, 0.0
    for i in reversed(range(1500)):
        after, ahead = i % 7 + 0.99 * ahead - i % 3 + 0.99 * 0.95 * after, i % 3
        want.insert(0, after)
    assert [r.advantage for r in H.gae(df).orderBy("iteration").collect()] == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_cross_validation_fits_whole_models(spark, monkeypatch):
    from pyspark.ml import classification

    seen = {}

    def forest(**kw):
        seen.update(kw)
        raise InterruptedError

    monkeypatch.setattr(classification, "LogisticRegression", lambda **kw: seen.update(kw))
    monkeypatch.setattr(classification, "RandomForestClassifier", forest)
    with pytest.raises(InterruptedError):
        E.cross_validated(spark.createDataFrame([(i, i % 2, [float(i)]) for i in range(20)], "id long, label int, emb array<double>"))
    assert (seen["numTrees"], seen["maxIter"]) == (100, 1000)
