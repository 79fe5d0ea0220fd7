"""Queries of records: as JSON, read back, looked up and told of, with their SQL.

A record is a row of another query, so that its JSON, and what a reader makes of it,
is compared with what that query's own SQL gives."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import evaluation as E
from graphloom.operators import history as H
from graphloom.operators import policy as Po
from graphloom.operators import rendering as R
from graphloom.operators import tasks as T
from graphloom.plans import adapter_queries as AQ
from graphloom.plans import history_queries as HQ
from graphloom.plans import policy_queries as PQ
from graphloom.plans import projection as P
from graphloom.plans import task_queries as TQ
from graphloom.plans import text_queries as XQ
from graphloom.plans.history_queries import HIST, W
from graphloom.plans.projection import with_sql
from graphloom.plans.queries import QUERIES, SCORED, SQL, query, rounded, scaled, scores

#: Records: the query whose rows they are, their fields, and decimals where they
#: are numbers with a fraction.
RECORDS = {
    "reward_weights": ("w42_reward_weights", {"task": None, "baseline_weight": 3, "relative_weight": 3, "raw_weight": 3, "plateau_penalty": 3}),
    "experiment": ("w14_recent_history", {"task": None, "iteration": None, "metric": 3}),
    "edge_contribution": ("w26_ablation", {"task": None, "edge_type": None, "n_added": None, "n_removed": None, "when_added": 2, "when_removed": 2, "class": None}),
    "hypothesis": ("r124_hypothesis_ledger", {"task": None, "iteration": None, "hypothesis": None, "status": None}),
    "selection_result": ("t4_select_top_k", {"center": None, "n_total": None, "n_selected": None, "n_excluded": None, "selection_rate": 2}),
    "strategy_config": ("p12_extraction_strategy", {"id": None, "edge_types": None, "max_neighbors": None, "sampling": None, "max_hops": None}),
    "neighbor_score": ("m6_neighbor_scores", {"center": None, "neighbor": None, "edge_type": None, "direction": None, "total": 2}),
    "edge_type_stats": ("a1_neighbor_stats", {"edge_type": None, "n_rows": None, "n_high": None, "n_low": None, "est_tokens": None}),
    "frequent_neighbor": ("a2_frequent_neighbors", {"neighbor": None, "n": None}),
    "iteration_stats": ("g8_neighbor_analysis", {"total": None, "genes": None, "high": None, "low": None}),
    "edge_effect": ("w15_edge_effects", {"task": None, "edge_type": None, "usage": None, "successes": None, "ema": 2}),
    "trend": ("w7_trends", {"task": None, "iteration": None, "direction": None, "duration": None, "action": None}),
    "reward_signal": ("w5_reward_signal", {"task": None, "iteration": None, "state": None, "signal": 2}),
    "reward_result": ("w2_gated_rewards", {"task": None, "iteration": None, "improved": None, "plateau_duration": None, "reward": 2}),
    "state": ("w13_state_updates", {"task": None, "iteration": None, "best_metric": 2, "best_iteration": None}),
}


def records(spark, d, name: str):
    base, fields = RECORDS[name]
    rows = QUERIES[base](spark, d)
    return rows.select(*[F.col(c) if places is None else F.round(F.col(c).cast("decimal(28,9)"), places).cast("double").alias(c) for c, places in fields.items()])


def records_sql(name: str) -> str:
    base, fields = RECORDS[name]
    cols = ", ".join(c if places is None else f"cast(round(cast({c} AS decimal(28,9)), {places}) AS double) AS {c}" for c, places in fields.items())
    return f"SELECT {cols} FROM ({SQL[base]})"


def as_json(spark, d, name: str):
    return records(spark, d, name).select(F.to_json(F.struct(*RECORDS[name][1]), {"ignoreNullFields": "false"}).alias("json"))


def json_sql(name: str) -> str:
    fields = ", ".join(f"'{c}': {c}" for c in RECORDS[name][1])
    return f"SELECT cast(to_json({{{fields}}}) AS varchar) AS json FROM ({records_sql(name)})"


def from_json(spark, d, name: str):
    """Records read back from JSON that holds a key more than their schema."""
    rows = records(spark, d, name)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    text = F.to_json(F.struct(*rows.columns, F.lit("x").alias("unknown")), {"ignoreNullFields": "false"})
    return rows.select(F.from_json(text, schema).alias("r")).select("r.*")


def _register(number: int, name: str, what: str) -> None:
    make = as_json if what == "json" else from_json

    def run(spark, d):
        return make(spark, d, name)

    run.__name__ = f"r{number}_{name}_{'json' if what == 'json' else 'from_json'}"
    query(json_sql(name) if what == "json" else records_sql(name))(run)


for _number, _name, _what in (
    (11, "reward_weights", "json"), (12, "reward_weights", "read"), (81, "experiment", "json"), (119, "edge_contribution", "json"), (120, "edge_contribution", "read"),
    (121, "hypothesis", "json"), (122, "hypothesis", "read"), (141, "selection_result", "json"), (142, "strategy_config", "json"), (143, "strategy_config", "read"),
    (223, "neighbor_score", "json"), (224, "edge_type_stats", "json"), (225, "frequent_neighbor", "json"), (226, "iteration_stats", "json"), (230, "edge_effect", "json"),
    (231, "edge_effect", "read"), (249, "trend", "json"), (254, "reward_signal", "json"), (255, "reward_result", "json"), (265, "state", "json"), (266, "state", "read"),
):
    _register(_number, _name, _what)


# ---- look-ups in histories, ledgers and memory


@query(HIST + "SELECT task, round(max(metric), 9) AS best_metric, count(*) AS n FROM hist GROUP BY 1")
def r87_best_metric(spark, d):
    return P.history(spark, d).groupBy("task").agg(F.round(F.max("metric"), 9).alias("best_metric"), F.count("*").alias("n"))


@query(HIST.rstrip() + """, r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY iteration DESC) AS r FROM hist) SELECT task, iteration, edge_type, max_neighbors,
  max_hops, sampling FROM r WHERE r = 1""")
def r90_last_strategy(spark, d):
    last = F.max_by(F.struct("iteration", "edge_type", "max_neighbors", "max_hops", "sampling"), "iteration")
    return P.history(spark, d).groupBy("task").agg(last.alias("s")).select("task", "s.*")


@query(HQ.CRITIC.rstrip() + ", l AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY iteration DESC) AS r FROM critic) SELECT task, round(value, 9) AS value FROM l WHERE r = 1")
def r102_current_values(spark, d):
    return rounded(HQ.critic(spark, d).groupBy("task").agg(F.max_by("value", "iteration").alias("value")), "value", places=9)


LEDGER = HIST.rstrip() + f""", l AS (SELECT *, metric - lag(metric) {W}) AS delta, row_number() {W}) AS n FROM hist), led AS (SELECT task, iteration, 'H' || lpad(cast(n AS
  varchar), greatest(3, len(cast(n AS varchar)))::int, '0') AS hypothesis, CASE WHEN delta > 0.02::double THEN 'VALIDATED' WHEN delta < -0.02::double
  THEN 'INVALIDATED' ELSE 'PROPOSED' END AS status FROM l) """


@query(LEDGER + "SELECT task, hypothesis, status FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY iteration DESC) AS r FROM led) WHERE r = 1")
def r127_current_hypotheses(spark, d):
    led = TQ.r124_hypothesis_ledger(spark, d)
    return led.groupBy("task").agg(F.max_by(F.struct("hypothesis", "status"), "iteration").alias("h")).select("task", "h.*")


@query(LEDGER + "SELECT task, hypothesis FROM led WHERE status = 'PROPOSED'")
def r128_active_hypotheses(spark, d):
    return TQ.r124_hypothesis_ledger(spark, d).where("status = 'PROPOSED'").select("task", "hypothesis")


@query(LEDGER + "SELECT task, hypothesis FROM led WHERE status = 'VALIDATED'")
def r129_validated_hypotheses(spark, d):
    return TQ.r124_hypothesis_ledger(spark, d).where("status = 'VALIDATED'").select("task", "hypothesis")


@query(LEDGER + "SELECT task, hypothesis FROM led WHERE status = 'INVALIDATED'")
def r130_invalidated_hypotheses(spark, d):
    return TQ.r124_hypothesis_ledger(spark, d).where("status = 'INVALIDATED'").select("task", "hypothesis")


@query(LEDGER + "SELECT task, hypothesis, '[' || hypothesis || '] ' || lower(status) || ' at iteration ' || iteration AS text FROM led")
def r123_hypothesis_text(spark, d):
    text = F.concat(F.lit("["), "hypothesis", F.lit("] "), F.lower("status"), F.lit(" at iteration "), F.col("iteration").cast("string"))
    return TQ.r124_hypothesis_ledger(spark, d).select("task", "hypothesis", text.alias("text"))


@query(HQ.ABL + "SELECT task, edge_type FROM abl WHERE n_added + n_removed >= 2 AND net > 0.01")
def r135_beneficial_edge_types(spark, d):
    return H.ablation(HQ.strategies(spark, d)).where("n_added + n_removed >= 2 AND net > 0.01").select("task", "edge_type")


@query(HQ.PARAMS + ", b AS (SELECT *, row_number() OVER (PARTITION BY task, param ORDER BY round(ema, 9), value) AS worst FROM pe) SELECT task, param, value, worst FROM b WHERE worst <= 3")
def r149_worst_values(spark, d):
    e = H.parameter_effects(P.history(spark, d), ["sampling", "max_hops", "edge_type"]).withColumn("effect", F.round("effect", 9))
    w = Window.partitionBy("task", "param").orderBy("effect", "value")
    return e.withColumn("worst", F.row_number().over(w).cast("long")).where("worst <= 3").select("task", "param", "value", "worst")


@query(HQ.EFF + "SELECT task, edge_type, round(ema, 9) AS ema FROM eff WHERE edge_type = 'click'")
def r235_task_effect(spark, d):
    return rounded(HQ.effects(spark, d).where("edge_type = 'click'").select("task", "edge_type", "ema"), "ema", places=9)


@query("SELECT edge_type, round(successes / usage, 6) AS success_rate, ema FROM (" + SQL["w16_global_effects"] + ")")
def r239_edge_effectiveness(spark, d):
    e = HQ.w16_global_effects(spark, d)
    return e.select("edge_type", F.round(F.col("successes") / F.col("usage"), 6).alias("success_rate"), "ema")


KEYS = HIST.rstrip() + f", k AS (SELECT *, {HQ.KEY} AS strategy FROM hist) "


def _keys(spark, d):
    return HQ.strategies(spark, d).withColumn("strategy", H.strategy_key(F.col("edge_types"), F.col("max_hops"), F.col("max_neighbors"), F.col("sampling")))


@query(KEYS + "SELECT task, strategy, round(sum(metric), 9) AS total, count(*) AS visits FROM k GROUP BY 1, 2")
def r242_reward_sums(spark, d):
    return rounded(_keys(spark, d).groupBy("task", "strategy").agg(F.sum("metric").alias("total"), F.count("*").alias("visits")), "total", places=9)


@query(KEYS + f""", v AS (SELECT task, iteration, strategy, row_number() OVER (PARTITION BY task, strategy ORDER BY iteration) AS visit FROM k) SELECT task, iteration,
  visit, CASE WHEN iteration % 10 = 0 THEN 'forced' WHEN visit = 1 THEN 'ucb' WHEN {PQ.unit_sql('x').replace('id', 'task')} < 0.2 THEN 'epsilon' ELSE
  'exploit' END AS decision FROM v""")
def r243_decisions(spark, d):
    """Forced exploration, then the bound's, then chance; the first that holds."""
    from graphloom.operators.graph import unit_hash

    v = F.row_number().over(Window.partitionBy("task", "strategy").orderBy("iteration")).cast("long")
    u = unit_hash(F.lit("0"), F.col("task").cast("string"), F.lit("x"))
    rows = _keys(spark, d).withColumn("visit", v)
    decision = F.when(F.col("iteration") % 10 == 0, "forced").when(F.col("visit") == 1, "ucb").when(u < 0.2, "epsilon").otherwise("exploit")
    return rows.select("task", "iteration", "visit", decision.alias("decision"))


@query(HQ.TREND + "SELECT task, count(*) FILTER (WHERE action = 'explore') AS explored, count(*) FILTER (WHERE action = 'exploit') AS exploited FROM trend GROUP BY 1")
def r263_exploration_counters(spark, d):
    t = H.trends(P.history(spark, d))
    return t.groupBy("task").agg(F.count_if(F.col("action") == "explore").alias("explored"), F.count_if(F.col("action") == "exploit").alias("exploited"))


@query(HQ.TREND + f"SELECT task, iteration, direction || ' for ' || duration || ' (' || action || ', convergence ' || {XQ.fixed_sql('round(convergence, 9)', 2)} || ')' AS text FROM trend")
def r253_trend_text(spark, d):
    t = H.trends(P.history(spark, d))
    text = F.concat("direction", F.lit(" for "), F.col("duration").cast("string"), F.lit(" ("), "action", F.lit(", convergence "), R.fixed(F.round("convergence", 9), 2), F.lit(")"))
    return t.select("task", "iteration", text.alias("text"))


@query(HQ.SIGNALS + """SELECT task, iteration, state = 'stagnation' AS plateau, CASE state WHEN 'breakthrough' THEN 'A new best.' WHEN 'stagnation' THEN
  'Small change without gain: try something else.' ELSE 'The change did not help: learn from it.' END AS message FROM sig""")
def r262_signal_messages(spark, d):
    h = HQ.strategies(spark, d)
    s = H.reward_signals(h.join(H.strategy_distance(h), ["task", "iteration"]), F.col("distance"))
    message = F.when(F.col("state") == "breakthrough", "A new best.").when(F.col("state") == "stagnation", "Small change without gain: try something else.").otherwise("The change did not help: learn from it.")
    return s.select("task", "iteration", (F.col("state") == "stagnation").alias("plateau"), message.alias("message"))


@query("SELECT task, iteration, 'Iteration ' || iteration || ': best ' || " + XQ.fixed_sql("best_metric", 4) + " || ' at ' || best_iteration AS text FROM (" + SQL["w13_state_updates"] + ")")
def r267_state_text(spark, d):
    s = rounded(H.state_updates(P.history(spark, d)), "best_metric")
    text = F.concat(F.lit("Iteration "), F.col("iteration").cast("string"), F.lit(": best "), R.fixed(F.col("best_metric"), 4), F.lit(" at "), F.col("best_iteration").cast("string"))
    return s.select("task", "iteration", text.alias("text"))


# ---- tasks, cells, sources


@query(PQ._task_sql + """SELECT task, CASE split_part(task, '_', 1) WHEN 'ppi' THEN 'auc' WHEN 'ggi' THEN 'auc' WHEN 'phenotype' THEN 'auc' WHEN 'geneattribute' THEN 'auc'
  WHEN 'dosage' THEN 'accuracy' ELSE 'f1' END AS metric, CASE task WHEN 'ppi' THEN 'PPI Prediction' WHEN 'genetype' THEN 'Gene Type Classification'
  WHEN 'ggi' THEN 'Gene-Gene Interaction' WHEN 'cell' THEN 'Cell Type Classification' ELSE upper(task) END AS name FROM tk""")
def r180_task_names(spark, d):
    family, metric, name = F.substring_index("task", "_", 1), F.lit("f1"), F.upper("task")
    for t, m in Po.PRIMARY.items():
        metric = F.when(family == t, m).otherwise(metric)
    for t, n in Po.DISPLAY.items():
        name = F.when(F.col("task") == t, n).otherwise(name)
    return PQ._tasks(spark, d).select("task", metric.alias("metric"), name.alias("name"))


@query("""WITH u AS (SELECT user_id, count(*) AS n, avg(value / 200.0::double) AS m FROM events WHERE event_type <> 'click' GROUP BY 1) SELECT user_id AS task, CASE WHEN n > 3 THEN
  round(m, 9) ELSE 0.0::double END AS accuracy, CASE WHEN n > 3 THEN round(m / 7.3::double, 9) ELSE 0.0::double END AS f1, CASE WHEN n > 3 THEN round(1 - m, 9) ELSE 0.5::double END AS auc,
  CASE WHEN n > 3 THEN round(m / 3.7::double, 9) ELSE 0.5::double END AS ap FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN u USING (user_id)""")
def r165_empty_metrics(spark, d):
    """Metrics of users with more than three events of other kinds than clicks; the
    neutral ones for all others."""
    e = P.table(spark, d, "events").withColumnRenamed("user_id", "task")
    m = F.avg(F.col("value") / 200.0)
    got = e.where("event_type <> 'click'").groupBy("task").agg(F.count("*").alias("n"), *[F.round(x, 9).alias(c) for c, x in (("accuracy", m), ("f1", m / 7.3), ("auc", 1 - m), ("ap", m / 3.7))])
    state = e.select("task").distinct().join(got.where("n > 3").select("task", "n"), "task", "left").select("task", F.coalesce("n", F.lit(0)).alias("n"), F.lit(True).alias("finite"))
    return T.guarded_by(got.drop("n"), state, ["task"], T.EMPTY_CLASSIFICATION)


@query("SELECT count(DISTINCT source) AS n_types, count(*) AS n_cells, count(DISTINCT lang) AS n_langs, min(source) AS first FROM documents")
def r197_cell_data_info(spark, d):
    return P.table(spark, d, "documents").agg(F.countDistinct("source").alias("n_types"), F.count("*").alias("n_cells"), F.countDistinct("lang").alias("n_langs"), F.min("source").alias("first"))


@query("SELECT DISTINCT source AS cell_type FROM documents WHERE source IS NOT NULL")
def r196_cell_types(spark, d):
    return P.table(spark, d, "documents").where("source IS NOT NULL").select(F.col("source").alias("cell_type")).distinct()


@query(P.with_sql("emb") + "SELECT count(DISTINCT label) AS n_classes, string_agg(DISTINCT cast(label AS varchar), ',' ORDER BY cast(label AS varchar)) AS names FROM emb")
def r208_class_names(spark, d):
    names = P.embeddings(spark, d).select(F.col("label").cast("string").alias("l")).distinct()
    return names.agg(F.count("*").alias("n_classes"), F.array_join(F.array_sort(F.collect_list("l")), ",").alias("names"))


@query(TQ.PAIRS + f""", j AS (SELECT k, g1, g2, g.label, CASE WHEN g1 <= g2 THEN list_concat(a.emb, b.emb) ELSE list_concat(b.emb, a.emb) END AS x FROM g JOIN emb a ON a.id
  = upper(g1) JOIN emb b ON b.id = g2) SELECT CASE WHEN k % 10 < 8 THEN 'train' WHEN k % 10 = 8 THEN 'val' ELSE 'test' END AS split, g1, g2, label,
  {TQ.probe_sql()} FROM j""")
def r210_features_with_splits(spark, d):
    own = TQ._three(spark, d).select("split", "g1", "g2", "label")
    out = None
    for name in ("train", "val", "test"):
        f = T.pair_features(own.where(F.col("split") == name).drop("split"), P.embeddings(spark, d)).select(F.lit(name).alias("split"), "g1", "g2", "label", *TQ.probe())
        out = f if out is None else out.unionByName(f)
    return out


@query("WITH x AS (SELECT o_orderpriority AS cond, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1) SELECT cond, n FROM x WHERE n >= 3")
def r217_valid_conditions(spark, d):
    return P.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("cond")).agg(F.countDistinct("o_orderkey").alias("n")).where("n >= 3")


@query(P.with_sql("emb") + "SELECT max(len(emb)) AS dim, min(len(emb)) AS least FROM emb")
def r155_embedding_dim(spark, d):
    return P.embeddings(spark, d).agg(F.max(F.size("emb")).cast("long").alias("dim"), F.min(F.size("emb")).cast("long").alias("least"))


@query(AQ.PANGLAO + "SELECT DISTINCT src AS gene FROM p")
def r50_marker_genes(spark, d):
    return AQ._panglao(spark, d).select(F.upper(F.trim("symbol")).alias("gene")).distinct()


@query(P.with_sql("all_edges") + "SELECT edge_type, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges GROUP BY 1")
def r65_counts_by_label(spark, d):
    return P.edges(spark, d, P.ALL_TYPES).groupBy("edge_type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query(P.with_sql("all_edges").rstrip() + " SELECT edge_type, header, n FROM (SELECT edge_type, count(*) AS n FROM edges GROUP BY 1) JOIN (VALUES " + ", ".join(f"('{t}', '{h}')" for t, h in R.HEADERS.items()) + ") t(edge_type, header) USING (edge_type)")
def r268_headers(spark, d):
    """The heading of each type that the graph has, and its edges."""
    named = spark.createDataFrame(list(R.HEADERS.items()), "edge_type string, header string")
    return P.edges(spark, d, P.ALL_TYPES).groupBy("edge_type").agg(F.count("*").alias("n")).join(F.broadcast(named), "edge_type").select("edge_type", "header", "n")


@query("""SELECT 'P' || k AS symbol, coalesce(p_name, 'P' || k) AS name, CASE WHEN p_partkey IS NULL THEN 'unknown' ELSE 'gene' END AS label FROM (SELECT vec_id
  AS k FROM embeddings) LEFT JOIN part ON p_partkey = k""")
def r269_node_info(spark, d):
    e = P.table(spark, d, "embeddings").select(P.gene("vec_id").alias("node_id"))
    n = P.nodes(spark, d).select("node_id", "name", "node_label")
    j = e.join(n, "node_id", "left")
    return j.select(F.col("node_id").alias("symbol"), F.coalesce("name", "node_id").alias("name"), F.coalesce("node_label", F.lit("unknown")).alias("label"))


@query(PQ.ANALYSIS + f""", m AS (SELECT center, count(*) AS n, round(avg(total), 9) AS a, count(*) FILTER (WHERE total >= 0.7) AS h, count(*) FILTER (WHERE total < 0.4) AS l
  FROM scores GROUP BY 1),
gs AS (SELECT 'P' || p_partkey AS center, p_partkey % 2 AS odd FROM part) SELECT gs.center, CASE WHEN an.center IS NULL THEN 'No neighbors found for '
  || gs.center WHEN odd = 1 THEN text ELSE m.center || ': ' || n || ' neighbors, avg=' || {XQ.fixed_sql('a', 2)} || ', high=' || h || ', low=' || l
  END AS text FROM gs LEFT JOIN an ON an.center = gs.center LEFT JOIN m ON m.center = gs.center""")
def r222_format_by_mode(spark, d):
    """Odd genes as a summary, even ones in short; a text too where there is nothing."""
    s = scores(spark, d)
    c = P.table(spark, d, "part").select(P.gene("p_partkey").alias("center"), (F.col("p_partkey") % 2 == 1).alias("odd"))
    long, short = Po.analysis(s).withColumnRenamed("text", "a"), Po.minimal_summary(s).withColumnRenamed("text", "b")
    j = c.join(long, "center", "left").join(short, "center", "left")
    return j.select("center", F.coalesce(F.when(F.col("odd"), F.col("a")).otherwise(F.col("b")), F.concat(F.lit("No neighbors found for "), "center")).alias("text"))


@query(SCORED + "SELECT center, max(total) AS top, arg_max(neighbor, {'t': total, 'n': neighbor}) AS best FROM scores GROUP BY 1")
def r250_best_neighbors(spark, d):
    s = scores(spark, d)
    return s.groupBy("center").agg(F.max("total").alias("top"), F.max_by("neighbor", F.struct("total", "neighbor")).alias("best"))


def e9_regression_fold(spark, d):
    """Held-out regression of each gene's first feature from all others by three
    regressors: fitted models, so there is no SQL; tests hold them to known functions."""
    from graphloom.sources.graph_store import written

    e = P.embeddings(spark, d).select("id", F.expr("slice(emb, 2, size(emb) - 1)").alias("x"), F.element_at("emb", 1).alias("y"))
    rows, out = written(T.train_test(e, "id"), "split"), None
    for name in ("ridge", "forest", "mlp"):
        got = T.regressor(name)(rows.where("NOT test"), rows.where("test").select("id", "x"))
        pairs = got.join(rows.where("test").select("id", F.col("y").alias("truth")), "id").select(F.lit(name).alias("model"), F.xxhash64("id").alias("place"), "truth", "predicted")
        own = E.regression(pairs, "model").select("model", F.round("corr", 6).alias("corr"), F.round("mse", 6).alias("mse"))
        out = own if out is None else out.unionByName(own)
    return out


query()(e9_regression_fold)


@query(with_sql("emb").rstrip() + " SELECT dim, 0.0::double AS gap FROM (SELECT DISTINCT unnest(range(2, len(emb) + 1)) AS dim FROM emb)")
def e2_ridge_conditions(spark, d):
    """What makes a ridge fit the least one: each centred feature's product with
    the residuals, less its weight times the penalty, is zero (alpha 1, all rows)."""
    e = P.embeddings(spark, d).select("id", F.expr("slice(emb, 2, size(emb) - 1)").alias("x"), F.element_at("emb", 1).alias("y"))
    w, _ = E.ridge(e, "x", "y", 1.0)
    fitted = T.regressor("ridge")(e, e.select("id", "x")).join(e, "id")
    long = fitted.select((F.col("y") - F.col("predicted")).alias("r"), F.posexplode("x").alias("k", "v"))
    per = long.groupBy("k").agg(F.sum(F.col("v") * F.col("r")).alias("s"), F.sum("r").alias("sr"), F.avg("v").alias("m"))
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in w]), F.col("k") + 1)
    gap = F.round(F.col("s") - F.col("m") * F.col("sr") - weight, 6)
    return per.select((F.col("k") + 2).cast("long").alias("dim"), F.when(gap == 0, 0.0).otherwise(gap).alias("gap"))


# ---- parts of composite operators by themselves


@query(XQ.DESC + f" SELECT doc_id, len({XQ._issues}) = 0 AS safe FROM descs")
def x6_is_safe(spark, d):
    from graphloom.functions import leakage as L

    return XQ.descriptions(spark, d).select("doc_id", L.is_safe(F.col("text")).alias("safe"))


@query(XQ.FILTER + "SELECT doc_id, filtered FROM out")
def x2_simple_filter(spark, d):
    from graphloom.functions import leakage as L

    return L.filtered(XQ.descriptions(spark, d)).select("doc_id", "filtered")


@query("SELECT node_id, coalesce(name, node_id) AS name FROM (SELECT 'P' || p_partkey AS node_id, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_name END AS name FROM part)")
def x10_node_names(spark, d):
    part = P.table(spark, d, "part").select(P.gene("p_partkey").alias("node_id"), F.when(F.col("p_size") % 4 != 0, F.col("p_name")).alias("name"))
    return part.select("node_id", F.coalesce("name", "node_id").alias("name"))


@query(HQ.ABL + "SELECT task, edge_type, class FROM abl")
def w27_ablation_classes(spark, d):
    return H.ablation(HQ.strategies(spark, d)).select("task", "edge_type", "class")


@query(HQ.GAE + "SELECT task, iteration, round(td, 9) AS td FROM g1")
def w38_temporal_differences(spark, d):
    return rounded(H.gae(HQ.critic(spark, d).withColumnRenamed("metric", "reward")).select("task", "iteration", "td"), "td", places=9, by=scaled)


@query(HIST + f"SELECT task, iteration, coalesce(metric <= lag(metric, 1) {W}) AND lag(metric, 1) {W}) <= lag(metric, 2) {W}), false) AS decline FROM hist")
def w40_declines(spark, d):
    w = Window.partitionBy("task").orderBy("iteration")
    back = lambda n: F.lag("metric", n).over(w)
    fall = (F.col("metric") <= back(1)) & (back(1) <= back(2))
    return P.history(spark, d).select("task", "iteration", F.coalesce(fall, F.lit(False)).alias("decline"))


@query(HQ.TREND + "SELECT task, iteration, duration FROM trend")
def w8_trend_durations(spark, d):
    return H.trends(P.history(spark, d)).select("task", "iteration", "duration")


@query(HQ.TREND + "SELECT task, iteration, round(convergence, 9) AS convergence FROM trend")
def w9_convergence(spark, d):
    return rounded(H.trends(P.history(spark, d)).select("task", "iteration", "convergence"), "convergence", places=9)


@query(HQ.TREND + "SELECT task, iteration, action FROM trend")
def w11_actions(spark, d):
    return H.trends(P.history(spark, d)).select("task", "iteration", "action")


@query(HQ.SIGNALS + "SELECT task, iteration, round(cp, 9) AS context_penalty FROM sig")
def w6_context_penalty(spark, d):
    h = HQ.strategies(spark, d)
    s = H.reward_signals(h.join(H.strategy_distance(h), ["task", "iteration"]), F.col("distance"))
    return rounded(s.select("task", "iteration", "context_penalty"), "context_penalty", places=9)


@query(HQ.WEIGHTS + "SELECT task, edge_type, raw FROM mm")
def w17_single_weights(spark, d):
    return rounded(H.edge_weights(HQ.effects(spark, d)).select("task", "edge_type", "raw"), "raw", places=9)


@query(HQ.REWARDS + "SELECT task, iteration, plateau_duration FROM rewards")
def w2a_plateau_durations(spark, d):
    return H.gated_rewards(P.history(spark, d)).select("task", "iteration", "plateau_duration")


@query(HQ.TREND + f", s AS (SELECT task, direction, min(iteration) AS first, max(iteration) AS last FROM trend GROUP BY task, direction, island) SELECT task, 'iterations ' || first || '-' || last AS label, direction FROM s")
def w8a_window_labels(spark, d):
    """Each run of one direction with the iterations that it spans."""
    t = H.trends(P.history(spark, d))
    w = Window.partitionBy("task").orderBy("iteration")
    turn = F.when(F.lag("direction").over(w).eqNullSafe(F.col("direction")), 0).otherwise(1)
    t = t.withColumn("turn", turn).withColumn("island", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = t.groupBy("task", "direction", "island").agg(F.min("iteration").cast("string").alias("a"), F.max("iteration").cast("string").alias("b"))
    return s.select("task", F.concat(F.lit("iterations "), "a", F.lit("-"), "b").alias("label"), "direction")


def _score_sql(name: str) -> str:
    return SCORED + f"SELECT center, neighbor, round({name}, 9) AS {name} FROM scores"


def _score(spark, d, name: str):
    return rounded(scores(spark, d).select("center", "neighbor", name), name, places=9)


@query(_score_sql("structural"))
def m1_structural(spark, d):
    return _score(spark, d, "structural")


@query(_score_sql("task_relevance"))
def m2_task_relevance(spark, d):
    return _score(spark, d, "task_relevance")


@query(_score_sql("semantic"))
def m3_semantic(spark, d):
    return _score(spark, d, "semantic")


@query(_score_sql("confidence"))
def m5_confidence(spark, d):
    return _score(spark, d, "confidence")


# ---- policies, reports, contexts, counts


_POLICY = """WITH p AS (SELECT event_id AS id, '{"mode": "' || (['top_k', 'threshold', 'exclude'])[event_id % 3 + 1] || '", "top_k": ' || event_id % 40 || ', "threshold": 0.' || event_id % 7 ||
  ', "exclude_neighbors": ["P' || event_id % 9 || '", "P1"], "more": 1' || CASE WHEN event_id % 2 = 0 THEN ', "reason": "r' || event_id % 5 || '"' ELSE '' END || '}' AS j FROM events) """


def _policies(spark, d):
    k = F.col("event_id")
    text = lambda x: x.cast("string")
    mode = F.element_at(Po.array_of(("top_k", "threshold", "exclude")), (k % 3 + 1).cast("int"))
    j = F.concat(
        F.lit('{"mode": "'), mode, F.lit('", "top_k": '), text(k % 40), F.lit(', "threshold": 0.'), text(k % 7), F.lit(', "exclude_neighbors": ["P'), text(k % 9), F.lit('", "P1"], "more": 1'),
        F.when(k % 2 == 0, F.concat(F.lit(', "reason": "r'), text(k % 5), F.lit('"'))).otherwise(""), F.lit("}"),
    )
    return P.table(spark, d, "events").select(k.alias("id"), j.alias("j"))


@query(_POLICY + """SELECT id, json_extract_string(j, '$.mode') AS mode, cast(json_extract(j, '$.top_k') AS bigint) AS top_k, cast(json_extract(j, '$.threshold') AS double) AS threshold,
  array_to_string(json_extract_string(j, '$.exclude_neighbors[*]'), ',') AS excluded, json_extract_string(j, '$.reason') AS reason FROM p""")
def r139_policy_from_json(spark, d):
    p = Po.policy_record(F.col("j"))
    return _policies(spark, d).select("id", p["mode"].alias("mode"), p["top_k"].alias("top_k"), p["threshold"].alias("threshold"), F.array_join(p["exclude_neighbors"], ",").alias("excluded"), p["reason"].alias("reason"))


@query(_POLICY + """SELECT id, '{"mode":"' || json_extract_string(j, '$.mode') || '","top_k":' || json_extract_string(j, '$.top_k') || ',"threshold":' || json_extract_string(j, '$.threshold')
  || ',"exclude_neighbors":["' || array_to_string(json_extract_string(j, '$.exclude_neighbors[*]'), '","') || '"],"per_edge_type":null,"reason":' ||
  coalesce('"' || json_extract_string(j, '$.reason') || '"', 'null') || '}' AS json FROM p""")
def r138_policy_json(spark, d):
    return _policies(spark, d).select("id", Po.policy_json(Po.policy_record(F.col("j"))).alias("json"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'retain_all' ELSE 'top_k' END AS mode, event_id % 40 AS top_k, CASE WHEN event_id % 2 = 0 THEN event_id % 11 END AS ppi, 'why ' ||
  event_id % 6 AS reason FROM events""")
def r140_policy_of_strategy(spark, d):
    k, text = F.col("event_id"), lambda x: x.cast("string")
    j = F.concat(F.when(k % 3 == 0, "{").otherwise('{"neighbor_selection_mode": "top_k", '), F.lit('"top_k": '), text(k % 40), F.when(k % 2 == 0, F.concat(F.lit(', "neighbors_per_type": {"PPI": '), text(k % 11), F.lit("}"))).otherwise(""), F.lit(', "max_hops": 2, "neighbor_selection_reason": "why '), text(k % 6), F.lit('"}'))
    p = Po.policy_of_strategy(j)
    return P.table(spark, d, "events").select(k.alias("id"), p["mode"].alias("mode"), p["top_k"].alias("top_k"), F.try_element_at(p["per_edge_type"], F.lit("PPI")).alias("ppi"), p["reason"].alias("reason"))


@query(P.with_sql("history").rstrip() + f""" SELECT task, iteration, '## Experiment ' || iteration || chr(10) || '**Hypothesis**: more ' || edge_type || chr(10) || '**Expected**: up' || chr(10) ||
  '**Result**: ' || CASE WHEN iteration % 3 = 0 THEN 'UNKNOWN' ELSE 'STEADY' END || ' (metric=' || CASE WHEN iteration % 3 = 0 THEN 'N/A' ELSE {XQ.fixed_sql('metric', 4)} END || ', reward=' ||
  CASE WHEN iteration % 3 = 0 THEN 'N/A' ELSE {XQ.fixed_sql('metric / 2.0::double', 4)} END || ')' || chr(10) || '**Analysis**: ' || sampling || chr(10) || '**Strategy**: edge_types=[''' || edge_type ||
  ''', ''GO''], max_neighbors=' || max_neighbors || ', sampling=' || sampling AS report FROM hist""")
def r80_experiment_reports(spark, d):
    known = F.col("iteration") % 3 != 0
    report = Po.experiment_report(
        F.col("iteration"), F.concat(F.lit("more "), "edge_type"), F.lit("up"), F.when(known, "STEADY"), F.when(known, F.col("metric")), F.when(known, F.col("metric") / 2.0),
        F.col("sampling"), F.array("edge_type", F.lit("GO")), F.col("max_neighbors"), F.col("sampling"),
    )
    return P.history(spark, d).select("task", "iteration", report.alias("report"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS sampling, event_id % 50 AS neighbors, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 2 END AS n FROM events""")
def r252_key_features(spark, d):
    k = F.col("event_id")
    j = F.concat(F.lit('{"max_neighbors": '), (k % 50).cast("string"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(', "sampling_method": "'), "event_type", F.lit('"'))), F.lit(', "edge_types": "GO", "max_hops": 2}'))
    m = Po.key_features(j)
    return P.table(spark, d, "events").select(k.alias("id"), F.try_element_at(m, F.lit("sampling_method")).alias("sampling"), F.try_element_at(m, F.lit("max_neighbors")).cast("long").alias("neighbors"), F.size(m).alias("n"))


@query(PQ._task_sql + """, c AS (SELECT CASE r_regionkey WHEN 0 THEN 'ppi' WHEN 1 THEN 'cell' WHEN 2 THEN 'dosage' ELSE 'x' || r_regionkey END AS task, 'Known of ' || r_name AS context FROM region)
  SELECT task, coalesce(context, 'No specific biological context available.') || chr(10) || chr(10) || 'Edges have types.' AS context FROM tk LEFT JOIN c USING (task)""")
def r136_task_contexts(spark, d):
    k = F.col("r_regionkey")
    task = F.when(k == 0, "ppi").when(k == 1, "cell").when(k == 2, "dosage").otherwise(F.concat(F.lit("x"), k.cast("string")))
    contexts = P.table(spark, d, "region").select(task.alias("task"), F.concat(F.lit("Known of "), "r_name").alias("context"))
    return Po.task_context(PQ._tasks(spark, d), contexts, "Edges have types.")


@query(PQ._task_sql + "SELECT task, CASE WHEN auc > 0.25::double THEN auc WHEN f1 > 0.45::double THEN f1 ELSE 0.0::double END AS value FROM tk")
def r169_primary_values(spark, d):
    return PQ._tasks(spark, d).select("task", Po.primary_value(F.when(F.col("auc") > 0.25, F.col("auc")), F.when(F.col("f1") > 0.45, F.col("f1"))).alias("value"))


@query(f"SELECT count(DISTINCT cond) AS num_conditions, count(DISTINCT gene) AS output_dim FROM ({SQL['a9_pseudo_bulk_delta']})")
def r219_perturbation_info(spark, d):
    return T.perturbation_info(XQ.a9_pseudo_bulk_delta(spark, d))


_PAIRS = "SELECT coalesce(sum(n * (n - 1) // 2), 0)::bigint FROM (SELECT count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey)"
_NEXT = """SELECT count(*) FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS nx FROM lineitem) WHERE nx <> l_partkey"""


@query(P.with_sql("all_edges").rstrip() + f""" SELECT edge_type, CASE edge_type WHEN 'PPI' THEN ({_PAIRS}) WHEN 'TRRUST' THEN ({_NEXT}) WHEN 'GO' THEN (SELECT 3 * count(*) FROM part) WHEN 'OMIM' THEN
  (SELECT count(*) FROM part) ELSE (SELECT count(*) FROM lineitem) END AS raw, count(*) AS edges, count(DISTINCT dst) AS nodes FROM edges GROUP BY 1""")
def r35_source_counts(spark, d):
    """What each source has: rows before keys are made unique, edges, and nodes."""
    part, lines = P.table(spark, d, "part"), P.table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    n = F.countDistinct("l_partkey")
    pairs = lines.groupBy("l_orderkey").agg((n * (n - 1) / 2).cast("long").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw"))
    follow = lines.select("l_partkey", F.lead("l_partkey").over(w).alias("nx")).where("nx <> l_partkey").agg(F.count("*").alias("raw"))
    rows = lines.agg(F.count("*").alias("raw"))
    raw = {"PPI": pairs, "TRRUST": follow, "GO": part.agg((F.count("*") * 3).alias("raw")), "OMIM": part.agg(F.count("*").alias("raw"))} | {t: rows for t in ("HPO", "CellMarker", "Reactome", "GTEx", "CORUM")}
    out = None
    for t, one in raw.items():
        own = one.select(F.lit(t).alias("edge_type"), "raw")
        out = own if out is None else out.unionByName(own)
    kept = P.edges(spark, d, P.ALL_TYPES).groupBy("edge_type").agg(F.count("*").alias("edges"), F.countDistinct("dst").alias("nodes"))
    return kept.join(F.broadcast(out), "edge_type")  # a row for each type
