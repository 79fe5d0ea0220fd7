"""Queries of strategies, advice and further evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import adaptive as Ad
from graphloom.operators import evaluation as E
from graphloom.operators import history as H
from graphloom.operators import scoring
from graphloom.operators import strategy as St
from graphloom.plans import history_queries as HQ
from graphloom.plans import projection as P
from graphloom.plans.projection import with_sql
from graphloom.plans.queries import SCORED, query, rounded, scores

#: Responses by event: JSON with values in and out of bounds, fenced or not, or
#: plain words.
RESP = """WITH resp AS (SELECT event_id, event_id % 40 AS h, event_id % 457 AS n, CASE event_id % 5 WHEN 0 THEN 'TRRUST' WHEN 1 THEN 'XX' ELSE 'GO' END AS t,
  event_id % 3 AS form FROM events)"""


def responses(spark, d):
    e = P.table(spark, d, "events")
    h, n = (F.col("event_id") % 40).cast("string"), (F.col("event_id") % 457).cast("string")
    t = F.when(F.col("event_id") % 5 == 0, "TRRUST").when(F.col("event_id") % 5 == 1, "XX").otherwise("GO")
    body = F.concat(F.lit('{"edge_types": ["'), t, F.lit('"], "max_hops": '), h, F.lit(', "max_neighbors": '), n, F.lit(', "sampling": "Weighted"}'))
    form = F.col("event_id") % 3
    text = F.when(form == 0, F.concat(F.lit("I choose\n```json\n"), body, F.lit("\n``` done"))).when(form == 1, F.concat(F.lit("so: "), body)).otherwise(F.concat(F.lit("use "), t, F.lit(" with "), h, F.lit("-hop walks, "), n, F.lit(" neighbors at random")))
    return e.select("event_id", text.alias("text"))


@query(RESP + """ SELECT event_id, CASE WHEN t = 'XX' THEN 'PPI,GO,HPO' ELSE t END AS edge_types, greatest(1, least(3, h))::int AS max_hops, greatest(10, least(200,
  n))::int AS max_neighbors, CASE WHEN form = 2 THEN 'random' ELSE 'weighted' END AS sampling FROM resp""")
def x23_strategy_from_response(spark, d):
    s = responses(spark, d).withColumn("s", St.from_response(F.col("text")))
    return s.select("event_id", F.array_join("s.edge_types", ",").alias("edge_types"), "s.max_hops", "s.max_neighbors", "s.sampling")


@query("""SELECT doc_id, array_to_string(list_concat(['ppi_info', 'go_info', 'phenotype_info'], list_filter([CASE WHEN regexp_matches(lower(w),
  'regulat|transcript|tf|expression') THEN 'tf_info' END, CASE WHEN regexp_matches(lower(w), 'pathway|reactome|signal') THEN 'pathway_info' END, CASE
  WHEN regexp_matches(lower(w), 'cell|tissue|expression|marker') THEN 'celltype_info' END], lambda x: x IS NOT NULL)), ',') AS features FROM (SELECT
  doc_id, (['Signal', 'gene expression', 'none', 'cell TF'])[doc_id % 4 + 1] AS w FROM documents)""")
def x16_features_from_keywords(spark, d):
    w = F.element_at(F.array(*[F.lit(x) for x in ("Signal", "gene expression", "none", "cell TF")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return P.table(spark, d, "documents").select("doc_id", F.array_join(St.features_from_keywords(F.array(w)), ",").alias("features"))


@query(HQ.IMP + """, sc AS (SELECT task, edge_type AS edge_types, round(max(delta), 9) AS improvement FROM imp WHERE delta > 0 GROUP BY 1, 2), s AS (SELECT *, task % 10
  AS family, row_number() OVER (PARTITION BY task ORDER BY improvement DESC, edge_types) AS r FROM sc),
c AS (SELECT task AS for_task, task % 10 AS f, edge_type AS now FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY iteration DESC) AS r
  FROM hist) WHERE r = 1), top AS (SELECT * FROM s WHERE r = 1),
u AS (SELECT for_task, 'same_task' AS source, task, edge_types, improvement, now FROM s JOIN c ON task = for_task WHERE r <= 3 UNION ALL SELECT
  for_task, 'similar_task', task, edge_types, improvement, now FROM s JOIN c ON family = f AND task <> for_task WHERE r <= 2 UNION ALL SELECT
  for_task, 'best_from', task, edge_types, improvement, now FROM top, c WHERE task <> for_task),
k AS (SELECT *, row_number() OVER (PARTITION BY for_task ORDER BY improvement DESC, source, task, edge_types) AS rank FROM u WHERE edge_types <> now)
  SELECT for_task, source, task, edge_types, improvement, rank FROM k WHERE rank <= 3""")
def t11_memory_suggestions(spark, d):
    h = P.history(spark, d)
    s = H.improvements(h).where("delta > 0").groupBy("task", F.col("edge_type").alias("edge_types")).agg(F.round(F.max("delta"), 9).alias("improvement")).withColumn("family", F.col("task") % 10)
    now = h.groupBy("task").agg(F.max_by("edge_type", "iteration").alias("edge_types")).withColumn("family", F.col("task") % 10)
    return St.suggestions(s, now)


@query(HQ.HIST.rstrip() + f""", k AS (SELECT task, iteration, {HQ.KEY} AS strategy, metric FROM hist), p AS (SELECT task, strategy, count(*) AS n, avg(metric) AS mean FROM k GROUP
  BY 1, 2), u AS (SELECT task, strategy, round(mean + sqrt(ln(greatest(sum(n) OVER (PARTITION BY task), 2)::double) / n) * 1.414::double, 9) AS ucb
  FROM p), b AS (SELECT *, max(ucb) OVER (PARTITION BY task) AS best FROM u), l AS (SELECT task, strategy FROM (SELECT *, row_number() OVER (PARTITION
  BY task ORDER BY iteration DESC) AS r FROM k) WHERE r = 1) SELECT task, strategy, best > ucb AS explore FROM b JOIN l USING (task, strategy)""")
def w32_ucb_decision(spark, d):
    k = HQ.strategies(spark, d).withColumn("strategy", H.strategy_key(F.col("edge_types"), F.col("max_hops"), F.col("max_neighbors"), F.col("sampling")))
    u = H.ucb(k, ["task", "strategy"], "metric").withColumn("ucb", F.round("ucb", 9))
    best = u.groupBy("task").agg(F.max("ucb").alias("best"))
    now = k.groupBy("task").agg(F.max_by("strategy", "iteration").alias("strategy"))
    return u.join(best, "task").join(now, ["task", "strategy"]).select("task", "strategy", (F.col("best") > F.col("ucb")).alias("explore"))


@query(HQ.TREND + """, o AS (SELECT task, list(direction ORDER BY iteration) AS d FROM trend GROUP BY 1), f AS (SELECT task, len(d) AS iterations,
  list_reduce(list_transform(d, lambda t: {'t': t, 'b': 0.1::double, 'r': 0.1::double, 'w': 0.8::double}), lambda a, x: (
 {'t': x.t, 'b': CASE x.t WHEN 'improving' THEN a.b + (0.1::double - a.b) * 0.3::double ELSE a.b END / (CASE x.t WHEN 'improving' THEN a.b + (0.1::double - a.b) * 0.3::double ELSE a.b END + CASE x.t WHEN 'plateau' THEN least(0.7::double, a.r + 0.05::double) WHEN 'declining' THEN greatest(0.3::double, a.r - 0.02::double) WHEN 'improving' THEN a.r + (0.1::double - a.r) * 0.3::double ELSE a.r END + CASE x.t WHEN 'declining' THEN least(0.4::double, a.w + 0.03::double) WHEN 'improving' THEN a.w + (0.8::double - a.w) * 0.3::double ELSE a.w END),
  'r': CASE x.t WHEN 'plateau' THEN least(0.7::double, a.r + 0.05::double) WHEN 'declining' THEN greatest(0.3::double, a.r - 0.02::double) WHEN 'improving' THEN a.r + (0.1::double - a.r) * 0.3::double ELSE a.r END / (CASE x.t WHEN 'improving' THEN a.b + (0.1::double - a.b) * 0.3::double ELSE a.b END + CASE x.t WHEN 'plateau' THEN least(0.7::double, a.r + 0.05::double) WHEN 'declining' THEN greatest(0.3::double, a.r - 0.02::double) WHEN 'improving' THEN a.r + (0.1::double - a.r) * 0.3::double ELSE a.r END + CASE x.t WHEN 'declining' THEN least(0.4::double, a.w + 0.03::double) WHEN 'improving' THEN a.w + (0.8::double - a.w) * 0.3::double ELSE a.w END),
  'w': CASE x.t WHEN 'declining' THEN least(0.4::double, a.w + 0.03::double) WHEN 'improving' THEN a.w + (0.8::double - a.w) * 0.3::double ELSE a.w END / (CASE x.t WHEN 'improving' THEN a.b + (0.1::double - a.b) * 0.3::double ELSE a.b END + CASE x.t WHEN 'plateau' THEN least(0.7::double, a.r + 0.05::double) WHEN 'declining' THEN greatest(0.3::double, a.r - 0.02::double) WHEN 'improving' THEN a.r + (0.1::double - a.r) * 0.3::double ELSE a.r END + CASE x.t WHEN 'declining' THEN least(0.4::double, a.w + 0.03::double) WHEN 'improving' THEN a.w + (0.8::double - a.w) * 0.3::double ELSE a.w END)}))
  AS s FROM o)
SELECT task, iterations, round(s.b, 6) AS baseline, round(s.r, 6) AS relative, round(s.w, 6) AS raw FROM f""")
def w41_adapted_weights(spark, d):
    return rounded(St.adapted_weights(H.trends(P.history(spark, d))), "baseline", "relative", "raw")


@query(HQ.SIGNALS.rstrip() + f""", pm AS (SELECT task, iteration, row_number() {HQ.W}) >= 3 AND coalesce(max_neighbors > lag(max_neighbors, 2) {HQ.W}) * 1.2::double AND max(metric)
  {HQ.W} ROWS 2 PRECEDING) <= lag(metric, 2) {HQ.W}) * 1.02::double, false) AS prune FROM hist) SELECT task, iteration, CASE WHEN prune AND state <>
  'breakthrough' THEN 'PRUNE' WHEN state = 'breakthrough' THEN 'FINE_TUNE' WHEN state = 'stagnation' THEN 'HIGH_ENTROPY' ELSE 'ANALYZE_AND_PIVOT' END
  AS mode FROM sig JOIN pm USING (task, iteration)""")
def w44_thinking_mode(spark, d):
    h = HQ.strategies(spark, d)
    sig = H.reward_signals(h.join(H.strategy_distance(h), ["task", "iteration"]), F.col("distance"))
    return sig.join(H.prune_mode(h), ["task", "iteration"]).select("task", "iteration", St.thinking_mode(F.col("state"), F.col("prune")).alias("mode"))


@query(HQ.REWARDS + """, a AS (SELECT task, iteration, round(reward, 9) AS reward FROM rewards), b AS (SELECT *, max(reward) OVER (PARTITION BY task) AS best, row_number()
  OVER (PARTITION BY task ORDER BY iteration DESC) AS back FROM a), c AS (SELECT *, best <= 0 OR reward >= best * 0.99::double AS good FROM b), e AS
  (SELECT *, max(good::int) OVER (PARTITION BY task) AS n_good FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY iteration DESC) AS b2 FROM e WHERE good OR (n_good = 0 AND back <= 2)), g AS (SELECT *,
  reward - lag(reward) OVER (PARTITION BY task ORDER BY iteration) AS d FROM f WHERE b2 <= 3)
SELECT task, iteration, reward, CASE WHEN d IS NULL THEN 'BASELINE' WHEN d > 0 THEN 'EFFECTIVE' WHEN d < 0 THEN 'INEFFECTIVE' ELSE 'NEUTRAL' END AS
  effect FROM g""")
def w49_prompt_history(spark, d):
    r = H.gated_rewards(P.history(spark, d)).select("task", "iteration", F.round("reward", 9).alias("reward"))
    return St.prompt_history(r)


@query(HQ.WEIGHTS + """, w AS (SELECT task, edge_type, CASE WHEN hi > lo THEN round(pow((raw - lo) / (hi - lo), 0.7::double) * 0.95::double + 0.05::double, 3) ELSE
  0.5::double END AS weight FROM mm) SELECT task, edge_type, CASE WHEN weight >= 0.8 THEN 'RECOMMENDED' WHEN weight >= 0.6 THEN 'useful' WHEN weight
  <= 0.3 THEN 'discouraged' WHEN weight <= 0.5 THEN 'neutral' ELSE '' END AS band FROM w""")
def x30_weight_bands(spark, d):
    return H.edge_weights(HQ.effects(spark, d)).select("task", "edge_type", St.weight_band(F.col("weight")).alias("band"))


@query(SCORED + """, b AS (SELECT edge_type, count(*) AS n, count(*) FILTER (WHERE total < 0.4) AS l FROM scores GROUP BY 1) SELECT edge_type, edge_type || ' has ' ||
  printf('%.0f', l / n * 100) || '% low-relevance neighbors -> consider reducing or removing' AS advice FROM b WHERE l / n > 0.5 AND n >= 10""")
def x22_recommendations(spark, d):
    return St.recommendations(scoring.neighbor_stats(scores(spark, d))[0])


@query(SCORED + """, b AS (SELECT *, CASE WHEN total >= 0.7 THEN 'high' WHEN total >= 0.4 THEN 'medium' ELSE 'low' END AS band FROM scores), r AS (SELECT *, row_number()
  OVER (PARTITION BY center, band ORDER BY total DESC, neighbor) AS r, count(*) OVER (PARTITION BY center, band) AS n FROM b)
SELECT center, band, max(n) AS n, string_agg(neighbor || ' (' || edge_type || ')', ', ' ORDER BY r) AS best FROM r WHERE r <= 5 GROUP BY 1, 2""")
def x19_presenter_summary(spark, d):
    s = scoring.by_relevance(scores(spark, d)).withColumn("n", F.count("*").over(Window.partitionBy("center", "band"))).where("rank <= 5")
    g = s.groupBy("center", "band").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("rank", F.concat("neighbor", F.lit(" ("), "edge_type", F.lit(")")).alias("t")))).alias("l"))
    return g.select("center", "band", "n", F.array_join(F.transform("l", lambda x: x["t"]), ", ").alias("best"))


@query(SCORED + """, l AS (SELECT neighbor, center, total FROM scores WHERE total < 0.4 ORDER BY total, neighbor, center LIMIT 5) SELECT (SELECT count(*) FROM scores) AS
  total, (SELECT count(*) FROM scores WHERE total >= 0.7) AS high, (SELECT count(*) FROM scores WHERE total < 0.4) AS low, (SELECT
  string_agg(neighbor, ',' ORDER BY total, neighbor, center) FROM l) AS lowest""")
def a16_selection_guidance(spark, d):
    s = scores(spark, d)
    n = s.agg(F.count("*").alias("total"), F.count_if(F.col("total") >= 0.7).alias("high"), F.count_if(F.col("total") < 0.4).alias("low"))
    low = s.where("total < 0.4").orderBy("total", "neighbor", "center").limit(5).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("total", "neighbor", "center"))), lambda x: x["neighbor"]), ",").alias("lowest"))
    return n.crossJoin(low).withColumn("lowest", F.nullif("lowest", F.lit("")))  # one row each


@query(HQ.HIST.rstrip() + """, l AS (SELECT metric, unnest(['sampling', 'max_hops', 'edge_type']) AS param, unnest([sampling, cast(max_hops AS varchar), edge_type]) AS value FROM
  hist), v AS (SELECT param, value, count(*) AS n, avg(metric) AS m FROM l GROUP BY 1, 2), o AS (SELECT *, avg(m) OVER (PARTITION BY param) AS
  overall, row_number() OVER (PARTITION BY param ORDER BY round(m, 9) DESC, value) AS r FROM v) SELECT param, value, n, r = 1 AS best, n >= 2 AND m <
  overall - 0.05 AS poor FROM o""")
def a13_historical_facts(spark, d):
    v = H.parameter_stats(P.history(spark, d), ["sampling", "max_hops", "edge_type"])
    w = Window.partitionBy("param")
    r = F.row_number().over(w.orderBy(F.desc(F.round("avg_metric", 9)), "value"))
    return v.withColumn("o", F.avg("avg_metric").over(w)).withColumn("r", r).select("param", "value", "n", (F.col("r") == 1).alias("best"), ((F.col("n") >= 2) & (F.col("avg_metric") < F.col("o") - 0.05)).alias("poor"))


@query(HQ.SIGNALS.rstrip() + """, j AS (SELECT h.* FROM sig JOIN hist h USING (task, iteration) WHERE state = 'exploration_failure'), l AS (SELECT unnest(['sampling', 'max_hops',
  'edge_type']) AS param, unnest([sampling, cast(max_hops AS varchar), edge_type]) AS value FROM j), c AS (SELECT param, value, count(*) AS n FROM l
  GROUP BY 1, 2) SELECT param, value, n FROM c WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY param ORDER BY n DESC, value) <= 2""")
def a14_failure_patterns(spark, d):
    h = HQ.strategies(spark, d)
    sig = H.reward_signals(h.join(H.strategy_distance(h), ["task", "iteration"]), F.col("distance")).where("state = 'exploration_failure'").select("task", "iteration")
    v = H.parameter_stats(h.join(sig, ["task", "iteration"], "left_semi"), ["sampling", "max_hops", "edge_type"]).where("n >= 2")
    w = Window.partitionBy("param").orderBy(F.desc("n"), "value")
    return v.withColumn("r", F.row_number().over(w)).where("r <= 2").select("param", "value", "n")


@query(with_sql("emb") + """, p AS (SELECT a.id, a.label AS own, b.label AS other, avg(list_distance(a.emb, b.emb)) AS m FROM emb a JOIN emb b ON a.id <> b.id GROUP BY 1, 2, 3),
  s AS (SELECT id, max(m) FILTER (WHERE own = other) AS a, min(m) FILTER (WHERE own <> other) AS b FROM p GROUP BY 1) SELECT round(avg(CASE WHEN a IS
  NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""".replace("emb\n,", "emb,"))
def e10_silhouette(spark, d):
    return rounded(E.silhouette(P.embeddings(spark, d), "label", "emb"), "silhouette")


@query(with_sql("emb").rstrip() + """, lg AS (SELECT id, label, unnest(emb) AS x, generate_subscripts(emb, 1) AS dim FROM emb), c AS (SELECT label, dim, avg(x) AS c FROM lg GROUP BY 1,
  2), d AS (SELECT id, label, sqrt(sum((x - c) ** 2)) AS d FROM lg JOIN c USING (label, dim) GROUP BY 1, 2), w AS (SELECT label, avg(d) AS s FROM d
  GROUP BY 1), r AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.c - b.c) ** 2)) AS g FROM c a JOIN c b ON a.dim = b.dim AND a.label <> b.label
  GROUP BY 1, 2), m AS (SELECT i, max((x.s + y.s) / g) AS r FROM r JOIN w x ON x.label = i JOIN w y ON y.label = j GROUP BY 1) SELECT round(avg(r), 6)
  AS davies_bouldin FROM m""")
def e10_davies_bouldin(spark, d):
    return rounded(E.davies_bouldin(P.embeddings(spark, d), "label", "emb"), "davies_bouldin")


@query(with_sql("emb").rstrip() + """, q AS (SELECT id AS query_id, emb AS q FROM emb WHERE cast(substr(id, 2) AS bigint) % 100 = 0), n AS (SELECT query_id, id, label, sqrt(greatest(0, 2
  - 2 * round(list_cosine_similarity(emb, q), 9))) AS d, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(emb, q), 9)
  DESC, id) AS r FROM emb, q WHERE id <> query_id) SELECT query_id, round(sum(label / d) / sum(1 / d), 6) AS predicted FROM n WHERE r <= 5 GROUP BY 1""")
def e2_knn_regression(spark, d):
    from graphloom.operators import retrieval as V

    unit = V.normalised(P.embeddings(spark, d))
    queries = unit.where(F.substring("id", 2, 20).cast("long") % 100 == 0).select(F.col("id").alias("query_id"), F.col("emb").alias("q_emb"))
    near = V.filtered(V.top_k(queries, unit.select("id", "emb"), 6), 5, F.col("id") != F.col("query_id"))
    near = near.select("query_id", "id", F.sqrt(F.greatest(F.lit(0.0), 2 - F.col("score") * 2)).alias("distance"))
    return rounded(E.knn_regression(near, unit.select("id", F.col("label").cast("double").alias("y"))), "predicted")


#: Trends of the history, by the change from the iteration before.
_TREND = """CASE WHEN d IS NULL THEN 'unknown' WHEN d > 0.2::double THEN 'improving' WHEN d < -0.2::double THEN 'declining' WHEN abs(d) < 0.05::double THEN 'plateau' ELSE 'oscillating' END"""
_ON = "iteration >= 3 AND iteration - changed >= 2 AND trend <> 'unknown'"


@query(with_sql("history").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f""", t AS (SELECT task, iteration, {_TREND} AS trend FROM (SELECT *, metric - lag(metric) OVER (PARTITION BY task
  ORDER BY iteration) AS d FROM hist)),
r AS (SELECT task, 0::bigint AS iteration, 0.1::double AS baseline, 0.1::double AS relative, 0.8::double AS raw, 0.0::double AS bonus, -0.05::double AS plateau, 0::bigint AS changed
  FROM (SELECT DISTINCT task FROM t)
UNION ALL SELECT task, iteration, b / s, r / s, w / s, bonus, plateau, changed FROM (SELECT *, CASE WHEN act THEN b + r + w ELSE 1 END AS s FROM (SELECT task, iteration, act,
  CASE WHEN act AND trend = 'oscillating' THEN least(0.5::double, baseline + 0.04::double) WHEN act AND trend = 'improving' THEN baseline + 0.3::double * (0.1::double - baseline) ELSE baseline END AS b,
  CASE WHEN act AND trend = 'plateau' THEN least(0.7::double, relative + 0.05::double) WHEN act AND trend = 'declining' THEN greatest(0.3::double, relative - 0.02::double)
    WHEN act AND trend = 'improving' THEN relative + 0.3::double * (0.1::double - relative) ELSE relative END AS r,
  CASE WHEN act AND trend = 'declining' THEN least(0.4::double, raw + 0.03::double) WHEN act AND trend = 'improving' THEN raw + 0.3::double * (0.8::double - raw) ELSE raw END AS w,
  CASE WHEN act AND trend = 'plateau' THEN least(0.2::double, bonus + 0.03::double) WHEN act AND trend = 'oscillating' THEN greatest(0.05::double, bonus - 0.02::double) ELSE bonus END AS bonus,
  CASE WHEN act AND trend = 'plateau' THEN greatest(-0.05::double, plateau - 0.01::double) ELSE plateau END AS plateau,
  CASE WHEN act THEN iteration ELSE changed END AS changed
  FROM (SELECT t.task, t.iteration, t.trend, r.* EXCLUDE (task, iteration), ({_ON.replace("iteration", "t.iteration")}) AS act FROM r JOIN t ON t.task = r.task AND t.iteration = r.iteration + 1))))
SELECT task, iteration, """ + ", ".join(f"round({c}, 9) AS {c}" for c in Ad.NAMES) + " FROM r WHERE iteration > 0")
def r15_adaptive_weights(spark, d):
    h = P.history(spark, d)
    change = F.col("metric") - F.lag("metric").over(Window.partitionBy("task").orderBy("iteration"))
    trend = F.when(F.col("d").isNull(), "unknown").when(F.col("d") > 0.2, "improving").when(F.col("d") < -0.2, "declining").when(F.abs("d") < 0.05, "plateau").otherwise("oscillating")
    return rounded(Ad.adapted(h.withColumn("d", change).withColumn("trend", trend)), *Ad.NAMES, places=9).drop("state")
