"""Queries over experiment histories, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import history as H
from graphloom.plans import projection as P
from graphloom.plans.projection import with_sql
from graphloom.plans.queries import query, rounded, scaled

HIST = with_sql("history")
W = "OVER (PARTITION BY task ORDER BY iteration"

ABS = """CASE WHEN metric > 0.8::double THEN least(1.0::double, metric * 2 - 1 + (metric - 0.8::double) * (metric - 0.8::double) * 5) ELSE
  greatest(-1.0::double, least(1.0::double, metric * 2 - 1)) END"""

REWARDS = HIST.rstrip() + f""",
h AS (SELECT *, row_number() {W}) - 1 AS n, lag(metric) {W}) AS previous, max(metric) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS
  best_before, stddev_pop(metric) {W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS std FROM hist),
h2 AS (SELECT *, best_before IS NULL OR metric > best_before AS improved, metric - previous AS delta, greatest(previous, 0.01::double) * 0.01::double
  AS thr FROM h),
h3 AS (SELECT *, n >= 2 AND abs(delta) < thr AS small, CASE WHEN n >= 2 AND abs(delta) < thr AND std < thr * 1.5::double THEN 1 ELSE 0 END AS inc FROM
  h2),
h4 AS (SELECT *, sum(CASE WHEN n = 0 THEN 1 WHEN small THEN 1 - inc WHEN improved THEN 1 ELSE 0 END) {W} ROWS UNBOUNDED PRECEDING) AS island FROM h3),
h5 AS (SELECT *, cast(sum(inc) OVER (PARTITION BY task, island ORDER BY iteration ROWS UNBOUNDED PRECEDING) AS bigint) AS plateau_duration, {ABS} AS a
  FROM h4),
h6 AS (SELECT *, CASE WHEN improved THEN a ELSE a * 0.1::double END AS absolute, CASE WHEN inc = 1 THEN greatest(-0.3::double, (plateau_duration *
  0.3::double + 1) * -0.05::double) ELSE 0.0::double END AS pl,
  CASE WHEN improved THEN 0.0::double ELSE greatest(-0.6::double, least(0.0::double, -0.3::double - (best_before - metric) * 2.0::double)) END AS pen
  FROM h5),
h7 AS (SELECT *, greatest(-1.0::double, least(1.0::double, delta)) * 0.1::double + absolute * 0.8::double + greatest(-1.0::double, least(1.0::double,
  metric - best_before)) * 0.1::double + pl + pen AS t FROM h6),
rewards AS (SELECT task, iteration, metric, improved, plateau_duration, absolute, greatest(-1.0::double, least(1.0::double, CASE WHEN n = 0 THEN a *
  0.8::double WHEN improved THEN t ELSE least(t, -0.2::double) END)) AS reward FROM h7)
"""


@query(HIST + f"SELECT task, iteration, round({ABS}, 6) AS reward FROM hist")
def w1_absolute_reward(spark, d):
    return P.history(spark, d).select("task", "iteration", F.round(H.absolute_reward(F.col("metric")), 6).alias("reward"))


@query(REWARDS + "SELECT task, iteration, improved, plateau_duration, round(absolute, 11) AS absolute, round(reward, 11) AS reward FROM rewards")
def w2_gated_rewards(spark, d):
    return rounded(H.gated_rewards(P.history(spark, d)), "absolute", "reward", places=11).drop("metric")


@query(REWARDS + f""", g AS (SELECT *, row_number() {W}) - 1 AS k FROM rewards) SELECT task, round(sum(pow(0.99::double, k) * reward), 6) AS discounted_return, count(*) AS
  n FROM g GROUP BY 1""")
def w3_discounted_return(spark, d):
    return rounded(H.discounted_return(H.gated_rewards(P.history(spark, d))), "discounted_return")


DIST = HIST.rstrip() + f""",
dh AS (SELECT *, lag(edge_type) {W}) AS pe, lag(max_neighbors) {W}) AS pn, lag(max_hops) {W}) AS ph, lag(sampling) {W}) AS ps FROM hist),
dist AS (SELECT task, iteration, metric, max_neighbors, pn, CASE WHEN pn IS NULL THEN 1.0::double ELSE greatest(0.0::double, least(1.0::double, CASE
  WHEN edge_type = pe THEN 0.0::double ELSE 1.0::double END * 0.3::double
  + least(abs(max_neighbors - pn) / 190.0::double, 1.0::double) * 0.2::double + abs(max_hops - ph) / 2.0::double * 0.15::double
  + abs(list_position(['top_k','random','weighted'], sampling) - list_position(['top_k','random','weighted'], ps)) / 2.0::double * 0.15::double)) END
  AS distance FROM dh)
"""


def strategies(spark, d):
    return P.history(spark, d).withColumn("edge_types", F.array("edge_type"))


@query(DIST + "SELECT task, iteration, round(distance, 6) AS distance FROM dist")
def w43_strategy_distance(spark, d):
    return rounded(H.strategy_distance(strategies(spark, d)), "distance")


SIGNALS = DIST.rstrip() + f""",
sb AS (SELECT *, coalesce(max(metric) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), metric) AS best FROM dist),
sg AS (SELECT *, metric - best AS delta, CASE WHEN pn > 0 AND (max_neighbors - pn) / pn::double > 0.2::double AND metric - best <= 0.005::double THEN
  least((max_neighbors - pn) / pn::double * 0.1::double, 0.15::double) ELSE 0.0::double END AS cp FROM sb),
sig AS (SELECT *, CASE WHEN delta > 0 THEN 'breakthrough' WHEN distance < 0.2::double THEN 'stagnation' ELSE 'exploration_failure' END AS state,
  CASE WHEN delta > 0 THEN 0.0::double WHEN distance < 0.2::double THEN (1 - distance) * 0.15::double ELSE (1 - distance) * 0.15::double * 0.5::double
  END AS cost, tanh(delta / 0.05::double) AS utility FROM sg)
"""


@query(SIGNALS + """SELECT task, iteration, state, round(utility, 6) AS utility, round(cost, 6) AS exploration_cost, round(cp, 6) AS context_penalty,
  round(greatest(-1.0::double, least(1.0::double, CASE WHEN delta > 0 THEN utility ELSE utility - cost - cp END)), 6) AS signal FROM sig""")
def w5_reward_signal(spark, d):
    h = strategies(spark, d)
    h = h.join(H.strategy_distance(h), ["task", "iteration"])
    return rounded(H.reward_signals(h, F.col("distance")), "utility", "exploration_cost", "context_penalty", "signal")


TREND = HIST.rstrip() + f""",
t0 AS (SELECT *, row_number() {W}) AS n, (metric - lag(metric, 2) {W})) / 2.0::double AS slope, var_pop(metric) {W} ROWS 2 PRECEDING) AS var,
  max(metric) {W} ROWS 2 PRECEDING) AS top FROM hist),
t1 AS (SELECT *, CASE WHEN n < 3 THEN 'unknown' WHEN var < 0.005::double THEN 'plateau' WHEN slope > 0.01::double THEN 'improving' WHEN slope <
  -0.01::double THEN 'declining' ELSE 'plateau' END AS direction,
  CASE WHEN n < 3 THEN 0.0::double WHEN var < 0.005::double THEN 1 - var / 0.005::double WHEN abs(slope) > 0.01::double THEN least(1.0::double,
  abs(slope) / 0.05::double) ELSE 0.5::double END AS strength FROM t0),
t2 AS (SELECT *, CASE WHEN lag(direction) {W}) IS NOT DISTINCT FROM direction THEN 0 ELSE 1 END AS turn FROM t1),
t3 AS (SELECT *, sum(turn) {W} ROWS UNBOUNDED PRECEDING) AS island FROM t2),
t4 AS (SELECT *, CASE WHEN n >= 3 THEN row_number() OVER (PARTITION BY task, island ORDER BY iteration) ELSE 0 END AS duration,
  CASE WHEN n >= 3 THEN greatest(0.0::double, 1 - var / 0.05::double) * 0.4::double + greatest(0.0::double, 1 - abs(slope) / 0.01::double) *
  0.3::double + top * 0.3::double ELSE 0.0::double END AS convergence FROM t3),
trend AS (SELECT *, CASE WHEN n < 3 THEN 'explore' WHEN convergence > 0.8::double THEN 'exploit' WHEN direction = 'improving' AND strength >
  0.7::double THEN 'exploit' WHEN direction = 'declining' THEN 'explore'
  WHEN direction = 'plateau' AND strength > 0.6::double THEN 'explore' WHEN convergence > 0.5::double THEN 'exploit' ELSE 'explore' END AS action FROM
  t4)
"""


@query(TREND + "SELECT task, iteration, direction, round(strength, 6) AS strength, duration, round(convergence, 6) AS convergence, action FROM trend")
def w7_trends(spark, d):
    return rounded(H.trends(P.history(spark, d)).drop("metric"), "strength", "convergence")


@query(HIST + f""", i AS (SELECT *, row_number() {W})::double AS i FROM hist) SELECT task, iteration, round(coalesce(CASE WHEN count(*) {W} ROWS 4 PRECEDING) >= 2 THEN
  regr_slope(metric, i) {W} ROWS 4 PRECEDING) END, 0.0), 6) + 0.0 AS rate FROM i""".replace(HIST + ",", HIST.rstrip() + ","))
def w12_improvement_rate(spark, d):
    return rounded(H.improvement_rate(P.history(spark, d)), "rate").withColumn("rate", F.col("rate") + 0.0)


@query(HIST.rstrip() + f""", b AS (SELECT *, max(metric) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb FROM hist), r AS (SELECT *, CASE WHEN bb IS NULL OR metric >
  bb + 1e-10::double THEN iteration END AS rise FROM b) SELECT task, iteration, round(max(metric) {W} ROWS UNBOUNDED PRECEDING), 6) AS best_metric,
  max(rise) {W} ROWS UNBOUNDED PRECEDING) AS best_iteration FROM r""")
def w13_state_updates(spark, d):
    return rounded(H.state_updates(P.history(spark, d)), "best_metric")


@query(HIST.rstrip() + " SELECT task, iteration, round(metric, 6) AS metric FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY iteration DESC) AS r FROM hist) WHERE r <= 5")
def w14_recent_history(spark, d):
    w = Window.partitionBy("task").orderBy(F.desc("iteration"))
    return rounded(P.history(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 5").select("task", "iteration", "metric"), "metric")


@query(HIST.rstrip() + f""", n AS (SELECT task, iteration, lead(metric) {W}) - metric AS improvement FROM hist), k AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY
  improvement DESC, iteration) AS up, row_number() OVER (PARTITION BY task ORDER BY improvement, iteration DESC) AS down FROM n WHERE improvement IS
  NOT NULL)
SELECT task, iteration, 'effective' AS kind, up AS rank, round(improvement, 6) AS improvement FROM k WHERE up <= 3 AND improvement > 0 UNION ALL
  SELECT task, iteration, 'ineffective', down, round(improvement, 6) FROM k WHERE down <= 3 AND improvement < 0""")
def w10_effectiveness(spark, d):
    return rounded(H.effectiveness(P.history(spark, d)), "improvement")


def ema_sql(source: str, keys: str, keep: str = "0.7") -> str:
    return f"""(SELECT {keys}, count(*) AS usage, count(*) FILTER (WHERE delta > 0) AS successes, sum(delta) AS total,
  sum(pow({keep}::double, n - i) * CASE WHEN i = 1 THEN 1.0::double ELSE 1 - {keep}::double END * delta) AS ema
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY iteration) AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}) GROUP BY {keys})"""


IMP = HIST.rstrip() + f", imp AS (SELECT * FROM (SELECT *, metric - lag(metric) {W}) AS delta FROM hist) WHERE delta IS NOT NULL)"
EFF = IMP + ", eff AS " + ema_sql("imp", "task, edge_type") + " "


def effects(spark, d):
    return H.ema(H.improvements(P.history(spark, d)), ["task", "edge_type"], "iteration", "delta")


@query(EFF + "SELECT task, edge_type, usage, successes, round(total, 6) AS total, round(ema, 6) AS ema FROM eff")
def w15_edge_effects(spark, d):
    return rounded(effects(spark, d), "total", "ema")


@query(IMP + ", g AS (SELECT *, row_number() OVER (ORDER BY task, iteration) AS pos FROM imp), eff AS " + ema_sql("(SELECT edge_type, delta, pos AS iteration FROM g)", "edge_type") + " SELECT edge_type, usage, successes, round(total, 6) AS total, round(ema, 6) AS ema FROM eff")
def w16_global_effects(spark, d):
    """Global scope: tasks one after another."""
    imp = H.improvements(P.history(spark, d)).withColumn("iteration", F.struct("task", "iteration"))
    return rounded(H.ema(imp, ["edge_type"], "iteration", "delta"), "total", "ema")


WEIGHTS = EFF + """, raw AS (SELECT *, round(CASE WHEN usage < 2 THEN 0.5::double ELSE 0.25::double + (successes / usage * 0.6::double + greatest(0.0::double,
  least(1.0::double, (ema + 0.1::double) / 0.2::double)) * 0.4::double) * 0.5::double END, 9) AS raw FROM eff),
mm AS (SELECT *, min(raw) OVER (PARTITION BY task) AS lo, max(raw) OVER (PARTITION BY task) AS hi FROM raw)
"""


@query(WEIGHTS + """SELECT task, edge_type, round(raw, 6) AS raw, CASE WHEN hi > lo THEN round(pow((raw - lo) / (hi - lo), 0.7::double) * 0.95::double + 0.05::double, 3)
  ELSE 0.5::double END AS weight FROM mm""")
def w18_edge_weights(spark, d):
    return rounded(H.edge_weights(effects(spark, d)), "raw")


@query(EFF + """SELECT task, edge_type, round(greatest(0.0::double, least(1.0::double, 1 - successes / usage + greatest(-0.3::double, least(0.3::double, ema *
  -5.0::double)))), 6) AS suggestion FROM eff""")
def w20_neighbor_suggestions(spark, d):
    e = effects(spark, d)
    return e.select("task", "edge_type", F.round(H.neighbor_suggestion(F.col("successes"), F.col("usage"), F.col("ema")), 6).alias("suggestion"))


@query(EFF + "SELECT task, edge_type, usage FROM eff WHERE usage >= 3 AND successes / usage >= 0.6::double")
def w21_commonly_excluded(spark, d):
    return effects(spark, d).where((F.col("usage") >= 3) & (F.col("successes") / F.col("usage") >= 0.6)).select("task", "edge_type", "usage")


@query(IMP + """ SELECT task, iteration, round(delta, 6) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY delta DESC, iteration) AS r FROM imp
  WHERE delta > 0) WHERE r <= 10""")
def w22_top_improvements(spark, d):
    w = Window.partitionBy("task").orderBy(F.desc("delta"), "iteration")
    return rounded(H.improvements(P.history(spark, d)).where("delta > 0").withColumn("r", F.row_number().over(w)).where("r <= 10").select("task", "iteration", "delta"), "delta")


PARAMS = IMP + """, lng AS (SELECT task, iteration, delta, unnest(['sampling', 'max_hops', 'edge_type']) AS param, unnest([sampling, cast(max_hops AS varchar),
  edge_type]) AS value FROM imp), pe AS """ + ema_sql("lng", "task, param, value", "0.8") + " "


@query(PARAMS + "SELECT task, param, value, usage AS n, round(ema, 6) AS effect FROM pe")
def w23_parameter_effects(spark, d):
    return rounded(H.parameter_effects(P.history(spark, d), ["sampling", "max_hops", "edge_type"]), "effect")


@query(PARAMS + """, b AS (SELECT *, row_number() OVER (PARTITION BY task, param ORDER BY round(ema, 9) DESC, value) AS best, row_number() OVER (PARTITION BY task, param
  ORDER BY round(ema, 9), value) AS worst FROM pe) SELECT task, param, value, best, worst FROM b WHERE best <= 2 OR worst <= 2""")
def w24_best_worst_values(spark, d):
    e = H.parameter_effects(P.history(spark, d), ["sampling", "max_hops", "edge_type"]).withColumn("effect", F.round("effect", 9))
    w = Window.partitionBy("task", "param")
    e = e.withColumn("best", F.row_number().over(w.orderBy(F.desc("effect"), "value")).cast("long")).withColumn("worst", F.row_number().over(w.orderBy("effect", "value")).cast("long"))
    return e.where("best <= 2 OR worst <= 2").select("task", "param", "value", "best", "worst")


@query(PARAMS + """, v AS (SELECT DISTINCT param, value FROM lng), t AS (SELECT DISTINCT task FROM lng) SELECT t.task, v.param, v.value, coalesce(pe.usage, 0) AS n FROM
  t CROSS JOIN v LEFT JOIN pe ON pe.task = t.task AND pe.param = v.param AND pe.value = v.value WHERE coalesce(pe.usage, 0) < 2""")
def w25_unexplored_values(spark, d):
    e = H.parameter_effects(P.history(spark, d), ["sampling", "max_hops", "edge_type"])
    # the values of three parameters, a handful by their definition
    grid = e.select("task").distinct().crossJoin(F.broadcast(e.select("param", "value").distinct()))
    return grid.join(e, ["task", "param", "value"], "left").select("task", "param", "value", F.coalesce("n", F.lit(0)).alias("n")).where("n < 2")


@query(PARAMS + """, v AS (SELECT unnest(['edge_type', 'edge_type', 'max_hops', 'max_hops', 'sampling']) AS param, unnest(['click', 'CORUM', '3', '4', 'top_k']) AS
  value), t AS (SELECT DISTINCT task FROM lng)
SELECT t.task, v.param, v.value, coalesce(pe.usage, 0) AS n FROM t CROSS JOIN v LEFT JOIN pe ON pe.task = t.task AND pe.param = v.param AND pe.value =
  v.value WHERE coalesce(pe.usage, 0) < 2""")
def w25_unexplored_given_values(spark, d):
    """Of values given, some of which no task has tried."""
    e = H.parameter_effects(P.history(spark, d), ["sampling", "max_hops", "edge_type"])
    return H.unexplored(e, {"edge_type": ["click", "CORUM"], "max_hops": ["3", "4"], "sampling": ["top_k"]})


ABL = HIST.rstrip() + f""", l AS (SELECT *, lag(edge_type) {W}) AS pe, metric - lag(metric) {W}) AS delta FROM hist), mv AS (SELECT task, iteration, delta, edge_type, 'added'
  AS kind FROM l WHERE pe <> edge_type UNION ALL SELECT task, iteration, delta, pe, 'removed' FROM l WHERE pe <> edge_type),
e AS """ + ema_sql("mv", "task, edge_type, kind") + """, o AS (SELECT task, edge_type, coalesce(max(usage) FILTER (WHERE kind = 'added'), 0) AS n_added, coalesce(max(usage) FILTER (WHERE kind = 'removed'),
  0) AS n_removed, coalesce(max(ema) FILTER (WHERE kind = 'added'), 0.0) AS a, coalesce(max(ema) FILTER (WHERE kind = 'removed'), 0.0) AS r FROM e
  GROUP BY 1, 2),
abl AS (SELECT *, a - r AS net, CASE WHEN a > 0.01 AND r < 0 THEN 'BENEFICIAL' WHEN a < -0.01 AND r > 0 THEN 'LIKELY NOISE' WHEN a < -0.01 THEN
  'POSSIBLY NOISE' WHEN a > 0.01 AND r > 0 THEN 'UNCERTAIN' WHEN abs(a) < 0.005 AND abs(r) < 0.005 THEN 'NEUTRAL' ELSE 'UNCERTAIN' END AS class FROM
  o)
"""


@query(ABL + "SELECT task, edge_type, n_added, n_removed, round(a, 6) AS when_added, round(r, 6) AS when_removed, round(net, 6) AS net, class FROM abl")
def w26_ablation(spark, d):
    return rounded(H.ablation(strategies(spark, d)), "when_added", "when_removed", "net")


@query(ABL + "SELECT task, edge_type, net > 0 AS beneficial FROM abl WHERE n_added + n_removed >= 2 AND abs(net) > 0.01")
def w28_noisy_or_beneficial(spark, d):
    return H.ablation(strategies(spark, d)).where("n_added + n_removed >= 2 AND abs(net) > 0.01").select("task", "edge_type", (F.col("net") > 0).alias("beneficial"))


@query(HIST.rstrip() + f""", l AS (SELECT *, metric - lag(metric) {W}) AS delta FROM hist), v AS (SELECT task, iteration, CASE WHEN delta IS NULL THEN 'first' WHEN delta >
  0.02::double THEN 'improved' WHEN delta < -0.02::double THEN 'decreased' ELSE 'stagnant' END AS evidence FROM l) SELECT task, iteration, evidence,
  evidence IN ('first', 'improved') AS validated FROM v""")
def w30_hypothesis_verdicts(spark, d):
    return H.verdicts(P.history(spark, d))


KEY = "'e:' || edge_type || ':h:' || max_hops || ':n:' || (max_neighbors // 25 * 25) || ':s:' || sampling"


@query(HIST + f"SELECT task, iteration, {KEY} AS strategy FROM hist")
def w34_strategy_key(spark, d):
    return strategies(spark, d).select("task", "iteration", H.strategy_key(F.col("edge_types"), F.col("max_hops"), F.col("max_neighbors"), F.col("sampling")).alias("strategy"))


@query(HIST.rstrip() + f""", k AS (SELECT task, {KEY} AS strategy, metric FROM hist), p AS (SELECT task, strategy, count(*) AS n, avg(metric) AS mean FROM k GROUP BY 1, 2)
  SELECT task, strategy, n, round(mean, 6) AS mean, round(mean + sqrt(ln(greatest(sum(n) OVER (PARTITION BY task), 2)::double) / n) * 1.414::double,
  6) AS ucb FROM p""")
def w31_ucb(spark, d):
    k = strategies(spark, d).withColumn("strategy", H.strategy_key(F.col("edge_types"), F.col("max_hops"), F.col("max_neighbors"), F.col("sampling")))
    return rounded(H.ucb(k, ["task", "strategy"], "metric"), "mean", "ucb")


@query(TREND + """, b AS (SELECT *, greatest(0.05::double, 0.2::double / (iteration * 0.3::double + 1.0::double)) AS base FROM trend)
SELECT task, iteration, round(CASE WHEN direction = 'improving' AND convergence > 0.7::double THEN greatest(0.05::double, base - convergence *
  0.2::double) ELSE least(1.0::double, base + CASE direction WHEN 'plateau' THEN 0.05::double WHEN 'declining' THEN 0.1::double ELSE 0.0::double END)
  END, 6) AS epsilon FROM b""")
def w33_epsilon(spark, d):
    t = H.trends(P.history(spark, d))
    return t.select("task", "iteration", F.round(H.epsilon(F.col("direction"), F.col("convergence"), F.col("iteration")), 6).alias("epsilon"))


CRITIC = TREND.rstrip() + f""",
c0 AS (SELECT *, CASE WHEN coalesce(metric <= lag(metric, 1) {W}) AND lag(metric, 1) {W}) <= lag(metric, 2) {W}), false) THEN 'declining' ELSE
  direction END AS tr, max(metric) {W} ROWS UNBOUNDED PRECEDING) AS best, avg(metric) {W} ROWS 4 PRECEDING) AS mean, stddev_pop(metric) {W} ROWS 4
  PRECEDING) AS std FROM trend),
c1 AS (SELECT *, CASE WHEN n >= 3 AND mean > 1e-8 THEN 1 - least(1.0::double, std / greatest(mean, 1e-8) * 2) ELSE 0.5::double END AS consistency FROM
  c0),
c2 AS (SELECT *, greatest(-1.0::double, least(1.0::double, (CASE tr WHEN 'improving' THEN 0.85::double WHEN 'plateau' THEN 0.15::double WHEN
  'oscillating' THEN 0.2::double WHEN 'declining' THEN 0.05::double ELSE 0.4::double END * 0.35::double + greatest(0.0::double, least(1.0::double,
  best)) * 0.3::double + consistency * 0.2::double + greatest(0.0::double, least(1.0::double, metric)) * 0.15::double) * 2 - 1)) AS raw FROM c1),
c3 AS (SELECT *, list(raw) {W} ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS past FROM c2),
critic AS (SELECT *, list_reduce(past, lambda a, x: x * 0.7::double + a * 0.3::double) AS value FROM c3)
"""


def critic(spark, d):
    h = P.history(spark, d)
    return H.critic_values(h, H.trends(h))


@query(CRITIC + "SELECT task, iteration, round(consistency, 6) AS consistency, round(value, 6) AS value FROM critic")
def w36_critic_values(spark, d):
    return rounded(critic(spark, d).drop("metric"), "consistency", "value", by=scaled)


GAE = CRITIC.rstrip() + """, g0 AS (SELECT task, iteration, metric AS reward, value FROM critic), g1 AS (SELECT *, reward + coalesce(lead(value) OVER (PARTITION BY task ORDER BY
  iteration), 0.0) * 0.99::double - value AS td FROM g0)
"""


@query(GAE + """SELECT task, iteration, round(td, 6) AS td, round(list_reduce(list_prepend(0.0::double, list_reverse(list(td) OVER (PARTITION BY task ORDER BY
  iteration ROWS BETWEEN CURRENT ROW AND 600 FOLLOWING))), lambda a, x: x + a * (0.99::double * 0.95::double)), 6) AS advantage FROM g1""")
def w39_gae(spark, d):
    c = critic(spark, d).withColumnRenamed("metric", "reward")
    return rounded(H.gae(c), "td", "advantage", by=scaled)


@query(CRITIC + "SELECT task, iteration, round(greatest(-2.0::double, least(2.0::double, metric - value)), 6) AS advantage FROM critic")
def w37_advantage(spark, d):
    return critic(spark, d).select("task", "iteration", scaled(H.clip(F.col("metric") - F.col("value"), -2.0, 2.0), 6).alias("advantage"))


@query(HIST + f"""SELECT task, iteration, row_number() {W}) >= 3 AND coalesce(max_neighbors > lag(max_neighbors, 2) {W}) * 1.2::double AND max(metric) {W} ROWS 2
  PRECEDING) <= lag(metric, 2) {W}) * 1.02::double, false) AS prune FROM hist""")
def w45_prune_mode(spark, d):
    return H.prune_mode(P.history(spark, d))


@query(HIST.rstrip() + f""", f AS (SELECT *, CASE WHEN metric < lag(metric) {W}) - 0.01::double THEN 1 ELSE 0 END AS fall FROM hist), i AS (SELECT *, sum(1 - fall) {W} ROWS
  UNBOUNDED PRECEDING) AS island FROM f), r AS (SELECT *, cast(sum(fall) OVER (PARTITION BY task, island ORDER BY iteration ROWS UNBOUNDED PRECEDING)
  AS bigint) AS declines FROM i) SELECT task, iteration, CASE WHEN declines > 0 THEN (declines - 1) % 3 + 1 ELSE 0 END AS declines, declines > 0 AND
  declines % 3 = 0 AS rollback FROM r""")
def w46_rollbacks(spark, d):
    return H.rollbacks(P.history(spark, d))


@query(HIST.rstrip() + """, l AS (SELECT metric, unnest(['sampling', 'max_hops']) AS param, unnest([sampling, cast(max_hops AS varchar)]) AS value FROM hist) SELECT param,
  value, count(*) AS n, round(avg(metric), 6) AS avg_metric, round(max(metric), 6) AS best_metric, round(min(metric), 6) AS worst_metric FROM l GROUP
  BY 1, 2""")
def a12_parameter_stats(spark, d):
    return rounded(H.parameter_stats(P.history(spark, d), ["sampling", "max_hops"]), "avg_metric", "best_metric", "worst_metric")


@query(IMP + " SELECT task, edge_type, count(*) AS failures FROM imp WHERE delta < -0.02::double GROUP BY 1, 2 HAVING count(*) >= 2")
def a15_failure_patterns(spark, d):
    return H.improvements(P.history(spark, d)).where("delta < -0.02D").groupBy("task", "edge_type").agg(F.count("*").alias("failures")).where("failures >= 2")


@query(HIST + "SELECT task, count(*) AS n, count(DISTINCT edge_type) AS edge_types, round(avg(metric), 11) AS mean_metric, round(max(metric), 11) AS best_metric FROM hist GROUP BY 1")
def a11_memory_stats(spark, d):
    return rounded(P.history(spark, d).groupBy("task").agg(F.count("*").alias("n"), F.countDistinct("edge_type").alias("edge_types"), F.avg("metric").alias("mean_metric"), F.max("metric").alias("best_metric")), "mean_metric", "best_metric", places=11)
