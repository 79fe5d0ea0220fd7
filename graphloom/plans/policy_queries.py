"""Queries of policies, advice and the texts about them, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import graph, scoring
from graphloom.operators import history as H
from graphloom.operators import policy as Po
from graphloom.operators import strategy as St
from graphloom.plans import history_queries as HQ
from graphloom.plans import projection as P
from graphloom.plans.history_queries import HIST, W
from graphloom.plans.queries import SCORED, query, rounded, scores
from graphloom.plans.text_queries import fixed_sql

TYPES = "['PPI', 'GO', 'HPO', 'TRRUST', 'CellMarker', 'Reactome']"

#: Strategies by event, with values out of bounds among them.
STRAT = f"""WITH st AS (SELECT event_id AS id, ({TYPES})[1:event_id % 6 + 1] AS edge_types, event_id % 260 - 20 AS max_neighbors, event_id % 6 - 1 AS max_hops,
  (['top_k', 'random', 'weighted', 'other'])[event_id % 4 + 1] AS sampling FROM events)"""


def _strategies(spark, d):
    k = F.col("event_id")
    types = F.slice(Po.array_of(St.EDGE_TYPES), F.lit(1), (k % 6 + 1).cast("int"))
    method = F.element_at(Po.array_of(("top_k", "random", "weighted", "other")), (k % 4 + 1).cast("int"))
    return P.table(spark, d, "events").select(k.alias("id"), types.alias("edge_types"), (k % 260 - 20).alias("max_neighbors"), (k % 6 - 1).alias("max_hops"), method.alias("sampling"))


@query(STRAT + """ SELECT id, array_to_string(edge_types, ',') AS edge_types, CASE WHEN max_neighbors < 0 THEN 50 ELSE max_neighbors END AS max_neighbors,
  CASE WHEN sampling = 'other' THEN 'top_k' ELSE sampling END AS sampling, CASE WHEN max_hops < 0 OR max_hops > 3 THEN 2 ELSE max_hops END AS max_hops FROM st""")
def p12_extraction_strategy(spark, d):
    e = Po.extraction_strategy(F.array_append("edge_types", F.lit("XX")), F.col("max_neighbors"), F.col("sampling"), F.col("max_hops"))
    return _strategies(spark, d).select("id", *[v.alias(k) for k, v in e.items()]).withColumn("edge_types", F.array_join("edge_types", ","))


@query("SELECT event_id AS id, 2 AS n, cast(event_id % 200 AS varchar) AS max_neighbors, 'random' AS sampling FROM events")
def p16_essential_keys(spark, d):
    text = F.concat(F.lit('{"max_neighbors": '), (F.col("event_id") % 200).cast("string"), F.lit(', "llm": "x", "sampling": "random", "seed": 4}'))
    e = P.table(spark, d, "events").select(F.col("event_id").alias("id"), Po.essential(text).alias("m"))
    return e.select("id", F.size("m").alias("n"), F.col("m")["max_neighbors"].alias("max_neighbors"), F.col("m")["sampling"].alias("sampling"))


@query(STRAT + " SELECT id, list_sort(list_distinct(edge_types)) = list_sort(['GO', 'PPI', 'HPO']) AS similar FROM st")
def t12_similar_strategies(spark, d):
    return _strategies(spark, d).select("id", Po.same_types(F.col("edge_types"), Po.array_of(("GO", "PPI", "HPO", "GO"))).alias("similar"))


@query(HIST.rstrip() + f""", b AS (SELECT *, arg_max(max_neighbors, {{'m': metric, 'i': -iteration}}) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM hist)
SELECT task, iteration, coalesce(max_neighbors > best * 1.5::double, false) AS prune FROM b""")
def w29_should_prune(spark, d):
    h = Po.best_neighbors(P.history(spark, d))
    return h.select("task", "iteration", Po.should_prune(F.col("max_neighbors"), F.col("best_neighbors")).alias("prune"))


#: A number in (0, 1) from a seeded hash, as ``graph.unit_hash`` has it.
def unit_sql(what: str) -> str:
    return f"((cast(('0x' || substr(md5('0|' || id || '|{what}'), 1, 8)) AS bigint) + 0.5::double) / 4294967296.0::double)"


PERT = STRAT + f""", s2 AS (SELECT id, edge_types AS t, len(edge_types) AS n, greatest(10, max_neighbors) AS mn, 1 + abs(max_hops) % 3 AS mh, CASE WHEN sampling =
  'other' THEN 'top_k' ELSE sampling END AS sm FROM st),
d AS (SELECT *, cast(floor({unit_sql("swap")} * greatest(n - 1, 1)) AS int) AS sw, list_filter({TYPES}, lambda x: NOT list_contains(t, x)) AS un,
  list_filter(['top_k', 'random', 'weighted'], lambda x: x <> sm) AS ot FROM s2)
SELECT id, array_to_string(CASE WHEN {unit_sql("a")} < 0.3 THEN CASE WHEN n > 1 THEN list_transform(range(0, n), lambda i: t[CASE i WHEN sw THEN i + 2
  WHEN sw + 1 THEN i ELSE i + 1 END]) ELSE t END
  WHEN {unit_sql("b")} < 0.3::double * 0.5::double THEN CASE WHEN len(un) > 0 THEN list_append(t, un[cast(floor({unit_sql("add")} * len(un)) AS int) +
  1]) ELSE t END
  WHEN {unit_sql("c")} < 0.3::double * 0.3::double AND n > 2 THEN list_filter(t, lambda x, i: i <> cast(floor({unit_sql("drop")} * n) AS int) + 1)
  ELSE t END, ',') AS edge_types,
 cast(CASE WHEN {unit_sql("n")} < 0.3 THEN greatest(10, least(200, floor(mn * ({unit_sql("by")} * 0.6::double + 0.7::double)))) ELSE mn END AS bigint)
  AS max_neighbors,
 cast(CASE WHEN {unit_sql("h")} < 0.3 THEN greatest(1, least(3, mh + CASE WHEN {unit_sql("way")} < 0.5 THEN -1 ELSE 1 END)) ELSE mh END AS bigint) AS
  max_hops,
 CASE WHEN {unit_sql("s")} < 0.3::double * 0.5::double THEN ot[cast(floor({unit_sql("m")} * len(ot)) AS int) + 1] ELSE sm END AS sampling FROM d"""


@query(PERT)
def w35_perturbations(spark, d):
    s = _strategies(spark, d).select(
        "id", "edge_types", F.greatest(F.lit(10), "max_neighbors").alias("max_neighbors"), (F.abs("max_hops") % 3 + 1).alias("max_hops"),
        F.when(F.col("sampling") == "other", "top_k").otherwise(F.col("sampling")).alias("sampling"),
    )
    return Po.perturbed(s).withColumn("edge_types", F.array_join("edge_types", ","))


TASKS = ("ppi", "ggi", "cell", "celltype", "genetype", "geneattribute_bivalent", "geneattribute_dosage_sensitivity", "perturbation", "perturbation_norman", "dosage", "phenotype", "other")


def _tasks(spark, d):
    """A task for each user of the event stream, with metrics from their events."""
    v, k = F.col("value"), F.col("user_id") % len(TASKS)
    e = P.table(spark, d, "events").groupBy("user_id").agg(*[F.round(x, 6).alias(n) for n, x in (("auc", F.avg(v) / 200.0), ("f1", F.avg(F.floor(v) % 7) / 7.0), ("accuracy", F.avg(F.floor(v) % 11) / 11.0), ("ari", F.avg(F.floor(v) % 5) / 5.0))])
    return e.select(F.element_at(Po.array_of(TASKS), (k + 1).cast("int")).alias("task"), "auc", "f1", "accuracy", "ari")


_task_sql = f"""WITH tk AS (SELECT ({list(TASKS)})[user_id % {len(TASKS)} + 1] AS task, round(avg(value) / 200.0::double, 6) AS auc, round(avg(floor(value) % 7) / 7.0::double, 6) AS f1,
  round(avg(floor(value) % 11) / 11.0::double, 6) AS accuracy, round(avg(floor(value) % 5) / 5.0::double, 6) AS ari FROM events GROUP BY user_id) """
_weights_sql = """SELECT task, CASE WHEN task LIKE 'perturbation%' THEN 0.05::double ELSE 0.1::double END AS baseline_weight, 0.1::double AS relative_weight, CASE WHEN
  task LIKE 'perturbation%' THEN 0.85::double ELSE 0.8::double END AS raw_weight, 0.0::double AS improvement_bonus, -0.05::double AS plateau_penalty
  FROM tk"""


@query(_task_sql + _weights_sql)
def w42_reward_weights(spark, d):
    return Po.reward_weights(_tasks(spark, d).select("task"))


@query("""WITH e AS (SELECT event_id AS id, event_id % 7 / 10.0::double AS b, event_id % 5 / 10.0::double AS r, event_id % 11 / 10.0::double AS w FROM events),
  t AS (SELECT *, b + r + w AS t FROM e) SELECT id, abs(t - 1.0::double) < 0.01::double AS valid, round(b / CASE WHEN t > 0 THEN t ELSE 1 END, 9) AS
  baseline_weight, round(r / CASE WHEN t > 0 THEN t ELSE 1 END, 9) AS relative_weight, round(w / CASE WHEN t > 0 THEN t ELSE 1 END, 9) AS raw_weight
  FROM t""")
def r14_normalised_weights(spark, d):
    k = F.col("event_id")
    e = P.table(spark, d, "events").select(k.alias("id"), (k % 7 / 10.0).alias("baseline_weight"), (k % 5 / 10.0).alias("relative_weight"), (k % 11 / 10.0).alias("raw_weight"))
    return rounded(Po.normalised_weights(e), *Po.WEIGHT_NAMES[:3], places=9)


_advice_sql = """SELECT task, array_to_string(list_filter(list_concat(
 CASE WHEN fam = 'ppi' AND auc < 0.7 THEN {ppi} ELSE [] END, CASE WHEN fam = 'genetype' AND f1 < 0.7 THEN {genetype} ELSE [] END, CASE WHEN fam =
  'ggi' AND auc < 0.7 THEN {ggi} ELSE [] END,
 CASE WHEN fam = 'cell' AND f1 < 0.7 THEN {cell} ELSE [] END, CASE WHEN fam = 'phenotype' AND auc < 0.7 THEN {phenotype} ELSE [] END, CASE WHEN fam =
  'celltype' AND f1 < 0.7 THEN {celltype} ELSE [] END,
 CASE WHEN fam = 'dosage' AND accuracy < 0.7 THEN {dosage} ELSE [] END, [CASE WHEN fam = 'ppi' AND f1 < auc - 0.1::double THEN
  'Class imbalance detected - consider adjusting negative sampling' END],
 [CASE WHEN fam = 'cell' AND ari < 0.5 THEN 'Low clustering agreement - embeddings may lack cell-type specificity' END],
 CASE WHEN fam = 'geneattribute' AND auc < 0.7 THEN ['Focus on regulatory network information (TRRUST edges)',
  'Include GO biological process annotations'] ELSE [] END,
 [CASE WHEN fam = 'geneattribute' AND contains(task, 'dosage') THEN 'Prioritize gene essentiality and constraint information' END],
 [CASE WHEN fam = 'geneattribute' AND NOT contains(task, 'dosage') AND regexp_matches(task, 'methylation|lys4|bivalent') THEN
  'Focus on chromatin state and epigenetic context' END],
 CASE WHEN v < 0.6 THEN {general} ELSE [] END), lambda x: x IS NOT NULL), ';') AS advice
FROM (SELECT *, CASE fam WHEN 'ppi' THEN auc WHEN 'ggi' THEN auc WHEN 'phenotype' THEN auc WHEN 'geneattribute' THEN auc WHEN 'dosage' THEN accuracy
  ELSE f1 END AS v FROM (SELECT *, split_part(task, '_', 1) AS fam FROM tk))"""
_lists = {k: "[" + ", ".join(f"'{t}'" for t in v) + "]" for k, v in Po.ADVICE.items()} | {"general": "[" + ", ".join(f"'{t}'" for t in Po.GENERAL_ADVICE) + "]"}


@query(_task_sql + _advice_sql.format(**_lists))
def x29_task_advice(spark, d):
    return Po.task_advice(_tasks(spark, d)).withColumn("advice", F.array_join("advice", ";"))


#: Proposals beside the strategy of two events before, with a mode and an advantage.
PROP = f"""WITH ev AS (SELECT *, row_number() OVER (ORDER BY event_id) AS rn FROM events), a AS (SELECT event_id AS id, ({TYPES})[1:event_id % 6 + 1] AS pt, 10 +
  event_id % 191 AS pn, 1 + event_id % 3 AS ph, (['top_k', 'random', 'weighted'])[event_id % 3 + 1] AS ps,
 ({TYPES})[1:event_id % 5 + 1] AS ct, 10 + event_id % 97 AS cn, 1 + event_id % 2 AS ch, (['top_k', 'random', 'weighted'])[event_id % 2 + 1] AS cs,
  CASE WHEN event_id % 4 = 0 THEN 'FINE_TUNE' ELSE 'HIGH_ENTROPY' END AS mode, event_id % 9 / 20.0::double AS distance, event_id % 11 / 10.0::double -
  0.5::double AS adv FROM events) """


def _proposals(spark, d):
    k = F.col("event_id")
    types = lambda n: F.slice(Po.array_of(St.EDGE_TYPES), F.lit(1), (k % n + 1).cast("int"))
    method = lambda n: F.element_at(Po.array_of(St.SAMPLING), (k % n + 1).cast("int"))
    return P.table(spark, d, "events").select(
        k.alias("id"), types(6).alias("p_edge_types"), (k % 191 + 10).alias("p_max_neighbors"), (k % 3 + 1).alias("p_max_hops"), method(3).alias("p_sampling"),
        types(5).alias("c_edge_types"), (k % 97 + 10).alias("c_max_neighbors"), (k % 2 + 1).alias("c_max_hops"), method(2).alias("c_sampling"),
        F.when(k % 4 == 0, "FINE_TUNE").otherwise("HIGH_ENTROPY").alias("mode"), (k % 9 / 20.0).alias("distance"), (k % 11 / 10.0 - 0.5).alias("advantage"),
    )


@query(PROP + f"""SELECT id, array_to_string(CASE WHEN far OR list_sort(pt) <> list_sort(ct) THEN pt WHEN len(ct) < 5 THEN list_append(ct, list_filter({TYPES}, lambda
  x: NOT list_contains(ct, x))[1]) WHEN len(ct) > 2 THEN ct[1:len(ct) - 1] ELSE pt END, ',') AS edge_types,
 CASE WHEN far OR abs(pn - cn) >= 30 THEN pn ELSE least(200, greatest(10, cn + 40)) END AS max_neighbors, CASE WHEN far OR ps <> cs THEN ps ELSE
  list_filter(['top_k', 'random', 'weighted'], lambda x: x <> cs)[1] END AS sampling
 FROM (SELECT *, mode <> 'HIGH_ENTROPY' OR distance >= 0.3::double AS far FROM a)""")
def w47_enforced_strategies(spark, d):
    return Po.enforced(_proposals(spark, d)).withColumn("edge_types", F.array_join("edge_types", ","))


@query(PROP + """SELECT id, array_to_string(c, ',') AS changes, CASE WHEN len(c) = 0 THEN 'similar' WHEN adv > 0.1 THEN 'explore' WHEN adv < -0.2 THEN 'caution' ELSE
  'allow' END AS advice FROM (
 SELECT *, list_filter([CASE WHEN list_sort(pt) <> list_sort(ct) THEN 'edge_types' END, CASE WHEN ph <> ch THEN 'max_hops' END, CASE WHEN abs(pn - cn)
  > 20 THEN 'max_neighbors' END, CASE WHEN ps <> cs THEN 'sampling' END], lambda x: x IS NOT NULL) AS c FROM a)""")
def w48_consistency_advice(spark, d):
    return Po.consistency_advice(_proposals(spark, d)).withColumn("changes", F.array_join("changes", ","))


@query(SCORED + """, po AS (SELECT 'P' || p_partkey AS center, (['top_k', 'threshold', 'retain_all', 'other'])[p_partkey % 4 + 1] AS mode, p_partkey % 3 * 4 AS k,
  p_partkey % 2 * 0.5::double AS th FROM part WHERE p_partkey % 10 <> 0),
x AS (SELECT s.*, CASE mode WHEN 'top_k' THEN row_number() OVER (PARTITION BY s.center ORDER BY total DESC, neighbor) <= CASE WHEN k > 0 THEN k ELSE
  20 END WHEN 'threshold' THEN total >= CASE WHEN th > 0 THEN th ELSE 0.4::double END ELSE true END AS sel FROM scores s LEFT JOIN po ON po.center =
  s.center)
SELECT center, count(*) AS n, count(*) FILTER (WHERE sel) AS kept FROM x GROUP BY 1""")
def t9_policies_by_gene(spark, d):
    k = F.col("p_partkey")
    policy = P.table(spark, d, "part").where(k % 10 != 0).select(
        P.gene("p_partkey").alias("center"), F.element_at(Po.array_of(("top_k", "threshold", "retain_all", "other")), (k % 4 + 1).cast("int")).alias("mode"), (k % 3 * 4).alias("top_k"), (k % 2 * 0.5).alias("threshold"),
    )
    return Po.select_by_policy(scores(spark, d), policy).groupBy("center").agg(F.count("*").alias("n"), F.count_if("selected").alias("kept"))


#: Scores with no task and with what memory suggests of some neighbours.
FREE = SCORED.replace("CASE WHEN in_task THEN 1.0::double WHEN node_label = 'gene' THEN 0.4::double ELSE 0.2::double END AS task_relevance", "0.5::double AS task_relevance").replace(
    "coalesce((ema + 1) / 2, 0.5::double) AS memory", """CASE WHEN starts_with(neighbor, 'P') AND cast(substr(neighbor, 2) AS bigint) % 5 = 0 THEN coalesce((ema + 1) / 2, 0.5::double) * 0.6::double +
  0.25::double * 0.4::double ELSE coalesce((ema + 1) / 2, 0.5::double) END AS memory"""
).replace("0.4::double + 0.2::double + CASE WHEN ec", "0.4::double + CASE WHEN ec").replace("least((degree - 100) / 400.0::double, 1.0::double) * 0.3::double", "least((degree - 100) / 400.0::double, 1.0::double) * 0.3::double").replace("degree > 100 AND NOT in_task", "degree > 100")


@query(FREE + "SELECT center, neighbor, edge_type, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("task_relevance", "memory", "confidence", "total")) + " FROM scores")
def m4_scores_without_task(spark, d):
    """No task is given; memory knows every fifth gene."""
    e = P.edges(spark, d)
    near = graph.typed_neighbors(P.edges(spark, d, places=True), 10).select("center", "neighbor", "edge_type", "direction")
    ema = spark.createDataFrame([("PPI", 0.2), ("GO", -0.1), ("TRRUST", 0.4)], "edge_type string, ema double")
    known = P.table(spark, d, "part").where("p_partkey % 5 = 0").select(P.gene("p_partkey").alias("neighbor"), F.lit(0.25).alias("suggestion"))
    cols = ("task_relevance", "memory", "confidence", "total")
    out = scoring.score_neighbors(near, graph.degrees(e), P.nodes(spark, d), None, P.embeddings(spark, d), ema, known, e.count())
    return rounded(out, *cols, places=9).select("center", "neighbor", "edge_type", *cols)


@query(SCORED + f""", m AS (SELECT center, count(*) AS n, round(avg(total), 9) AS a, count(*) FILTER (WHERE total >= 0.7) AS h, count(*) FILTER (WHERE total < 0.4) AS l
  FROM scores GROUP BY 1) SELECT center, center || ': ' || n || ' neighbors, avg=' || {fixed_sql('a', 2)} || ', high=' || h || ', low=' || l AS text
  FROM m""")
def a17_minimal_summary(spark, d):
    return Po.minimal_summary(scores(spark, d))


_three = lambda c: fixed_sql(c, 3)
DETAIL = SCORED + f""", o AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY total DESC, neighbor) AS r FROM scores),
dt AS (SELECT center, '## Detailed Neighbor Analysis for ' || center || chr(10) || 'Total neighbors: ' || count(*) || chr(10) || chr(10) ||
  string_agg('### ' || r || '. ' || neighbor || chr(10) || '  - Edge type: ' || edge_type || ' (' || direction || ')' || chr(10)
 || '  - Total score: ' || {_three("total")} || ' (confidence: ' || {fixed_sql("confidence", 2)} || ')' || chr(10) || '  - Breakdown:' || chr(10) ||
  '    * Structural: ' || {_three("structural")} || chr(10) || '    * Task relevance: ' || {_three("task_relevance")} || chr(10)
 || '    * Semantic: ' || {_three("semantic")} || chr(10) || '    * Memory: ' || {_three("memory")} || chr(10), chr(10) ORDER BY r) AS text FROM o
  GROUP BY 1) """


@query(DETAIL + "SELECT center, md5(text) AS text_md5, len(text) AS n_chars FROM dt")
def x20_presenter_detailed(spark, d):
    t = Po.detailed(scores(spark, d))
    return t.select("center", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


ANALYSIS = SCORED + f""", b AS (SELECT *, CASE WHEN total >= 0.7 THEN 1 WHEN total >= 0.4 THEN 2 ELSE 3 END AS b FROM scores),
r AS (SELECT *, row_number() OVER (PARTITION BY center, b ORDER BY total DESC, neighbor) AS r, count(*) OVER (PARTITION BY center, b) AS n FROM b),
g AS (SELECT center, b, max(n) AS n, string_agg(neighbor || ' (' || {fixed_sql("total", 2)} || ', ' || edge_type || ')', ', ' ORDER BY r) AS t,
  string_agg(neighbor, ', ' ORDER BY r) FILTER (WHERE r <= 5) AS lows FROM r WHERE r <= 10 GROUP BY 1, 2),
s AS (SELECT *, CASE b WHEN 1 THEN '### High relevance (score >= 0.7): ' WHEN 2 THEN '### Medium relevance (0.4 - 0.7): ' ELSE
  '### Low relevance (score < 0.4): ' END || n || ' neighbors' || chr(10) || '  ' || t || CASE WHEN n > 10 THEN chr(10) || '  ... and ' || (n - 10) ||
  ' more' ELSE '' END || chr(10) AS txt FROM g),
c AS (SELECT center, sum(n)::bigint AS n, string_agg(txt, chr(10) ORDER BY b) AS txt, max(n) FILTER (WHERE b = 1) AS h, max(n) FILTER (WHERE b = 2) AS
  m, max(n) FILTER (WHERE b = 3) AS l, max(lows) FILTER (WHERE b = 3) AS lows FROM s GROUP BY 1),
an AS (SELECT center, array_to_string(list_filter(['## Neighbor Analysis for ' || center || chr(10) || 'Total neighbors: ' || n || chr(10), txt,
  '### Recommendations', CASE WHEN l > 3 THEN '- Consider excluding low-relevance neighbors: ' || lows END,
 CASE WHEN h IS NULL AND m IS NOT NULL THEN '- No high-relevance neighbors found. Consider broadening edge types.' END, CASE WHEN h > 10 THEN
  '- Many high-relevance neighbors (' || h || '). Consider using top_k selection.' END], lambda x: x IS NOT NULL), chr(10)) AS text FROM c) """


@query(ANALYSIS + "SELECT center, text FROM an")
def x19_neighbor_analysis(spark, d):
    return Po.analysis(scores(spark, d))


@query(ANALYSIS + """, q AS (SELECT cast(substr(center, 2) AS bigint) // 5 AS batch, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY center) AS
  text FROM an GROUP BY 1) SELECT batch, md5(text) AS text_md5 FROM q""")
def x21_analysis_of_several(spark, d):
    """Genes in batches of five."""
    t = Po.analysis(scores(spark, d)).withColumn("batch", F.floor(F.substring("center", 2, 20).cast("long") / 5))
    return Po.several(t, ["batch"]).select("batch", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(ANALYSIS + """, gd AS (SELECT center, count(*) AS n, count(*) FILTER (WHERE total >= 0.7) AS h, count(*) FILTER (WHERE total < 0.4) AS l FROM scores GROUP BY 1)
  SELECT center, text || chr(10) || chr(10) || '## Neighbor Selection Guidance' || chr(10) || 'Analyzed ' || n || ' total neighbors: ' || h ||
  ' high, ' || l || ' low.' AS text FROM an JOIN gd USING (center)""")
def x35_analysis_section(spark, d):
    s = scores(spark, d)
    g = s.groupBy("center").agg(F.count("*").alias("n"), F.count_if(F.col("total") >= scoring.HIGH).alias("h"), F.count_if(F.col("total") < scoring.LOW).alias("l"))
    text = F.concat("text", F.lit("\n\n## Neighbor Selection Guidance\nAnalyzed "), F.col("n").cast("string"), F.lit(" total neighbors: "), F.col("h").cast("string"), F.lit(" high, "), F.col("l").cast("string"), F.lit(" low."))
    return Po.analysis(s).join(g, "center").select("center", text.alias("text"))


def _signed_sql(x: str) -> str:
    return f"CASE WHEN starts_with({fixed_sql(x, 4)}, '-') THEN {fixed_sql(x, 4)} ELSE '+' || {fixed_sql(x, 4)} END"


@query(HQ.ABL + f""", r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY round(net, 9) DESC, edge_type) AS k FROM abl WHERE n_added + n_removed >= 2)
SELECT task, '## EDGE TYPE ABLATION HISTORY (Marginal Contributions)' || chr(10) || string_agg('- **' || edge_type || '**: added=' ||
  {_signed_sql("a")} || ' (n=' || n_added || '), removed=' || {_signed_sql("r")} || ' (n=' || n_removed || ') -> **' || class || '** (net=' ||
  {_signed_sql("net")} || ')', chr(10) ORDER BY k) AS text FROM r GROUP BY 1""")
def x31_ablation_text(spark, d):
    return Po.ablation_text(H.ablation(HQ.strategies(spark, d)))


@query(HQ.PARAMS + f""", q AS (SELECT task, param, value, round(ema, 9) AS e FROM pe), k AS (SELECT *, row_number() OVER (PARTITION BY task, param ORDER BY e DESC, value) AS
  b, row_number() OVER (PARTITION BY task, param ORDER BY e, value) AS w FROM q),
l AS (SELECT task, param || '1' AS p, '- ' || param || ': ' || value || ' worked well (effect: +' || {fixed_sql("e", 3)} || ')' AS t FROM k WHERE b =
  1 AND e > 0 UNION ALL SELECT task, param || '2', '- ' || param || ': avoid ' || value || ' (effect: ' || {fixed_sql("e", 3)} || ')' FROM k WHERE w =
  1 AND e < 0),
s AS (SELECT task, string_agg(t, chr(10) ORDER BY p) AS t FROM l GROUP BY 1) SELECT task, coalesce('Based on historical performance:' || chr(10) || t,
  'No historical guidance available yet.') AS text FROM (SELECT DISTINCT task FROM pe) LEFT JOIN s USING (task)""")
def x33_parameter_text(spark, d):
    return Po.parameter_text(H.parameter_effects(P.history(spark, d), ["sampling", "max_hops", "edge_type"]))


@query(HQ.IMP + f""", x AS (SELECT task, edge_type, round(max(delta), 9) AS improvement FROM imp WHERE delta > 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER
  (PARTITION BY task ORDER BY improvement DESC, edge_type) AS k FROM x)
SELECT task AS for_task, '## Suggestions (from previous successful runs):' || chr(10) || chr(10) || string_agg('### Suggestion ' || k ||
  ' (from same_task):' || chr(10) || '- Edge types: ' || edge_type || chr(10) || '- Improvement: +' || {fixed_sql("improvement", 4)} || chr(10),
  chr(10) ORDER BY k) AS text FROM r WHERE k <= 3 GROUP BY 1""")
def x32_suggestion_text(spark, d):
    s = H.improvements(P.history(spark, d)).where("delta > 0").groupBy(F.col("task").alias("for_task"), F.col("edge_type").alias("edge_types")).agg(F.round(F.max("delta"), 9).alias("improvement"))
    w = Window.partitionBy("for_task").orderBy(F.desc("improvement"), "edge_types")
    s = s.withColumn("rank", F.row_number().over(w)).where("rank <= 3").withColumn("source", F.lit("same_task"))
    return Po.suggestion_text(s)


@query(STRAT + """ SELECT id, '["' || array_to_string(list_sort(edge_types), '","') || '"]' AS types, CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END AS flag,
  cast(max_neighbors AS varchar) AS neighbors, '{"a":' || id || ',"b":1}' AS weights FROM st""")
def x34_value_keys(spark, d):
    s = _strategies(spark, d)
    weights = F.create_map(F.lit("b"), F.lit(1).cast("long"), F.lit("a"), F.col("id").cast("long"))
    return s.select(
        "id", Po.value_key(F.col("edge_types"), "list").alias("types"), Po.value_key(F.col("id") % 2 == 0, "flag").alias("flag"),
        Po.value_key(F.col("max_neighbors"), "number").alias("neighbors"), Po.value_key(weights, "map").alias("weights"),
    )


#: Responses: a JSON block, a broken one, or none.
COT = """SELECT event_id AS id, 'diag ' || event_id AS biological_diagnosis, CASE event_id % 4 WHEN 3 THEN '' ELSE 'say ' || event_id END AS statement, CASE
  WHEN event_id % 4 IN (0, 1) THEN 'base "q"' ELSE '' END AS biological_basis,
 CASE event_id % 4 WHEN 3 THEN '' ELSE 'f ' || event_id % 9 END AS falsification_criteria FROM events"""


def _reasoned(spark, d):
    k = F.col("event_id")
    n, form = k.cast("string"), k % 4
    nested = F.concat(F.lit('{"biological_diagnosis": "diag '), n, F.lit('", "hypothesis": {"statement": "say '), n, F.lit('", "biological_basis": "base \\"q\\""}, "falsification_criteria": "f '), (k % 9).cast("string"), F.lit('"}'))
    plain = F.concat(F.lit('{"biological_diagnosis": "diag '), n, F.lit('", "hypothesis": "say '), n, F.lit('", "falsification_criteria": "f '), (k % 9).cast("string"), F.lit('"}'))
    block = lambda x: F.concat(F.lit("I think\n```json\n"), x, F.lit("\n```"))
    text = F.when(form == 0, block(nested)).when(form == 1, F.concat(nested, F.lit(" as text"))).when(form == 2, block(plain)).otherwise(F.concat(F.lit('only "biological_diagnosis": "diag '), n, F.lit('"')))
    return P.table(spark, d, "events").select(k.alias("id"), text.alias("text"))


@query(COT)
def x26_reasoned_responses(spark, d):
    own = Po.reasoned_response(F.col("text"))
    return _reasoned(spark, d).select("id", *[own[c].alias(c) for c in ("biological_diagnosis", "statement", "biological_basis", "falsification_criteria")])


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'more ' || event_id END AS hypothesis, 'up' AS expected_outcome FROM events")
def x27_scientist_responses(spark, d):
    k = F.col("event_id")
    text = F.concat(F.when(k % 3 == 0, "none").otherwise(F.concat(F.lit('x "hypothesis": "more '), k.cast("string"), F.lit('"'))), F.lit(', "expected_outcome":"up" end'))
    own = Po.scientist_response(text)
    return P.table(spark, d, "events").select(k.alias("id"), *[v.alias(c) for c, v in own.items()])


@query("SELECT event_id AS id, event_id % 7 AS max_hops, event_id % 2 = 1 AS again FROM events")
def x25_repaired_responses(spark, d):
    """Every second response is broken and repaired by asking once more."""
    k = F.col("event_id")
    sound = F.concat(F.lit('{"max_hops": '), (k % 7).cast("string"), F.lit("}"))
    rows = P.table(spark, d, "events").select(k.alias("id"), F.when(k % 2 == 1, F.concat(F.lit("broken: "), (k % 7).cast("string"))).otherwise(sound).alias("text"))
    repair = lambda t: F.concat(F.lit('{"max_hops": '), F.regexp_extract(t, r"(\d+)$", 1), F.lit("}"))
    out = Po.repaired(rows, F.get_json_object("text", "$.max_hops").cast("long"), repair)
    return out.select("id", F.col("strategy").alias("max_hops"), (F.col("id") % 2 == 1).alias("again"))
