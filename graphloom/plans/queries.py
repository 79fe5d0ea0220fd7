"""Registered queries over the projected graph, with their DuckDB equivalents.

Each query applies operators to whole tables.  Floats are rounded to six places
on both sides, since the engines differ in the last digits of sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import graph, history, scoring
from graphloom.plans import projection as P
from graphloom.plans.projection import with_sql
from graphloom.sources.graph_store import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, places: int = 6, by: Callable[[Column, int], Column] = F.round) -> DataFrame:
    return df.withColumns({n: by(F.col(n), places) for n in names})


def scaled(value: Column, places: int) -> Column:
    """``value`` rounded as DuckDB does it, by the double times 10^places; Spark rounds
    the shortest decimal, which differs half-way."""
    return F.round(value * 10.0**places) / 10.0**places


INC = with_sql("edges", "incident")


@query(with_sql("ppi") + """, i AS (SELECT src AS center, dst AS neighbor, score, 'out' AS d FROM ppi UNION ALL SELECT dst, src, score, 'in' FROM ppi),
r AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY score DESC, neighbor, d) AS rank FROM i)
SELECT center, neighbor, score, rank FROM r WHERE rank <= 10""")
def g1_top_neighbors(spark, d):
    return graph.typed_neighbors(P.edges(spark, d, ("PPI",), True), 10).select("center", "neighbor", "score", "rank")


@query(INC + """, r AS (SELECT *, row_number() OVER (PARTITION BY center, edge_type ORDER BY coalesce(score, 0) DESC, neighbor, direction) AS rank FROM inc)
SELECT center, edge_type, neighbor, rank FROM r WHERE rank <= CASE edge_type WHEN 'PPI' THEN 10 WHEN 'GO' THEN 5 WHEN 'HPO' THEN 16 ELSE 20 END""")
def g3_typed_subgraph(spark, d):
    return graph.typed_neighbors(P.edges(spark, d, places=True), 20, weights={"PPI": 0.5, "GO": 0.1, "HPO": 0.8}).select("center", "edge_type", "neighbor", "rank")


HASH = "(cast(('0x' || substr(md5(concat_ws('|', '{s}', center, neighbor, edge_type)), 1, 8)) AS bigint) + 0.5::double) / 4294967296.0::double"


@query(INC + f""", r AS (SELECT *, row_number() OVER (PARTITION BY center, edge_type ORDER BY {HASH.format(s='7')}, neighbor, direction) AS rank FROM inc)
SELECT center, edge_type, neighbor, rank FROM r WHERE rank <= 8""")
def g1b_random_neighbors(spark, d):
    return graph.typed_neighbors(P.edges(spark, d), 8, "random", seed="7").select("center", "edge_type", "neighbor", "rank")


@query(INC + f""", r AS (SELECT *, row_number() OVER (PARTITION BY center, edge_type ORDER BY -ln({HASH.format(s='7')}) / pow(greatest(0.1::double, coalesce(score,
  1.0::double)), CASE edge_type WHEN 'PPI' THEN 0.5::double ELSE 1.0::double END), neighbor, direction) AS rank FROM inc)
SELECT center, edge_type, neighbor, rank FROM r WHERE rank <= CASE edge_type WHEN 'PPI' THEN 5 ELSE 8 END""")
def g1c_weighted_neighbors(spark, d):
    return graph.typed_neighbors(P.edges(spark, d), 8, "weighted", {"PPI": 0.5}, "7").select("center", "edge_type", "neighbor", "rank")


@query(INC + """SELECT center, neighbor, edge_type, 0::bigint AS rank FROM inc WHERE false""")
def g1d_unknown_method(spark, d):
    return graph.typed_neighbors(P.edges(spark, d), 8, "other").select("center", "neighbor", "edge_type", "rank")


@query(INC + "SELECT center, " + ", ".join(f"count(*) FILTER (WHERE edge_type = '{t}') AS n_{t.lower()}" for t in P.TYPES) + ", count(*) AS total FROM inc GROUP BY center")
def g2_summary(spark, d):
    return graph.summary(P.edges(spark, d), P.TYPES)


@query(with_sql("trrust", "ppi", "emb").rstrip() + """, edges AS (SELECT * FROM ppi UNION ALL SELECT * FROM trrust), inc AS (SELECT src AS center, dst AS neighbor, edge_type, score, 'out' AS direction
  FROM edges UNION ALL SELECT dst, src, edge_type, score, 'in' FROM edges WHERE edge_type = 'PPI'),
c AS (SELECT 'P' || p_partkey AS center FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY center, edge_type ORDER BY coalesce(score, 0) DESC, neighbor, direction) AS rank FROM inc),
h1 AS (SELECT DISTINCT center, neighbor AS node FROM r JOIN c USING (center) WHERE rank <= 5 AND center <> neighbor),
g AS (SELECT center AS node, neighbor, max(coalesce(score, 0)) AS score FROM inc GROUP BY 1, 2),
z AS (SELECT center, count(*) AS size FROM h1 GROUP BY 1),
f AS (SELECT h1.center, g.neighbor, row_number() OVER (PARTITION BY h1.center, h1.node ORDER BY g.score DESC, g.neighbor) AS r, greatest(5, 10 //
  size) AS own FROM h1 JOIN z USING (center) JOIN g ON g.node = h1.node),
h2 AS (SELECT DISTINCT center, neighbor AS node FROM f WHERE r <= own)
SELECT center, center AS node, 0::bigint AS hop FROM c UNION ALL SELECT center, node, 1 FROM h1
UNION ALL SELECT center, node, 2 FROM h2 WHERE node <> center AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.center = h2.center AND h1.node = h2.node)""")
def g4_expand(spark, d):
    centers = P.table(spark, d, "part").select(P.gene("p_partkey").alias("center"))
    return graph.expand(P.edges(spark, d, ("PPI", "TRRUST")), centers, 2, 5)


@query(INC.rstrip() + ",\n" + P.SQL["nodes"] + """, r AS (SELECT *, row_number() OVER (PARTITION BY center, edge_type ORDER BY coalesce(score, 0) DESC, neighbor, direction) AS rank FROM inc),
p AS (SELECT center, neighbor, count(*) AS e, any_value(node_label) AS l FROM r LEFT JOIN nodes ON node_id = neighbor WHERE rank <= 10 GROUP BY 1, 2)
SELECT center, count(*) + 1 AS n_nodes, count(*) FILTER (WHERE l = 'gene') AS n_genes, cast(sum(e) AS bigint) AS n_edges FROM p GROUP BY 1""")
def g5_subgraph_stats(spark, d):
    e = P.edges(spark, d)
    return graph.subgraph_stats(graph.typed_neighbors(P.edges(spark, d, places=True), 10), P.nodes(spark, d))


@query(with_sql("edges") + "SELECT node, count(*) AS degree, cast(sum(o) AS bigint) AS out_degree FROM (SELECT src AS node, 1 AS o FROM edges UNION ALL SELECT dst, 0 FROM edges) GROUP BY node")
def g10_degrees(spark, d):
    return graph.degrees(P.edges(spark, d))


@query(with_sql("edges", "nodes") + "SELECT 'node' AS kind, node_label AS label, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY 2")
def g11_graph_statistics(spark, d):
    return graph.graph_statistics(P.nodes(spark, d), P.edges(spark, d))


@query(with_sql("edges") + "SELECT src AS center, count(*) AS out_degree FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def g12_center(spark, d):
    return graph.center_of(P.edges(spark, d))


@query(with_sql("edges") + "SELECT src AS gene, count(*) AS n FROM (SELECT src FROM edges UNION ALL SELECT dst FROM edges WHERE edge_type = 'PPI') GROUP BY 1")
def g13_gene_triplets(spark, d):
    return graph.incident(P.edges(spark, d)).groupBy(F.col("center").alias("gene")).agg(F.count("*").alias("n"))


@query(with_sql("ppi") + "SELECT DISTINCT least(src, dst) AS gene_a, greatest(src, dst) AS gene_b FROM ppi")
def g14_ppi_pairs(spark, d):
    return graph.undirected_pairs(P.edges(spark, d, ("PPI",)))


@query(with_sql("edges") + """SELECT src, dst, edge_type FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY
  list_position(['PPI','GO','HPO','TRRUST','CellMarker','Reactome'], edge_type) DESC) AS r FROM edges) WHERE r = 1""")
def d3_collapse_multi_edges(spark, d):
    return graph.collapse_multi_edges(P.edges(spark, d), P.TYPES).select("src", "dst", "edge_type")


@query(INC + "SELECT DISTINCT center, edge_type FROM inc")
def p3_edge_types(spark, d):
    return graph.edge_types_of(P.edges(spark, d))


@query("SELECT 'P' || p_partkey AS gene FROM part")
def p1_all_genes(spark, d):
    return P.table(spark, d, "part").select(P.gene("p_partkey").alias("gene"))


@query("SELECT 'P' || k AS gene, coalesce(p_name, 'Unknown') AS name, p_partkey IS NOT NULL AS found FROM (SELECT vec_id AS k FROM embeddings) LEFT JOIN part ON p_partkey = k")
def p2_gene_info(spark, d):
    e = P.table(spark, d, "embeddings").select(F.col("vec_id").alias("k"))
    return e.join(P.table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name"), "k", "left").select(F.concat(F.lit("P"), F.col("k").cast("string")).alias("gene"), F.coalesce("p_name", F.lit("Unknown")).alias("name"), F.col("p_name").isNotNull().alias("found"))


# ---- scoring and selection -------------------------------------------------

#: Scores of the ten best-scored interaction partners and of all other edges'
#: capped neighbours; the task's genes are those with an embedding of label 0.
SCORED = INC.rstrip() + ",\n" + P.SQL["nodes"] + ",\n" + P.SQL["emb"] + """,
deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1),
nb0 AS (SELECT *, row_number() OVER (PARTITION BY center, edge_type ORDER BY coalesce(score, 0) DESC, neighbor, direction) AS rank FROM inc),
nb AS (SELECT center, neighbor, edge_type, direction FROM nb0 WHERE rank <= 10),
lst AS (SELECT *, row_number() OVER (PARTITION BY center, neighbor ORDER BY edge_type DESC, direction DESC) AS r FROM nb),
ema AS (SELECT edge_type, ema FROM (VALUES ('PPI', 0.2::double), ('GO', -0.1::double), ('TRRUST', 0.4::double)) t(edge_type, ema)),
s0 AS (SELECT l.center, l.neighbor, l.edge_type, l.direction, coalesce(degree, 0) AS degree, t.id IS NOT NULL AS in_task, node_label, ec.emb AS ec,
  en.emb AS en, ema.ema
  FROM lst l LEFT JOIN deg ON node = neighbor LEFT JOIN (SELECT id FROM emb WHERE label = 0) t ON t.id = neighbor LEFT JOIN nodes ON node_id =
  neighbor
  LEFT JOIN emb en ON en.id = neighbor LEFT JOIN emb ec ON ec.id = center LEFT JOIN ema ON ema.edge_type = l.edge_type WHERE r = 1),
s1 AS (SELECT *, greatest(0.0::double, least(1.0::double, least(ln(1.0::double + degree) / ln(501.0::double), 1.0::double) * 0.4::double + CASE
  edge_type WHEN 'PPI' THEN 0.7::double WHEN 'TRRUST' THEN 0.75::double WHEN 'CellMarker' THEN 0.7::double ELSE 0.8::double END * 0.4::double +
  0.1::double
    - CASE WHEN degree > 100 AND NOT in_task THEN least((degree - 100) / 400.0::double, 1.0::double) * 0.3::double ELSE 0.0::double END)) AS
  structural,
  CASE WHEN in_task THEN 1.0::double WHEN node_label = 'gene' THEN 0.4::double ELSE 0.2::double END AS task_relevance,
  CASE WHEN ec IS NULL THEN 0.5::double WHEN en IS NULL THEN 0.3::double ELSE (list_cosine_similarity(ec, en) + 1) / 2 END AS semantic,
  coalesce((ema + 1) / 2, 0.5::double) AS memory,
  0.4::double + 0.2::double + CASE WHEN ec IS NOT NULL AND en IS NOT NULL THEN 0.25::double ELSE 0.0::double END + 0.15::double AS confidence FROM
  s0),
sc AS (SELECT *, structural * 0.2::double + task_relevance * 0.35::double + semantic * 0.25::double + memory * 0.2::double AS raw FROM s1),
scores AS (SELECT * EXCLUDE (raw), round(raw, 9) AS total FROM sc)
"""


def scores(spark, d) -> DataFrame:
    """Scored neighbours, kept like the edges: many queries read them."""
    files = P._files(d, ["part", "embeddings", *(n for t in P.TYPES for n in P._INPUTS[t])])
    return kept(spark, "scores", files, lambda: _scores(spark, d))


def _scores(spark, d) -> DataFrame:
    e = P.edges(spark, d)
    near = graph.typed_neighbors(P.edges(spark, d, places=True), 10).select("center", "neighbor", "edge_type", "direction")
    emb = P.embeddings(spark, d)
    ema = spark.createDataFrame([("PPI", 0.2), ("GO", -0.1), ("TRRUST", 0.4)], "edge_type string, ema double")
    out = scoring.score_neighbors(near, graph.degrees(e), P.nodes(spark, d), emb.where("label = 0").select(F.col("id").alias("node")), emb, ema, n_rows=e.count())
    return out.withColumn("total", F.round("total", 9))


@query(SCORED + "SELECT center, neighbor, edge_type, direction, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("structural", "task_relevance", "semantic", "memory", "confidence", "total")) + " FROM scores")
def m6_neighbor_scores(spark, d):
    cols = ("structural", "task_relevance", "semantic", "memory", "confidence", "total")
    return rounded(scores(spark, d), *cols, places=9).select("center", "neighbor", "edge_type", "direction", *cols)


@query(SCORED + """SELECT center, neighbor, rank FROM (SELECT center, neighbor, row_number() OVER (PARTITION BY center ORDER BY total DESC, neighbor) AS rank FROM scores
  WHERE total >= 0.45) WHERE rank <= 5""")
def t1_top_neighbors(spark, d):
    s = scores(spark, d).where("total >= 0.45")
    w = Window.partitionBy("center").orderBy(F.desc("total"), "neighbor")
    return s.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("center", "neighbor", "rank")


@query(SCORED + """, b AS (SELECT *, CASE WHEN total >= 0.7 THEN 'high' WHEN total >= 0.4 THEN 'medium' ELSE 'low' END AS band FROM scores) SELECT center, neighbor,
  band, row_number() OVER (PARTITION BY center, band ORDER BY total DESC, neighbor) AS rank FROM b""")
def t2_relevance_bands(spark, d):
    return scoring.by_relevance(scores(spark, d)).select("center", "neighbor", "band", "rank")


STATS = """SELECT center, count(*) AS n_total, count(*) FILTER (WHERE sel) AS n_selected, count(*) FILTER (WHERE NOT sel) AS n_excluded, round(count(*) FILTER
  (WHERE sel) / count(*), 6) AS selection_rate, round(avg(total) FILTER (WHERE sel), 6) AS avg_selected, round(min(total) FILTER (WHERE sel), 6) AS
  min_selected, round(avg(total) FILTER (WHERE NOT sel), 6) AS avg_excluded FROM x GROUP BY 1"""


def _stats(selected: DataFrame) -> DataFrame:
    return rounded(scoring.selection_stats(selected), "selection_rate", "avg_selected", "min_selected", "avg_excluded")


@query(SCORED + ", x AS (SELECT *, true AS sel FROM scores) " + STATS)
def t3_select_all(spark, d):
    return _stats(scoring.select(scores(spark, d)))


@query(SCORED + ", x AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY total DESC, neighbor) <= 20 AS sel FROM scores) " + STATS)
def t4_select_top_k(spark, d):
    return _stats(scoring.select(scores(spark, d), "top_k", 0))


@query(SCORED + ", x AS (SELECT *, total >= 0.4 AS sel FROM scores) " + STATS)
def t5_select_threshold(spark, d):
    return _stats(scoring.select(scores(spark, d), "threshold"))


@query(SCORED + ", x AS (SELECT *, neighbor NOT IN (SELECT 'HP:' || o_orderpriority FROM orders) AS sel FROM scores) " + STATS)
def t6_select_exclude(spark, d):
    gone = P.table(spark, d, "orders").select(F.concat(F.lit("HP:"), "o_orderpriority").alias("neighbor")).distinct()
    return _stats(scoring.select(scores(spark, d), "exclude", exclude=gone))


T7 = SCORED + """, t AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY total DESC, neighbor) <= 20 AS s0 FROM scores), n AS (SELECT *, sum(s0::int) OVER
  (PARTITION BY center, edge_type ORDER BY total DESC, neighbor ROWS UNBOUNDED PRECEDING) AS n FROM t), x AS (SELECT *, s0 AND n <= CASE edge_type
  WHEN 'PPI' THEN 4 WHEN 'GO' THEN 2 ELSE 1000000 END AS sel FROM n) """


@query(T7 + STATS)
def t7_per_type_limits(spark, d):
    return _stats(scoring.select(scores(spark, d), "top_k", 20, per_type={"PPI": 4, "GO": 2}))


@query(T7 + "SELECT DISTINCT neighbor FROM x WHERE sel")
def t10_selected_ids(spark, d):
    return scoring.select(scores(spark, d), "top_k", 20, per_type={"PPI": 4, "GO": 2}).where("selected").select("neighbor").distinct()


@query(T7 + "SELECT count(DISTINCT center) AS genes, count(*) AS total, count(*) FILTER (WHERE sel) AS selected, round(count(*) FILTER (WHERE sel) / count(*), 6) AS rate FROM x")
def a10_selection_summary(spark, d):
    s = scoring.select(scores(spark, d), "top_k", 20, per_type={"PPI": 4, "GO": 2})
    per = s.groupBy("center").agg(F.count("*").alias("t"), F.count_if("selected").alias("s"))
    return per.agg(F.count("*").alias("genes"), F.sum("t").alias("total"), F.sum("s").alias("selected")).withColumn("rate", F.round(F.col("selected") / F.col("total"), 6))


@query(SCORED + """, own AS (SELECT neighbor, avg(total) AS own, count(DISTINCT center) AS n FROM scores GROUP BY 1), pr AS (SELECT DISTINCT edge_type, neighbor FROM
  scores),
a AS (SELECT edge_type, avg(own) AS avg_score, count(*) AS n_unique, count(*) * 30 AS est_tokens FROM pr JOIN own USING (neighbor) GROUP BY 1),
b AS (SELECT edge_type, count(*) AS n_rows, count(*) FILTER (WHERE total >= 0.7) AS n_high, count(*) FILTER (WHERE total < 0.7 AND total >= 0.4) AS
  n_medium, count(*) FILTER (WHERE total < 0.4) AS n_low FROM scores GROUP BY 1)
SELECT edge_type, n_rows, n_high, n_medium, n_low, round(avg_score, 6) AS avg_score, n_unique, est_tokens FROM a JOIN b USING (edge_type)""")
def a1_neighbor_stats(spark, d):
    return rounded(scoring.neighbor_stats(scores(spark, d))[0], "avg_score")


@query(SCORED + """, own AS (SELECT neighbor, round(avg(total), 6) AS avg_score, count(DISTINCT center) AS n FROM scores GROUP BY 1)
SELECT neighbor, n FROM own WHERE n >= 3 ORDER BY n DESC, avg_score, neighbor LIMIT 10""")
def a2_frequent_neighbors(spark, d):
    s = scores(spark, d)
    own = s.groupBy("neighbor").agg(F.round(F.avg("total"), 6).alias("avg_score"), F.countDistinct("center").alias("n"))
    return own.where("n >= 3").orderBy(F.desc("n"), "avg_score", "neighbor").limit(10).select("neighbor", "n")
