"""Queries that filter, render, retrieve and evaluate, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import leakage as L
from graphloom.functions import llm_client as L2
from graphloom.operators import clustering as C
from graphloom.operators import evaluation as E
from graphloom.operators import experiments as X
from graphloom.operators import identifiers as I
from graphloom.operators import rendering as R
from graphloom.operators import retrieval as V
from graphloom.operators import sampling as Sa
from graphloom.operators import tasks as T
from graphloom.operators.scoring import dot, norm
from graphloom.plans import projection as P
from graphloom.plans.projection import with_sql
from graphloom.plans.queries import query, rounded
from graphloom.sources import biofiles as S

# ---- leakage ---------------------------------------------------------------

#: Sentences that the queries hang on whole documents, by doc_id.
HINTS = (
    " This gene is essential.", " It is a known oncogene, and highly conserved.", " I believe that this one is dosage-sensitive. .", " Yes, this gene is a marker for T cells,, ok.",
    " It participates in repair and regulates growth.", " It does not interact with P7.", " No leak here.",
)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def descriptions(spark, d):
    hint = F.element_at(F.array(*[F.lit(h) for h in HINTS]), (F.pmod("doc_id", F.lit(len(HINTS))) + 1).cast("int"))
    return P.table(spark, d, "documents").select("doc_id", F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "x"), hint).alias("text"))


DESC = "WITH descs AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', 'x', 'g') || ([" + ", ".join(map(_q, HINTS)) + f"])[doc_id % {len(HINTS)} + 1] AS text FROM documents)"
_steps, _prev = [], "SELECT doc_id, text, text AS t, 0 AS n, []::varchar[] AS r FROM descs"
for _k, (_p, _why) in enumerate(L.FORBIDDEN):
    _hits = f"len(regexp_extract_all(t, {_q('(?i)' + _p)}))"
    _steps.append(f"""f{_k} AS (SELECT doc_id, text, regexp_replace(t, {_q(_p)}, '', 'gi') AS t, n + {_hits} AS n, CASE WHEN {_hits} > 0 THEN list_append(r, {_q(_why)})
  ELSE r END AS r FROM ({_prev}))""")
    _prev = f"SELECT * FROM f{_k}"
_body = "t"
for _p, _by in L.CLEANUPS:
    _body = f"regexp_replace({_body}, {_q(_p)}, {_q(_by)}, 'g')"
FILTER = DESC + ", " + ", ".join(_steps) + f", out AS (SELECT doc_id, text, trim({_body}) AS filtered, n AS changes, r AS reasons FROM f{len(L.FORBIDDEN) - 1}) "


@query(FILTER + "SELECT doc_id, md5(filtered) AS filtered_md5, len(filtered) AS n_chars, changes::bigint AS changes, array_to_string(reasons, ';') AS reasons FROM out")
def x1_leakage_filter(spark, d):
    out = L.filtered(descriptions(spark, d))
    return out.select("doc_id", F.md5(F.col("filtered").cast("binary")).alias("filtered_md5"), F.length("filtered").cast("long").alias("n_chars"), "changes", F.array_join("reasons", ";").alias("reasons"))


_issues = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {_q(p)}, 'i') THEN {_q(w)} END" for p, w in L.FORBIDDEN) + "], lambda x: x IS NOT NULL)"
_signals = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {_q(p)}, 'i') THEN {_q(w)} END" for p, w in L.SIGNALS) + "], lambda x: x IS NOT NULL)"


@query(DESC + f" SELECT doc_id, array_to_string({_issues}, ';') AS issues, len({_issues}) = 0 AS safe FROM descs")
def x3_validate(spark, d):
    return descriptions(spark, d).select("doc_id", F.array_join(L.issues(F.col("text")), ";").alias("issues"), L.is_safe(F.col("text")).alias("safe"))


@query(DESC + f" SELECT doc_id, array_to_string({_signals}, ';') AS signals FROM descs")
def x4_implicit_signals(spark, d):
    return descriptions(spark, d).select("doc_id", F.array_join(L.signals(F.col("text")), ";").alias("signals"))


@query(FILTER + f"""SELECT doc_id, changes::bigint + CASE WHEN regexp_matches(filtered, {_q(L.PAIR_ANSWER)}, 'i') THEN 1 ELSE 0 END AS changes,
  md5(trim(regexp_replace(filtered, {_q(L.PAIR_ANSWER)}, '', 'gi'))) AS filtered_md5 FROM out""")
def x5_sanitize_for_task(spark, d):
    return L.filtered(descriptions(spark, d), task="ppi").select("doc_id", "changes", F.md5(F.col("filtered").cast("binary")).alias("filtered_md5"))


# ---- rendering -------------------------------------------------------------

#: Fixed decimals in SQL, as ``rendering.fixed`` has them.
def fixed_sql(x: str, places: int) -> str:
    return f"cast(cast(round(cast({x} AS decimal(28,9)), {places}) AS decimal(28,{places})) AS varchar)"


PPI_TEXT = "CASE WHEN coalesce(score, 0) < 1 THEN cast(cast(floor(coalesce(score, 0) * 1000) AS bigint) AS varchar) ELSE " + fixed_sql("score", 1) + " END"
_heads = " ".join("WHEN '" + k + "' THEN '" + v[0].split("{n}")[0] + "' || n || '" + v[0].split("{n}")[1] + "'" for k, v in R.SECTIONS.items())
SECTIONS = with_sql("all_edges", "all_nodes").rstrip() + f""",
it AS (SELECT src AS center, dst AS neighbor, edge_type AS section, score, evidence FROM edges
  UNION ALL SELECT dst, src, CASE edge_type WHEN 'TRRUST' THEN 'TRRUST_IN' ELSE 'PPI' END, score, evidence FROM edges WHERE edge_type IN ('PPI',
  'TRRUST')),
pl AS (SELECT *, CASE WHEN section IN ('PPI', 'GTEx') THEN -coalesce(score, 0) ELSE 0 END AS place FROM it),
rk AS (SELECT *, row_number() OVER (PARTITION BY center, section ORDER BY place, neighbor) AS r, count(*) OVER (PARTITION BY center, section) AS n
  FROM pl),
ln AS (SELECT center, section, r, n, CASE section WHEN 'PPI' THEN neighbor || ' (confidence score: ' || {PPI_TEXT} || ')'
    WHEN 'TRRUST' THEN neighbor || ' (' || coalesce(evidence, 'unknown') || ')' WHEN 'TRRUST_IN' THEN neighbor || ' (' || coalesce(evidence,
  'unknown') || ')'
    WHEN 'CellMarker' THEN name || ' (tissue: ' || evidence || ')' WHEN 'OMIM' THEN name || coalesce(' (' || evidence || ')', '')
    WHEN 'GTEx' THEN name || ' (TPM: ' || {fixed_sql("score", 1)} || ', specificity: ' || {fixed_sql("cast(evidence AS double) / 1000", 2)} || ')'
    WHEN 'CORUM' THEN name || ' (' || evidence || ' subunits)' ELSE name END AS line
  FROM (SELECT rk.* EXCLUDE (neighbor), neighbor, coalesce(name, neighbor) AS name FROM rk LEFT JOIN nodes ON node_id = neighbor WHERE r <= CASE WHEN
  section LIKE 'TRRUST%' THEN 5 ELSE 10 END)),
tp AS (SELECT center, section, max(n) AS n, count(*) AS k, string_agg('  ' || r || '. ' || line, chr(10) ORDER BY r) AS body FROM ln GROUP BY 1, 2),
said AS (SELECT center, section, n, CASE section {_heads} END || chr(10) || body || CASE WHEN n > k THEN chr(10) || '  ... and ' || (n - k) || ' more'
  ELSE '' END AS text FROM tp)
"""


def section_texts(spark, d):
    return R.sections(P.edges(spark, d, P.ALL_TYPES), P.nodes(spark, d, P.ALL_TYPES))


@query(SECTIONS + "SELECT center, section, n, text FROM said")
def x7_sections(spark, d):
    return section_texts(spark, d)


_info = ",\n".join(
    ("coalesce(nullif(concat_ws(chr(10), max(text) FILTER (WHERE section = 'TRRUST'), max(text) FILTER (WHERE section = 'TRRUST_IN')), '')" if s == "TRRUST" else f"coalesce(max(text) FILTER (WHERE section = '{s}')")
    + f", '{R.SECTIONS[s][1]}') AS {c}"
    for c, s in R.INFO.items()
)
GENE_TEXTS = SECTIONS.rstrip() + f", info AS (SELECT c.center, {_info} FROM (SELECT 'P' || p_partkey AS center FROM part) c LEFT JOIN said ON said.center = c.center GROUP BY 1)\n"


def gene_texts(spark, d):
    return R.subgraph_text(P.table(spark, d, "part").select(P.gene("p_partkey").alias("center")), section_texts(spark, d))


@query(GENE_TEXTS + "SELECT * FROM info")
def x7_format_subgraph(spark, d):
    return gene_texts(spark, d)


@query(GENE_TEXTS + "SELECT center, " + ", ".join(c if c in R.FEATURES["essential"] else f"'{R.LEFT_OUT}' AS {c}" for c in R.INFO) + " FROM info")
def x15_feature_selection(spark, d):
    g = gene_texts(spark, d)
    kept = R.feature_selection({c: F.col(c) for c in R.INFO}, "essential")
    return g.select("center", *[v.alias(k) for k, v in kept.items()])


_context = "[" + ", ".join(f"CASE WHEN {c} NOT LIKE '%Not included%' AND substr({c}, 1, 10) NOT LIKE '%No %' THEN '- {v}: ' || {c} END" for c, v in R.STYLE_LABELS.items()) + "]"
CONTEXT = GENE_TEXTS.rstrip() + f""", cx AS (SELECT center, list_filter({_context}, lambda x: x IS NOT NULL) AS l FROM info), ct AS (SELECT center, CASE WHEN len(l) > 0 THEN
  array_to_string(l, chr(10)) ELSE 'Limited information available.' END AS context FROM cx)\n"""


@query(CONTEXT + "SELECT center, context FROM ct")
def x18_style_context(spark, d):
    return gene_texts(spark, d).select("center", R.style_context({c: F.col(c) for c in R.STYLE_LABELS}).alias("context"))


#: A style of our own, for the query.
STYLES = {"narrative": "Tell of it as a story.\n{context}\n---\n{base_prompt}"}


@query(CONTEXT + """SELECT center, 'Tell of it as a story.' || chr(10) || context || chr(10) || '---' || chr(10) || 'Describe ' || center || '.' || chr(10) || chr(10) ||
  'Keep to facts.' || chr(10) || chr(10) || 'Emphasize these aspects if relevant: a, b, c, d, e' AS prompt FROM ct""")
def x17_styled_prompt(spark, d):
    context = R.style_context({c: F.col(c) for c in R.STYLE_LABELS})
    words = F.array(*[F.lit(w) for w in "abcdefg"])
    prompt = R.styled_prompt(F.concat(F.lit("Describe "), "center", F.lit(".")), context, "narrative", STYLES, "Keep to facts.", words)
    return gene_texts(spark, d).select("center", prompt.alias("prompt"))


SENT = with_sql("all_edges", "all_nodes").rstrip() + f""", sent AS (SELECT e.src, e.dst, e.edge_type, e.score, coalesce(a.name, e.src) AS x, coalesce(b.name, e.dst) AS y, e.evidence
  FROM edges e LEFT JOIN nodes a ON a.node_id = e.src LEFT JOIN nodes b ON b.node_id = e.dst),
said AS (SELECT src, dst, edge_type, score, CASE edge_type WHEN 'PPI' THEN x || ' physically interacts with ' || y || ' (confidence: ' ||
  {fixed_sql("coalesce(score, 0.0)", 2)} || ')'
  WHEN 'GO' THEN x || ' participates in biological process ' || y || ' (evidence: ' || evidence || ')'
  WHEN 'HPO' THEN x || ' is associated with phenotype ' || y || ' (frequency: ' || evidence || ')'
  WHEN 'TRRUST' THEN x || CASE evidence WHEN 'Activation' THEN ' activates expression of ' WHEN 'Repression' THEN ' represses expression of ' ELSE
  ' regulates ' END || y
  WHEN 'Reactome' THEN x || ' is involved in pathway ' || y WHEN 'CellMarker' THEN x || ' is a marker for ' || y || ' in ' || evidence
  WHEN 'OMIM' THEN x || ' is associated with disease ' || y WHEN 'GTEx' THEN x || ' is expressed in ' || y || ' (TPM: ' || {fixed_sql("score", 1)} ||
  ')'
  ELSE x || ' is part of protein complex ' || y END AS text FROM sent)
"""


@query(SENT + "SELECT src, dst, edge_type, text FROM said")
def x8_triplet_sentences(spark, d):
    return R.sentences(P.edges(spark, d, P.ALL_TYPES), P.nodes(spark, d, P.ALL_TYPES)).drop("score")


TRIPLETS = SENT.rstrip() + """, tri AS (SELECT 't_' || (row_number() OVER (ORDER BY substr(md5(src), 1, 3), src, dst, edge_type) - 1) AS triplet_id, src, dst, edge_type, text FROM
  said WHERE edge_type NOT IN ('PPI', 'CORUM'))\n"""


def all_triplets(spark, d):
    return R.triplets(P.edges(spark, d, P.ALL_TYPES), P.nodes(spark, d, P.ALL_TYPES), exclude=["PPI", "CORUM"])


@query(TRIPLETS + "SELECT triplet_id, src, dst, edge_type, text FROM tri")
def x11_all_triplets(spark, d):
    return all_triplets(spark, d).drop("score")


@query(TRIPLETS + "SELECT src AS gene, triplet_id FROM tri UNION SELECT dst, triplet_id FROM tri")
def j15_triplet_membership(spark, d):
    return R.membership(all_triplets(spark, d))


@query("""WITH t AS (SELECT doc_id, 'P' || doc_id AS s, lang AS name, text, trim(split_part(coalesce(text, ''), '.', 1), ' ') AS f FROM documents)
SELECT doc_id, 'Gene ' || s || CASE WHEN name IS NOT NULL AND name <> '' AND name <> s THEN ' (' || name || ')' ELSE '' END
  || CASE WHEN len(f) > 20 THEN ' ' || f || '.' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN ' Task: which interact' ELSE '' END AS query FROM t""")
def x12_query_text(spark, d):
    task = F.when(F.col("doc_id") % 2 == 0, "which interact")
    return P.table(spark, d, "documents").select("doc_id", R.query_text(P.gene("doc_id"), F.col("lang"), F.col("text"), task).alias("query"))


@query("""SELECT doc_id, CASE WHEN len(text) > 10 THEN CASE WHEN len(text) >= 200 THEN regexp_replace(substr(text, 1, 200), ' [^ ]*$', '') || '...' ELSE text
  END END AS description FROM documents""")
def x9_short_description(spark, d):
    return P.table(spark, d, "documents").select("doc_id", R.short_description(F.col("text")).alias("description"))


@query("""SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) > 5 THEN array_to_string(string_split(text, chr(10))[1:5], chr(10)) || chr(10) ||
  '... (truncated to 5 items)' WHEN len(string_split(text, ', ')) > 5 THEN array_to_string(string_split(text, ', ')[1:5], ', ') || ', ... (' ||
  (len(string_split(text, ', ')) - 5) || ' more)' ELSE text END AS lines FROM documents""")
def x14_context_window(spark, d):
    return P.table(spark, d, "documents").select("doc_id", R.context_window(F.col("text"), "minimal").alias("lines"))


_bands = """CASE WHEN metric >= 0.95 THEN 'EXCEPTIONAL - Outstanding strategy performance.' WHEN metric >= 0.92 THEN
  'EXCELLENT - The strategy is working very well.' WHEN metric >= 0.88 THEN 'VERY GOOD - Strong performance with minor room for improvement.' WHEN
  metric >= 0.85 THEN 'GOOD - The strategy is effective.' WHEN metric >= 0.75 THEN 'MODERATE - There is room for improvement.' WHEN metric >= 0.65
  THEN 'BELOW AVERAGE - The strategy needs changes.' WHEN metric >= 0.55 THEN 'POOR - The strategy needs significant changes.' ELSE
  'VERY POOR - Consider a major strategy revision.' END"""


@query(with_sql("history").rstrip() + f""", b AS (SELECT *, max(metric) OVER (PARTITION BY task ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM hist)
SELECT task, iteration, 'Performance: ' || {_bands} || CASE WHEN best IS NULL THEN '' WHEN metric - best > 0.001::double THEN ' (↑' || printf('%.4f',
  metric - best) || ' from best, NEW BEST!)' WHEN metric - best < -0.01::double THEN ' (↓' || printf('%.4f', best - metric) || ' from best)' WHEN
  metric - best < -0.001::double THEN ' (↓' || printf('%.4f', best - metric) || ' from best, minor decline)' ELSE ' (≈ best performance)' END AS
  feedback FROM b""")
def x28_feedback(spark, d):
    h = P.history(spark, d)
    w = Window.partitionBy("task").orderBy("iteration").rowsBetween(Window.unboundedPreceding, -1)
    return h.withColumn("best", F.max("metric").over(w)).select("task", "iteration", R.feedback(F.col("metric"), F.col("best")).alias("feedback"))


@query("""SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k, greatest(10, least(200, coalesce(cast(json_extract_string(props, '$.k') AS
  bigint), 50))) AS max_neighbors FROM events""")
def x23_strategy_json(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return P.table(spark, d, "events").select("event_id", k.alias("k"), F.greatest(F.lit(10), F.least(F.lit(200), F.coalesce(k, F.lit(50)))).cast("long").alias("max_neighbors"))


# ---- retrieval -------------------------------------------------------------

#: Edges of every type between genes with vectors; a triplet's vector is the
#: target's, a query's is the gene's own.
TRIP = with_sql("trrust", "ppi", "emb").rstrip() + """,
tr AS (SELECT src || '>' || dst || ':' || edge_type AS id, src, dst, edge_type, score AS conf FROM (SELECT * FROM ppi UNION ALL SELECT * FROM trrust)),
unit AS (SELECT id, list_transform(emb, lambda x: x / greatest(sqrt(list_dot_product(emb, emb)), 1e-8::double)) AS emb FROM emb),
idx AS (SELECT tr.*, unit.emb FROM tr JOIN unit ON unit.id = tr.dst),
qs AS (SELECT id AS query_id, emb AS q_emb FROM unit WHERE cast(substr(id, 2) AS bigint) % 100 = 0),
sc AS (SELECT query_id, idx.id, src, dst, edge_type, conf, round(list_dot_product(emb, q_emb), 9) AS score FROM idx, qs),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc)
"""


def _found(spark, d, k):
    unit = V.normalised(P.embeddings(spark, d).select("id", "emb"))
    e = P.edges(spark, d, ("PPI", "TRRUST"))
    e = e.select(F.concat("src", F.lit(">"), "dst", F.lit(":"), "edge_type").alias("id"), F.col("dst").alias("key"), "src", "dst", "edge_type", F.col("score").alias("conf"))
    queries = unit.where(F.substring("id", 2, 20).cast("long") % 100 == 0).select(F.col("id").alias("query_id"), F.col("emb").alias("q_emb"))
    return V.top_k_of(queries, unit.select(F.col("id").alias("key"), "emb"), e, k).drop("key")


@query(TRIP + "SELECT query_id, id, rank, score FROM rk WHERE rank <= 10")
def v2_top_k(spark, d):
    return _found(spark, d, 10).select("query_id", "id", "rank", "score")


@query(TRIP + """, f AS (SELECT * FROM rk WHERE rank <= 20 AND score >= 0.3 AND edge_type = 'PPI') SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER
  BY rank) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10""")
def v3_filtered(spark, d):
    return V.filtered(_found(spark, d, 20), 10, (F.col("score") >= 0.3) & (F.col("edge_type") == "PPI")).select("query_id", "id", "rank")


@query(TRIP + """, f AS (SELECT * FROM rk WHERE rank <= 30 AND (src = query_id OR dst = query_id)) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER
  BY rank) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10""")
def v3_connected(spark, d):
    return V.filtered(_found(spark, d, 30), 10, (F.col("src") == F.col("query_id")) | (F.col("dst") == F.col("query_id"))).select("query_id", "id", "rank")


@query(TRIP + """, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, edge_type ORDER BY rank) AS rd, min(rank) OVER (PARTITION BY query_id, edge_type) AS fi
  FROM rk WHERE rank <= 30),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rd, fi) AS turn FROM f) SELECT query_id, id, row_number() OVER (PARTITION BY
  query_id ORDER BY score DESC, rank) AS rank FROM t WHERE turn <= 10""")
def v5_diverse(spark, d):
    return V.diverse(_found(spark, d, 30), 10).select("query_id", "id", "rank")


@query(TRIP + """, f AS (SELECT *, round(score * 0.7::double + least(CASE WHEN src = query_id OR dst = query_id THEN 0.5::double ELSE 0.0::double END + CASE WHEN
  edge_type = 'PPI' THEN conf * 0.3::double ELSE 0.0::double END + CASE edge_type WHEN 'TRRUST' THEN 0.25::double ELSE 0.15::double END, 1.0::double)
  * (1 - 0.7::double), 9) AS s FROM rk WHERE rank <= 20)
SELECT query_id, id, r AS rank, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS r FROM f) WHERE r <= 10""")
def v6_hybrid(spark, d):
    return V.hybrid(_found(spark, d, 20).withColumn("gene", F.col("query_id")), 10).select("query_id", "id", "rank", "score")


@query(TRIP + """, f AS (SELECT query_id, edge_type, id AS text, score, rank, row_number() OVER (PARTITION BY query_id, edge_type ORDER BY rank) AS r FROM rk WHERE
  rank <= 30),
g AS (SELECT query_id, edge_type, count(*) AS k, string_agg('- ' || text || ' (relevance: ' || printf('%.2f', score) || ')', chr(10) ORDER BY r) AS b
  FROM f WHERE r <= 10 GROUP BY 1, 2)
SELECT query_id, string_agg('### ' || CASE edge_type WHEN 'PPI' THEN 'Protein-Protein Interactions' ELSE 'Regulatory Relationships' END || ' (' || k
  || ' items):' || chr(10) || b, chr(10) || chr(10) ORDER BY list_position(['HPO','TRRUST','GO','PPI'], edge_type)) AS context FROM g GROUP BY 1""")
def x13_contexts(spark, d):
    return R.contexts(_found(spark, d, 30).withColumn("text", F.col("id")))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) AS length FROM embeddings")
def v1_lengths(spark, d):
    return P.table(spark, d, "embeddings").select("vec_id", F.round(norm(F.transform("embedding", lambda x: x.cast("double"))), 6).alias("length"))


LONG = with_sql("emb").rstrip() + ", lg AS (SELECT id, label, unnest(emb) AS x, generate_subscripts(emb, 1) - 1 AS dim FROM emb)"


@query(LONG + """, v AS (SELECT dim, var_pop(x) AS v FROM lg GROUP BY 1), l AS (SELECT sqrt(list_dot_product(emb, emb)) AS l, len(emb) AS dd FROM emb) SELECT (SELECT
  count(*) FROM l) AS n, (SELECT max(dd) FROM l) AS dim, (SELECT round(avg(l), 6) FROM l) AS mean_norm, (SELECT round(stddev_pop(l), 6) FROM l) AS
  std_norm, round(avg(v), 6) AS mean_var, round(max(v), 6) AS max_var, round(min(v), 6) AS min_var FROM v""")
def a4_embedding_stats(spark, d):
    return rounded(V.embedding_stats(P.embeddings(spark, d)), "mean_norm", "std_norm", "mean_var", "max_var", "min_var")


@query(LONG + """, m AS (SELECT dim, avg(x) AS m FROM lg GROUP BY 1), c AS (SELECT id, dim, x - m AS y FROM lg JOIN m USING (dim)), n AS (SELECT id,
  greatest(sqrt(sum(y * y)), 1e-8::double) AS n FROM c GROUP BY 1) SELECT id, round(sum(y / n * (dim + 1)), 6) AS checksum FROM c JOIN n USING (id)
  GROUP BY 1""")
def m9_centred(spark, d):
    weighed = F.aggregate(F.transform("emb", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return V.centred(P.embeddings(spark, d)).select("id", F.round(weighed, 6).alias("checksum"))


_UNIT = "((('0x' || substr(md5('0|' || id || '|' || dim || '|{}'), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)"


@query(LONG + f""", m AS (SELECT dim, avg(x) AS m FROM lg GROUP BY 1), c AS (SELECT id, dim, x - m + 0.05::double * sqrt(ln({_UNIT.format('a')}) * -2.0::double) * cos({_UNIT.format('b')} * 2 *
  pi()) AS y FROM lg JOIN m USING (dim)), n AS (SELECT id, greatest(sqrt(sum(y * y)), 1e-8::double) AS n FROM c GROUP BY 1) SELECT id, round(sum(y / n *
  (dim + 1)), 6) AS checksum FROM c JOIN n USING (id) GROUP BY 1""")
def m9_noised(spark, d):
    weighed = F.aggregate(F.transform("emb", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return V.centred(P.embeddings(spark, d), spread=0.05).select("id", F.round(weighed, 6).alias("checksum"))


# ---- evaluation ------------------------------------------------------------

#: A deterministic score for each labelled vector: its product with the first
#: class's mean vector; y marks class 0.
SCORE = LONG + """, cen AS (SELECT label, dim, avg(x) AS c FROM lg GROUP BY 1, 2), pr AS (SELECT id, lg.label AS truth, cen.label AS cand, round(sum(x * c), 9) AS s
  FROM lg JOIN cen USING (dim) GROUP BY 1, 2, 3), y AS (SELECT id, CASE WHEN truth = 0 THEN 1 ELSE 0 END AS y, s AS score FROM pr WHERE cand = 0), pd
  AS (SELECT id, truth, cand AS predicted FROM pr QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, cand) = 1)"""


def _products(spark, d):
    e = P.embeddings(spark, d)
    long = e.select("id", F.col("label").alias("truth"), F.posexplode("emb").alias("dim", "x"))
    cent = long.groupBy(F.col("truth").alias("cand"), "dim").agg(F.avg("x").alias("c"))
    mean = cent.groupBy("cand").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "c"))), lambda x: x["c"]).alias("mean"))
    # one row for each class
    return e.crossJoin(F.broadcast(mean)).select("id", F.col("label").alias("truth"), "cand", F.round(dot(F.col("emb"), F.col("mean")), 9).alias("s"))


def _scored(spark, d):
    return _products(spark, d).where("cand = 0").select("id", F.when(F.col("truth") == 0, 1).otherwise(0).alias("y"), F.col("s").alias("score"), F.lit("all").alias("g"))


def _predicted(spark, d):
    w = Window.partitionBy("id").orderBy(F.desc("s"), "cand")
    return _products(spark, d).withColumn("r", F.row_number().over(w)).where("r = 1").select("id", "truth", F.col("cand").alias("predicted"), F.lit("all").alias("g"))


@query(SCORE + """, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::double AS r FROM y) SELECT round((sum(r) FILTER
  (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r""")
def e8_auc(spark, d):
    return rounded(E.auc(_scored(spark, d), ["g"]), "auc").select("auc")


@query(SCORE + """, s AS (SELECT score, count(*) AS n, sum(y) AS p FROM y GROUP BY 1), c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY
  score DESC) AS seen, sum(p) OVER () AS al FROM s) SELECT round(sum(p / al * tp / seen), 6) AS ap FROM c""")
def e8_average_precision(spark, d):
    return rounded(E.average_precision(_scored(spark, d), ["g"]), "ap").select("ap")


@query(SCORE + """, o AS (SELECT cand, (truth = cand)::int AS y, s FROM pr), r AS (SELECT cand, y, rank() OVER w + (count(*) OVER (PARTITION BY cand, s) - 1) / 2.0::double AS
  r FROM o WINDOW w AS (PARTITION BY cand ORDER BY s)), u AS (SELECT cand, sum(r) FILTER (WHERE y = 1) AS s, sum(y) AS n1, count(*) - sum(y) AS n0
  FROM r GROUP BY 1) SELECT round(avg((s - n1 * (n1 + 1) / 2.0::double) / (n1 * n0)), 6) AS auc FROM u WHERE n1 > 0 AND n0 > 0""")
def e8_one_vs_rest(spark, d):
    return rounded(E.one_vs_rest(_products(spark, d).select("truth", F.col("cand").alias("class"), F.col("s").alias("score"), F.lit(1).alias("g")), ["g"]), "auc").select("auc")


@query(SCORE + """, k AS (SELECT DISTINCT truth AS c FROM pd UNION SELECT predicted FROM pd), f AS (SELECT c, (SELECT count(*) FROM pd WHERE truth = c AND predicted =
  c) AS tp, (SELECT count(*) FROM pd WHERE truth = c) AS t, (SELECT count(*) FROM pd WHERE predicted = c) AS p FROM k) SELECT round(sum(tp) / sum(t),
  6) AS accuracy, round(avg(tp * 2.0::double / greatest(t + p, 1)), 6) AS macro_f1 FROM f""")
def e8_accuracy_f1(spark, d):
    return rounded(E.classification(_predicted(spark, d), ["g"]), "accuracy", "macro_f1").drop("g")


@query(SCORE + """, n AS (SELECT truth, predicted, count(*) AS n FROM pd GROUP BY 1, 2), a AS (SELECT truth, sum(n) AS a FROM n GROUP BY 1), b AS (SELECT predicted,
  sum(n) AS b FROM n GROUP BY 1), t AS (SELECT sum(n)::double AS t FROM n),
s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM n) AS cj, (SELECT sum(a * (a - 1) / 2.0) FROM a) AS ca, (SELECT sum(b * (b - 1) / 2.0) FROM b) AS cb,
  (SELECT -sum(a / t * ln(a / t)) FROM a, t) AS ha, (SELECT -sum(b / t * ln(b / t)) FROM b, t) AS hb, (SELECT sum(n / t * ln(n * t / (a * b))) FROM n
  JOIN a USING (truth) JOIN b USING (predicted), t) AS mi, t FROM t)
SELECT round((cj - ca * cb / (t * (t - 1) / 2)) / ((ca + cb) / 2 - ca * cb / (t * (t - 1) / 2)), 6) AS ari, round(mi / ha, 6) AS homogeneity, round(mi
  / hb, 6) AS completeness, round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 6) AS v_measure FROM s""")
def e10_label_agreement(spark, d):
    return rounded(E.clustering(_predicted(spark, d).withColumnRenamed("predicted", "cluster"), ["g"]), "ari", "homogeneity", "completeness", "v_measure").drop("g")


def _clustered(spark, d):
    e = P.embeddings(spark, d)
    k = e.select("label").distinct().count()
    return C.kmeans(e, max(1, k))[0]


def e10_kmeans(spark, d):
    """Every gene's cluster.  Fitted, so there is no SQL; tests hold it to numpy."""
    return rounded(_clustered(spark, d).select("id", "cluster", "distance2"), "distance2")


def e10_clustering(spark, d):
    """Measures of a k-means clustering, one cluster a class, against the classes
    and by itself."""
    from graphloom.sources.graph_store import written

    found = written(_clustered(spark, d).select("id", "emb", "label", "cluster").withColumn("g", F.lit(1)), "clusters")
    outer = E.clustering(found.select("g", F.col("label").alias("truth"), "cluster"), ["g"]).drop("g")
    inner = E.calinski_harabasz(found, "cluster", "emb").crossJoin(E.davies_bouldin(found, "cluster", "emb")).crossJoin(E.silhouette(found, "cluster", "emb"))  # one row each
    names = ("ari", "homogeneity", "completeness", "v_measure", "calinski_harabasz", "davies_bouldin", "silhouette")
    return rounded(outer.crossJoin(inner), *names)


query()(e10_kmeans)
query()(e10_clustering)

#: Lloyd's rounds from given centres: the genes with the ten smallest hashes.
_LLOYD = LONG + ", f AS (SELECT id, row_number() OVER (ORDER BY md5('7|' || id), id) - 1 AS k FROM emb QUALIFY k < 10), c0 AS (SELECT k, dim, x AS c FROM lg JOIN f USING (id))"
for _r in range(4):
    _LLOYD += f""", d{_r} AS MATERIALIZED (SELECT id, k, sum((x - c) * (x - c)) AS d FROM lg JOIN c{_r} USING (dim) GROUP BY 1, 2),
  n{_r} AS MATERIALIZED (SELECT id, arg_min(k, d) AS k, min(d) AS d FROM d{_r} GROUP BY 1),
  m{_r} AS (SELECT n{_r}.k, dim, avg(x) AS c FROM lg JOIN n{_r} USING (id) GROUP BY 1, 2),
  c{_r + 1} AS MATERIALIZED (SELECT k, dim, coalesce(m{_r}.c, c{_r}.c) AS c FROM c{_r} LEFT JOIN m{_r} USING (k, dim))"""


@query(_LLOYD + " SELECT id, k::bigint AS cluster, round(d, 6) AS distance2 FROM n3")
def e10_lloyd(spark, d):
    e = P.embeddings(spark, d)
    first = e.orderBy(F.md5(F.concat(F.lit("7|"), "id").cast("binary")), "id").select("emb").limit(10).collect()
    found = C.lloyd(e, [np.array([r.emb for r in first])], most=3, tol=-1.0)
    return rounded(C.assigned(e.select("id", "emb"), found.centres).drop("emb"), "distance2")


@query(LONG + """, c AS (SELECT label, dim, avg(x) AS c FROM lg GROUP BY 1, 2), w AS (SELECT sum((x - c) * (x - c)) AS w FROM lg JOIN c USING (label, dim)), t AS
  (SELECT sum(v) AS t FROM (SELECT var_pop(x) * count(*) AS v FROM lg GROUP BY dim)), k AS (SELECT count(DISTINCT label) AS k, count(*) AS n FROM emb)
  SELECT round((t - w) / (k - 1) / (w / (n - k)), 6) AS calinski_harabasz FROM w, t, k""")
def e10_variance_ratio(spark, d):
    return rounded(E.calinski_harabasz(P.embeddings(spark, d), "label", "emb"), "calinski_harabasz")


@query(with_sql("emb") + "SELECT id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id), id) - 1) % 5 AS fold FROM emb")
def e6_folds(spark, d):
    return E.folds(P.embeddings(spark, d).select("id", "label"), 5, "label", "id")


#: Vectors against those of the gene before: rows of a prediction task.
REG = LONG + """, p AS (SELECT a.id, a.dim, a.x AS truth, b.x AS predicted FROM lg a JOIN lg b ON a.dim = b.dim AND cast(substr(b.id, 2) AS bigint) =
  cast(substr(a.id, 2) AS bigint) - 1), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(truth) DESC, dim) AS r FROM p), m AS (SELECT
  id, coalesce(corr(truth, predicted), 0) AS corr, avg((truth - predicted) ** 2) AS mse, coalesce(corr(truth, predicted) FILTER (WHERE r <= 50), 0) AS
  de_corr, avg((truth - predicted) ** 2) FILTER (WHERE r <= 50) AS de_mse FROM r GROUP BY 1) """


def _regression(spark, d):
    e = P.embeddings(spark, d)
    nxt = e.select(F.concat(F.lit("P"), (F.substring("id", 2, 20).cast("long") + 1).cast("string")).alias("id"), F.col("emb").alias("p"))
    pairs = e.select("id", "emb").join(nxt, "id").select("id", F.posexplode(F.arrays_zip("emb", "p")).alias("place", "z")).select("id", "place", F.col("z.emb").alias("truth"), F.col("z.p").alias("predicted"))
    return E.regression(pairs, "id")


@query(REG + "SELECT id, round(corr, 6) AS corr, round(mse, 6) AS mse, round(de_corr, 6) AS de_corr, round(de_mse, 6) AS de_mse FROM m")
def e11_regression_rows(spark, d):
    return rounded(_regression(spark, d), "corr", "mse", "de_corr", "de_mse")


@query(REG + """SELECT round(avg(corr), 6) AS delta_correlation, round(avg(mse), 6) AS mse, round(sqrt(avg(mse)), 6) AS rmse, round(avg(de_corr), 6) AS
  de_correlation, round(avg(de_mse), 6) AS de_mse, round(stddev_pop(corr), 6) AS delta_correlation_std FROM m""")
def e11_regression_summary(spark, d):
    return rounded(E.regression_summary(_regression(spark, d)), "delta_correlation", "mse", "rmse", "de_correlation", "de_mse", "delta_correlation_std")


@query(with_sql("emb") + "SELECT label, count(*) AS n FROM emb GROUP BY 1")
def a8_class_distribution(spark, d):
    return P.embeddings(spark, d).groupBy("label").agg(F.count("*").alias("n"))


@query(with_sql("emb") + "SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS code FROM emb")
def e13_label_codes(spark, d):
    """Codes over distinct labels, joined back: no window over all rows."""
    e = P.embeddings(spark, d)
    codes = e.select("label").distinct().withColumn("code", (F.row_number().over(Window.orderBy("label")) - 1).cast("long"))
    return e.join(F.broadcast(codes), "label").select("id", "code")  # one row for each class


def e18_baselines(spark, d):
    """The four ways to describe a gene, each generated, encoded and evaluated: one
    row a method.  Labels are the first five classes of vectors against the others.
    Models are fitted, so there is no SQL; tests hold the parts to numpy."""
    labels = P.embeddings(spark, d).select(F.col("id").alias("gene"), (F.col("label") < 5).cast("int").alias("label"))
    nodes = P.nodes(spark, d, P.ALL_TYPES)
    genes = labels.select("gene").join(nodes.select(F.col("node_id").alias("gene"), "name", F.col("definition").alias("summary")), "gene", "left")
    texts = X.method_texts(genes, P.edges(spark, d, P.ALL_TYPES), nodes, L2.encoder(L2.HashingEncoder()))
    out = X.compared_methods(texts, labels, echo_client, L2.encoder(L2.HashingEncoder()))
    return rounded(out, "auc", "ap", "accuracy", "macro_f1", "gain")


def echo_client(prompts: list[str]) -> list[str]:
    """The offline generator of the comparison: what it was told, without the task."""
    return [p.split("\n", 1)[-1] for p in prompts]


query()(e18_baselines)


def e5_cross_validation(spark, d):
    data = P.embeddings(spark, d).select("id", F.when(F.col("label") < 5, 1).otherwise(0).alias("label"), "emb")
    return rounded(E.cross_validated(data), "auc", "ap")


query()(e5_cross_validation)


@query(with_sql("ppi", "emb").rstrip() + " SELECT src, dst, len(a.emb) + len(b.emb) AS n_features, round(a.emb[1] + b.emb[64], 6) AS probe FROM ppi JOIN emb a ON a.id = src JOIN emb b ON b.id = dst")
def j6_pair_features(spark, d):
    """Vectors travel as they are stored; they become doubles where their pair is."""
    e = P.table(spark, d, "embeddings").select(P.gene("vec_id").alias("id"), F.col("embedding").alias("emb"))
    p = P.edges(spark, d, ("PPI",)).join(e.select(F.col("id").alias("src"), F.col("emb").alias("a")), "src").join(e.select(F.col("id").alias("dst"), F.col("emb").alias("b")), "dst")
    x = p.select("src", "dst", F.transform(F.concat("a", "b"), lambda v: v.cast("double")).alias("x"))
    return x.select("src", "dst", F.size("x").cast("long").alias("n_features"), F.round(F.element_at("x", 1) + F.element_at("x", -1), 6).alias("probe"))


#: One draw's Feistel rounds, as ``sampling.permuted`` has them.
_HALF = "(SELECT ceil(log2(greatest(2, count(*) * (count(*) - 1) // 2)) / 2.0)::bigint FROM part)"
_F0 = "SELECT t, (t >> h) AS l, t & ((1::bigint << h) - 1) AS r, h FROM (SELECT unnest(range(least(1::bigint << (2 * h), (SELECT 12 * count(*) FROM ppi)))) AS t, h FROM hb)"
_FEISTEL = f"hb AS (SELECT {_HALF} AS h), f0 AS ({_F0})" + "".join(
    f", f{k + 1} AS (SELECT t, r AS l, xor(l, ('0x' || substr(md5('42|{k}|' || r), 1, 8))::bigint & ((1::bigint << h) - 1)) AS r, h FROM f{k})" for k in range(4)
)


@query(with_sql("ppi").rstrip() + f""", {_FEISTEL},
g AS (SELECT 'P' || p_partkey AS gene, row_number() OVER (ORDER BY substr(md5('42|P' || p_partkey), 1, 8), 'P' || p_partkey) - 1 AS k FROM part),
x AS (SELECT t, (l << h) | r AS x FROM f4), n AS (SELECT count(*) AS n FROM part), p AS (SELECT count(*) AS p FROM ppi),
y AS (SELECT t, x, floor((sqrt(x * 8 + 1.0) + 1) / 2)::bigint AS i FROM x, n WHERE x < n * (n - 1) // 2),
z AS (SELECT t, i, x - i * (i - 1) // 2 AS j FROM y),
w AS (SELECT t, least(a.gene, b.gene) AS g1, greatest(a.gene, b.gene) AS g2 FROM z JOIN g a ON a.k = i JOIN g b ON b.k = j),
o AS (SELECT w.* FROM w ANTI JOIN (SELECT least(src, dst) AS g1, greatest(src, dst) AS g2 FROM ppi) USING (g1, g2)),
s AS (SELECT *, row_number() OVER (ORDER BY t) AS r FROM o)
SELECT t AS draw, g1, g2 FROM s, n, p WHERE r <= least(floor(p * 1.5), n * (n - 1) // 2 - p)""")
def j14_sampled_pairs(spark, d):
    """Negative pairs, one and a half times as many as there are positive ones."""
    genes = P.table(spark, d, "part").select(P.gene("p_partkey").alias("gene"))
    return Sa.negative_pairs(genes, P.edges(spark, d, ("PPI",)).select(F.col("src").alias("g1"), F.col("dst").alias("g2")), 1.5)


@query(with_sql("ppi") + """SELECT 'P' || a AS gene_a, 'P' || b AS gene_b FROM (SELECT p_partkey AS a, (p_partkey * 7919 + 13) % (SELECT count(*) FROM part) + 1 AS b FROM part)
  WHERE a <> b AND NOT EXISTS (SELECT 1 FROM ppi WHERE src = 'P' || least(a, b) AND dst = 'P' || greatest(a, b))""")
def j14_negative_pairs(spark, d):
    """One hashed partner for each gene, without true pairs: no cross join."""
    part = P.table(spark, d, "part").select(F.col("p_partkey").alias("a"))
    n = part.agg(F.count("*").alias("n"))
    c = part.crossJoin(F.broadcast(n)).select("a", (F.pmod(F.col("a") * 7919 + 13, F.col("n")) + 1).alias("b")).where("a <> b")  # a one-row side
    key = c.select(P.gene("a").alias("gene_a"), P.gene("b").alias("gene_b"), P.gene_of(F.least("a", "b")).alias("src"), P.gene_of(F.greatest("a", "b")).alias("dst"))
    return key.join(P.edges(spark, d, ("PPI",)), ["src", "dst"], "left_anti").select("gene_a", "gene_b")


# ---- sources ---------------------------------------------------------------

@query("""WITH t AS (SELECT 'P' || l_partkey AS src, n_name AS tissue, cast(sum(l_quantity) AS double) AS tpm FROM lineitem JOIN supplier ON l_suppkey =
  s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
m AS (SELECT *, max(tpm) OVER (PARTITION BY src) AS top, count(*) OVER (PARTITION BY src) AS n FROM t), u AS (SELECT *, sum(1 - tpm / top) OVER
  (PARTITION BY src) AS lack FROM m)
SELECT src, tissue, round(tpm, 11) AS tpm, round(tpm / top, 11) AS relative, round(CASE WHEN n <= 1 THEN 0.0::double ELSE greatest(0.0::double,
  least(1.0::double, lack / greatest(n - 1, 1))) END, 11) AS tau FROM u WHERE tpm >= 1.0""")
def s33_tissue_specificity(spark, d):
    t = P.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")), "l_suppkey").join(P.table(spark, d, "nation"), "n_nationkey")
    long = t.groupBy(P.gene("l_partkey").alias("src"), F.col("n_name").alias("tissue")).agg(F.sum("l_quantity").cast("double").alias("tpm")).withColumn("pos", F.lit(0))
    return rounded(S.expression(long), "tpm", "relative", "tau", places=11)


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE
  l_returnflag = 'R') SELECT 'P' || coalesce(a.k, r.k) AS gene, CASE WHEN a.k IS NOT NULL AND r.k IS NOT NULL THEN 'bivalent' WHEN a.k IS NOT NULL
  THEN 'lys4_only' ELSE 'lys27_only' END AS state FROM a FULL JOIN r ON a.k = r.k""")
def s48_chromatin_states(spark, d):
    lines = P.table(spark, d, "lineitem")
    own = lambda f: lines.where(F.col("l_returnflag") == f).select(P.gene("l_partkey").alias("gene")).distinct()
    return S.chromatin_states(own("A"), own("R"))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE
  l_returnflag = 'R') SELECT 'P' || k AS gene, 1 AS label FROM a WHERE k NOT IN (SELECT k FROM r) UNION ALL SELECT 'P' || k, 0 FROM r WHERE k NOT IN
  (SELECT k FROM a)""")
def s63_two_lists(spark, d):
    lines = P.table(spark, d, "lineitem")
    own = lambda f: lines.where(F.col("l_returnflag") == f).select(P.gene("l_partkey").alias("gene"))
    return S.without_overlap(own("A"), own("R"))


@query("""WITH m AS (SELECT l_orderkey, 'P' || l_partkey AS src, l_linenumber, l_suppkey FROM lineitem), n AS (SELECT l_orderkey, count(DISTINCT src) AS
  subunit_count FROM m GROUP BY 1) SELECT DISTINCT src, 'CORUM:' || l_orderkey AS dst, 'order ' || l_orderkey AS complex_name, subunit_count FROM m
  JOIN n USING (l_orderkey)""")
def s39_complex_edges(spark, d):
    lines = P.table(spark, d, "lineitem").select("l_orderkey", P.gene("l_partkey").alias("g")).distinct()
    rows = lines.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("g")), ";").alias("subunits"))
    rows = rows.select(F.col("l_orderkey").cast("string").alias("complex_id"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("complex_name"), "subunits", F.lit("Human").alias("organism"), F.col("l_orderkey").alias("pos"))
    return S.corum_edges(rows).withColumn("subunit_count", F.col("subunit_count").cast("long"))


@query("""SELECT src, dst, evidence FROM (SELECT 'P' || l_partkey AS src, 'GO:' || l_shipdate::date AS dst, l_linestatus || l_returnflag AS evidence,
  row_number() OVER (PARTITION BY l_partkey, l_shipdate::date ORDER BY l_orderkey, l_linenumber, l_suppkey, l_linestatus, l_returnflag) AS r FROM
  lineitem) WHERE r = 1""")
def s12_first_annotation(spark, d):
    lines = P.table(spark, d, "lineitem").select(P.gene("l_partkey").alias("src"), F.concat(F.lit("GO:"), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("dst"), F.concat("l_linestatus", "l_returnflag").alias("evidence"), "l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus", "l_returnflag")
    return I.first_of(lines, ["src", "dst"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus", "l_returnflag"]).select("src", "dst", "evidence")


PW = """WITH e AS (SELECT DISTINCT l_partkey, c_mktsegment AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey =
  c_custkey), p AS (SELECT dst, count(DISTINCT l_partkey) AS n FROM e GROUP BY 1) """


@query(PW + "SELECT count(*) AS pathways, cast(sum(n) AS bigint) AS associations, round(avg(n), 6) AS avg_genes, max(n) AS max_genes FROM p")
def s22_pathway_stats(spark, d):
    return S.pathway_stats(P.edges(spark, d, ("Reactome",)))


@query("""WITH k AS (SELECT 'symbol' AS kind, p_name AS key, 'P' || p_partkey AS symbol, p_partkey AS pos FROM part UNION ALL SELECT 'alias', p_brand || '-' ||
  p_size, 'P' || p_partkey, p_partkey FROM part) SELECT kind, key, symbol FROM (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY pos DESC)
  AS r FROM k) WHERE r = 1""")
def p7_id_mapper(spark, d):
    part = P.table(spark, d, "part")
    k = part.select(F.lit("symbol").alias("kind"), F.col("p_name").alias("key"), P.gene("p_partkey").alias("symbol"), F.col("p_partkey").alias("pos"))
    k = k.unionByName(part.select(F.lit("alias").alias("kind"), F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("key"), P.gene("p_partkey").alias("symbol"), F.col("p_partkey").alias("pos")))
    return I.last_of(k, ["kind", "key"], ["pos"]).select("kind", "key", "symbol")


@query(with_sql("emb") + "SELECT 'p' || p_partkey AS symbol, (SELECT min(id) FROM emb WHERE upper(id) = 'P' || p_partkey) AS key FROM part")
def p5_embedding_keys(spark, d):
    symbols = P.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("symbol"))
    ids = P.embeddings(spark, d).select("id")
    cache = symbols.select("symbol", F.lit(None).cast("string").alias("ensembl")).where("false")
    return I.embedding_keys(symbols, ids, cache)


@query(with_sql("ppi", "emb") + "SELECT src FROM ppi UNION SELECT dst FROM ppi".replace("SELECT src FROM", "SELECT src AS gene FROM"))
def u2_task_genes(spark, d):
    p = P.edges(spark, d, ("PPI",))
    return p.select(F.col("src").alias("gene")).union(p.select("dst")).distinct()


@query("SELECT DISTINCT 'P' || p_partkey AS gene FROM part WHERE EXISTS (SELECT 1 FROM embeddings WHERE vec_id = p_partkey)")
def j12_task_genes_in_graph(spark, d):
    g = P.table(spark, d, "part").select(P.gene("p_partkey").alias("gene"))
    return g.join(P.embeddings(spark, d).select(F.col("id").alias("gene")), "gene", "left_semi")


@query("SELECT DISTINCT 'P' || p_partkey AS gene FROM part WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = p_partkey)")
def j13_candidate_negatives(spark, d):
    g = P.table(spark, d, "part").select(P.gene("p_partkey").alias("gene"))
    return g.join(P.embeddings(spark, d).select(F.col("id").alias("gene")), "gene", "left_anti")


#: Cells are customers, genes the parts they bought, expression the quantity.
CELL = with_sql("emb").rstrip() + """, x AS (SELECT o_custkey AS cell, 'P' || l_partkey AS gene, cast(sum(l_quantity) AS double) AS expr FROM lineitem JOIN orders ON l_orderkey =
  o_orderkey GROUP BY 1, 2), j AS (SELECT cell, gene, expr, emb, row_number() OVER (PARTITION BY cell ORDER BY expr DESC, gene) AS r, count(*) OVER
  (PARTITION BY cell) AS n FROM x JOIN emb ON id = gene WHERE expr > 0), u AS (SELECT cell, expr, unnest(emb) AS v, generate_subscripts(emb, 1) AS dim
  FROM j WHERE r <= 500 AND n >= 5), pl AS (SELECT cell, dim, sum(v * expr) / sum(expr) AS p FROM u GROUP BY 1, 2) SELECT cell, round(sum(p * dim), 6)
  AS checksum FROM pl GROUP BY 1"""


@query(CELL)
def a6_cell_pooling(spark, d):
    lines = P.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(P.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cell")), "l_orderkey")
    x = lines.groupBy("cell", P.gene("l_partkey").alias("id")).agg(F.sum("l_quantity").cast("double").alias("expr")).where("expr > 0").join(P.embeddings(spark, d).select("id", "emb"), "id")
    w = Window.partitionBy("cell")
    top = x.withColumn("r", F.row_number().over(w.orderBy(F.desc("expr"), "id"))).withColumn("n", F.count("*").over(w)).where("r <= 500 AND n >= 5")
    long = top.select("cell", "expr", F.posexplode("emb").alias("dim", "v"))
    pooled = long.groupBy("cell", "dim").agg((F.sum(F.col("v") * F.col("expr")) / F.sum("expr")).alias("p"))
    return rounded(pooled.groupBy("cell").agg(F.sum(F.col("p") * (F.col("dim") + 1)).alias("checksum")), "checksum")


@query("""WITH x AS (SELECT o_orderpriority AS cond, p_brand AS gene, o_orderkey AS cell, cast(sum(l_quantity) AS double) AS v FROM lineitem JOIN orders ON
  l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3), m AS (SELECT cond, gene, avg(v) AS m FROM x GROUP BY 1, 2), k AS
  (SELECT cond FROM x GROUP BY 1 HAVING count(DISTINCT cell) >= 3) SELECT m.cond, m.gene, round(m.m - coalesce(c.m, 0.0), 6) AS delta FROM m JOIN k
  USING (cond) LEFT JOIN (SELECT gene, m FROM m WHERE cond = (SELECT min(cond) FROM m)) c ON c.gene = m.gene WHERE m.cond <> (SELECT min(cond) FROM m)""")
def a9_pseudo_bulk_delta(spark, d):
    lines = P.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("cond"))
    p = P.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene"))
    x = lines.join(o, "l_orderkey").join(p, "l_partkey").groupBy("cond", "gene", "l_orderkey").agg(F.sum("l_quantity").cast("double").alias("v"))
    first = o.agg(F.min("cond").alias("cond"))
    return rounded(T.pseudo_bulk(x.withColumnRenamed("l_orderkey", "cell"), first), "delta")

