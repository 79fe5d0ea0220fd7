"""A typed property graph over the star schema, and the same graph in SQL.

Nodes are parts (genes) and the attribute values they touch; edges are a
multigraph with one row for each (src, dst, edge_type).  Nothing here is
collected.  The edges of each type are made once for a set of input files and kept
as Parquet (``sources.graph_store``), so a query that needs one type reads only its
columns, and only the first one pays for the joins behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources.graph_store import dealt, kept

#: The types that neighbourhoods are asked for, and those that texts tell of too.
TYPES = ("PPI", "GO", "HPO", "TRRUST", "CellMarker", "Reactome")
ALL_TYPES = (*TYPES, "OMIM", "GTEx", "CORUM")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gene(key: str):
    return F.concat(F.lit("P"), F.col(key).cast("string"))


def ppi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one order interact.  An order has few lines, so its parts come
    together in one shuffle by order and its pairs are made where they lie.  Few
    pairs repeat, so they are counted behind their shuffle only."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    n = lines.count()  # of the files' footers
    own = dealt(lines, n, "l_orderkey").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts")).where(F.size("parts") > 1)
    each = own.select("parts", F.explode("parts").alias("a"))
    pairs = dealt(each.select("a", F.explode(F.filter("parts", lambda b: b > F.col("a"))).alias("b")), 2 * n, "a").groupBy("a", "b").agg(F.count("*").alias("n"))
    score = F.round(F.least(F.lit(1000.0), (F.col("n") * 100 + F.pmod(F.col("a") + F.col("b"), F.lit(900))).cast("double")) / 1000.0, 3)
    return placed(pairs.select("a", gene("a").alias("src"), gene("b").alias("dst"), F.lit("PPI").alias("edge_type"), score.alias("score"), F.lit("STRING").alias("evidence")), "a")


def placed(edges: DataFrame, key: str) -> DataFrame:
    """Edges that lie by their sources' ``key`` with their place among the source's,
    best first: who wants few of them need not sort them again."""
    w = Window.partitionBy(key).orderBy(F.coalesce("score", F.lit(0.0)).desc(), "dst")
    return edges.withColumn("place", F.row_number().over(w)).drop(key)


def go(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    terms = F.array(F.concat(F.lit("GO:T"), "p_type"), F.concat(F.lit("GO:B"), "p_brand"), F.concat(F.lit("GO:S"), F.col("p_size").cast("string")))
    code = F.when(F.col("p_partkey") % 3 == 0, "IEA").when(F.col("p_partkey") % 3 == 1, "IDA").otherwise("TAS")
    return part.select(gene("p_partkey").alias("src"), F.explode(terms).alias("dst"), F.lit("GO").alias("edge_type"), F.lit(None).cast("double").alias("score"), code.alias("evidence"))


def hpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    seen = lines.groupBy("l_partkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return seen.select(gene("l_partkey").alias("src"), F.concat(F.lit("HP:"), "o_orderpriority").alias("dst"), F.lit("HPO").alias("edge_type"), F.lit(None).cast("double").alias("score"), F.col("n").cast("string").alias("evidence"))


def trrust(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    # numbers in the order of the names: their least is found by hashing, that of texts by sorting
    kinds = ("Activation", "Repression", "Unknown")
    kind = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    n = own.count()
    own = dealt(own, n, "l_orderkey")
    lines = own.select("l_partkey", kind.alias("kind"), F.lead("l_partkey").over(w).alias("next")).where("next IS NOT NULL AND next <> l_partkey")
    seen = dealt(lines, n, "l_partkey").groupBy("l_partkey", "next").agg(F.min("kind").alias("k"))
    seen = seen.select("l_partkey", "next", F.element_at(F.array(*[F.lit(x) for x in kinds]), F.col("k") + 1).alias("kind"))
    return placed(seen.select("l_partkey", gene("l_partkey").alias("src"), gene("next").alias("dst"), F.lit("TRRUST").alias("edge_type"), F.lit(None).cast("double").alias("score"), F.col("kind").alias("evidence")), "l_partkey")


def cellmarker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names join behind the shuffle by part, which carries numbers alone."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "r_name")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    n = lines.count()
    own = lines.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").select("l_partkey", "s_nationkey")
    seen = dealt(own, n, "l_partkey").distinct().join(nation, "s_nationkey").select("l_partkey", "n_name", "r_name").distinct()
    return placed(seen.select("l_partkey", gene("l_partkey").alias("src"), F.concat(F.lit("CellMarker:"), F.replace("n_name", F.lit(" "), F.lit("_"))).alias("dst"), F.lit("CellMarker").alias("edge_type"), F.lit(None).cast("double").alias("score"), F.col("r_name").alias("evidence")), "l_partkey")


def reactome(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    home = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    seen = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(home, "l_orderkey").select("l_partkey", "c_mktsegment").distinct()
    return seen.select(gene("l_partkey").alias("src"), F.concat(F.lit("R-HSA-"), "c_mktsegment").alias("dst"), F.lit("Reactome").alias("edge_type"), F.lit(None).cast("double").alias("score"), F.lit("TAS").alias("evidence"))


def omim(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "Autosomal dominant").when(F.col("p_size") % 3 == 1, "Autosomal recessive")
    disease = F.concat(F.lit("OMIM:"), F.replace("p_type", F.lit(" "), F.lit("_")))
    return table(spark, sf_dir, "part").select(
        gene("p_partkey").alias("src"), disease.alias("dst"), F.lit("OMIM").alias("edge_type"),
        F.lit(None).cast("double").alias("score"), kind.alias("evidence"),
    )


def gtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity supplied from a nation as expression in a tissue; the evidence is
    its share of the gene's highest, in thousandths."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    home = table(spark, sf_dir, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    seen = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(home, "l_suppkey")
    total = seen.groupBy("l_partkey", "n_name").agg(F.sum("l_quantity").cast("double").alias("tpm"))
    share = F.floor(F.col("tpm") * 1000 / F.max("tpm").over(Window.partitionBy("l_partkey"))).cast("string")
    tissue = F.concat(F.lit("GTEx:"), F.replace("n_name", F.lit(" "), F.lit("_")))
    return total.select(gene("l_partkey").alias("src"), tissue.alias("dst"), F.lit("GTEx").alias("edge_type"), F.col("tpm").alias("score"), share.alias("evidence"))


def corum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of suppliers with one remainder form a complex; the evidence is its
    number of subunits."""
    member = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_suppkey") % 50).alias("c")).distinct()
    size = member.groupBy("c").agg(F.count("*").cast("string").alias("n"))
    return member.join(F.broadcast(size), "c").select(  # one row for each complex
        gene("l_partkey").alias("src"), F.concat(F.lit("CORUM:"), F.col("c").cast("string")).alias("dst"),
        F.lit("CORUM").alias("edge_type"), F.lit(None).cast("double").alias("score"), F.col("n").alias("evidence"),
    )


_MAKERS = {"PPI": ppi, "GO": go, "HPO": hpo, "TRRUST": trrust, "CellMarker": cellmarker, "Reactome": reactome, "OMIM": omim, "GTEx": gtex, "CORUM": corum}
_INPUTS = {
    "PPI": ("lineitem",), "GO": ("part",), "HPO": ("lineitem", "orders"), "TRRUST": ("lineitem",), "CellMarker": ("lineitem", "supplier", "nation", "region"),
    "Reactome": ("lineitem", "orders", "customer"), "OMIM": ("part",), "GTEx": ("lineitem", "supplier", "nation"), "CORUM": ("lineitem",),
}


def _files(sf_dir: str, names) -> list[str]:
    return [f"{sf_dir}/{n}.parquet" for n in sorted(set(names))]


def edges(spark: SparkSession, sf_dir: str, types: tuple[str, ...] = TYPES, places: bool = False) -> DataFrame:
    """src, dst, edge_type, score, evidence of the given types, and the place among
    the source's edges of a type where one was given (``placed``), if asked for."""
    out = None
    place = ["place"] if places else []
    for t in types:
        own = kept(spark, f"edges-{t}", _files(sf_dir, _INPUTS[t]), lambda t=t: _MAKERS[t](spark, sf_dir))
        own = own if "place" in own.columns else own.withColumn("place", F.lit(None).cast("int"))
        own = own.select("src", "dst", "edge_type", "score", "evidence", *place)
        out = own if out is None else out.unionByName(own)
    return out


#: Node labels by the type of the edges that lead to them.
LABELS = {"GO": "biological process", "HPO": "phenotypic feature", "CellMarker": "cell", "Reactome": "pathway", "OMIM": "disease", "GTEx": "tissue", "CORUM": "protein complex"}


def nodes(spark: SparkSession, sf_dir: str, types: tuple[str, ...] = TYPES) -> DataFrame:
    """node_id, node_label, name, definition of genes and of the targets of types."""
    named = [t for t in types if t in LABELS]
    return kept(spark, "nodes-" + "-".join(named), _files(sf_dir, ["part", *(n for t in named for n in _INPUTS[t])]), lambda: _nodes(spark, sf_dir, named))


def _nodes(spark: SparkSession, sf_dir: str, types: list[str]) -> DataFrame:
    text = F.concat_ws(" ", F.lit("A"), "p_type", F.lit("item of brand"), "p_brand", F.lit("and size"), F.col("p_size").cast("string"))
    part = table(spark, sf_dir, "part").select(gene("p_partkey").alias("node_id"), F.lit("gene").alias("node_label"), F.col("p_name").alias("name"), text.alias("definition"))
    t, tail = F.col("edge_type"), F.substring_index("dst", ":", -1)
    label = F.lit(None).cast("string")
    for k, v in LABELS.items():
        label = F.when(t == k, v).otherwise(label)
    spaced = F.replace(tail, F.lit("_"), F.lit(" "))
    name = (
        F.when(t.isin("CellMarker", "OMIM", "GTEx"), spaced).when(t == "Reactome", F.substring("dst", 7, 1000))
        .when(t == "CORUM", F.concat(F.lit("complex "), tail)).otherwise(tail)
    )
    rest = edges(spark, sf_dir, tuple(types)).select("dst", "edge_type").distinct()
    return part.unionByName(rest.select(F.col("dst").alias("node_id"), label.alias("node_label"), name.alias("name"), F.lit(None).cast("string").alias("definition")))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, emb (doubles), label: a vector for each gene that has one."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(gene("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("emb"), "label")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task, iteration, metric, edge_type, and strategy columns max_neighbors,
    max_hops, sampling, reward, by user of the event stream."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", F.row_number().over(w).cast("long").alias("iteration"), F.least(F.lit(1.0), F.col("value") / 100.0).alias("metric"), "event_type", "event_id")
    return e.select(
        F.col("user_id").alias("task"), "iteration", "metric", F.col("event_type").alias("edge_type"),
        (10 + F.col("event_id") % 191).alias("max_neighbors"), (1 + F.col("event_id") % 3).alias("max_hops"),
        F.element_at(F.array(F.lit("top_k"), F.lit("random"), F.lit("weighted")), (F.col("event_id") % 3 + 1).cast("int")).alias("sampling"),
    )


#: The same graph as DuckDB common table expressions.
SQL = {
    "ppi": """lp AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
ppi AS (SELECT 'P' || a.l_partkey AS src, 'P' || b.l_partkey AS dst, 'PPI' AS edge_type,
  round(least(1000.0::double, cast(count(*) * 100 + (a.l_partkey + b.l_partkey) % 900 AS double)) / 1000.0::double, 3) AS score, 'STRING' AS evidence
  FROM lp a JOIN lp b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY a.l_partkey, b.l_partkey)""",
    "go": """go AS (SELECT 'P' || p_partkey AS src, unnest(['GO:T' || p_type, 'GO:B' || p_brand, 'GO:S' || p_size]) AS dst, 'GO' AS edge_type, NULL::double AS score,
  CASE p_partkey % 3 WHEN 0 THEN 'IEA' WHEN 1 THEN 'IDA' ELSE 'TAS' END AS evidence FROM part)""",
    "hpo": """hpo AS (SELECT 'P' || l_partkey AS src, 'HP:' || o_orderpriority AS dst, 'HPO' AS edge_type, NULL::double AS score, cast(count(*) AS varchar) AS evidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey, o_orderpriority)""",
    "trrust": """trrust AS (SELECT 'P' || l_partkey AS src, 'P' || nxt AS dst, 'TRRUST' AS edge_type, NULL::double AS score, min(kind) AS evidence FROM (
  SELECT l_partkey, CASE l_returnflag WHEN 'A' THEN 'Activation' WHEN 'R' THEN 'Repression' ELSE 'Unknown' END AS kind,
  lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS nxt FROM lineitem) WHERE nxt <>
  l_partkey GROUP BY l_partkey, nxt)""",
    "cellmarker": """cellmarker AS (SELECT DISTINCT 'P' || l_partkey AS src, 'CellMarker:' || replace(n_name, ' ', '_') AS dst, 'CellMarker' AS edge_type, NULL::double AS
  score, r_name AS evidence
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "reactome": """reactome AS (SELECT DISTINCT 'P' || l_partkey AS src, 'R-HSA-' || c_mktsegment AS dst, 'Reactome' AS edge_type, NULL::double AS score, 'TAS' AS evidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)""",
}
SQL |= {
    "omim": """omim AS (SELECT 'P' || p_partkey AS src, 'OMIM:' || replace(p_type, ' ', '_') AS dst, 'OMIM' AS edge_type, NULL::double AS score,
  CASE p_size % 3 WHEN 0 THEN 'Autosomal dominant' WHEN 1 THEN 'Autosomal recessive' END AS evidence FROM part)""",
    "gtex": """tpm AS (SELECT l_partkey, n_name, cast(sum(l_quantity) AS double) AS tpm FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON
  s_nationkey = n_nationkey GROUP BY 1, 2),
gtex AS (SELECT 'P' || l_partkey AS src, 'GTEx:' || replace(n_name, ' ', '_') AS dst, 'GTEx' AS edge_type, tpm AS score,
  cast(cast(floor(tpm * 1000 / max(tpm) OVER (PARTITION BY l_partkey)) AS bigint) AS varchar) AS evidence FROM tpm)""",
    "corum": """member AS (SELECT DISTINCT l_partkey, l_suppkey % 50 AS c FROM lineitem), units AS (SELECT c, count(*) AS n FROM member GROUP BY 1),
corum AS (SELECT 'P' || l_partkey AS src, 'CORUM:' || c AS dst, 'CORUM' AS edge_type, NULL::double AS score, cast(n AS varchar) AS evidence FROM
  member JOIN units USING (c))""",
}


def _edges_sql(types: tuple[str, ...]) -> str:
    names = [t.lower() for t in types]
    return ",\n".join(SQL[k] for k in names) + ",\nedges AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM {k}" for k in names) + ")"


def _nodes_sql(types: tuple[str, ...]) -> str:
    labels = {t: LABELS[t] for t in types if t in LABELS}
    label = " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in labels.items())
    return f"""nodes AS MATERIALIZED (SELECT 'P' || p_partkey AS node_id, 'gene' AS node_label, p_name AS name,
  concat_ws(' ', 'A', p_type, 'item of brand', p_brand, 'and size', p_size) AS definition FROM part
  UNION ALL SELECT DISTINCT dst, CASE edge_type {label} END,
  CASE WHEN edge_type IN ('CellMarker', 'OMIM', 'GTEx') THEN replace(split_part(dst, ':', 2), '_', ' ') WHEN edge_type = 'Reactome' THEN substr(dst, 7)
    WHEN edge_type = 'CORUM' THEN 'complex ' || split_part(dst, ':', 2) ELSE split_part(dst, ':', 2) END, NULL
  FROM edges WHERE edge_type IN ({", ".join(f"'{t}'" for t in labels)}))"""


SQL["edges"], SQL["all_edges"] = _edges_sql(TYPES), _edges_sql(ALL_TYPES)
SQL["nodes"], SQL["all_nodes"] = _nodes_sql(TYPES), _nodes_sql(ALL_TYPES)
SQL["incident"] = """inc AS (SELECT src AS center, dst AS neighbor, edge_type, score, evidence, 'out' AS direction FROM edges
  UNION ALL SELECT dst, src, edge_type, score, evidence, 'in' FROM edges WHERE edge_type = 'PPI')"""
SQL["history"] = """hist AS (SELECT user_id AS task, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration, least(1.0::double, value /
  100.0::double) AS metric, event_type AS edge_type,
  10 + event_id % 191 AS max_neighbors, 1 + event_id % 3 AS max_hops, (['top_k', 'random', 'weighted'])[event_id % 3 + 1] AS sampling FROM events)"""
SQL["emb"] = "emb AS (SELECT 'P' || vec_id AS id, embedding::double[] AS emb, label FROM embeddings)"


def with_sql(*names: str) -> str:
    """A WITH clause of the named expressions."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"


def gene_of(key):
    """Like ``gene`` for a column."""
    return F.concat(F.lit("P"), key.cast("string"))
