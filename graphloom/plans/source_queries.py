"""Queries of the source readers over rows derived from the tables, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import identifiers as I
from graphloom.plans import projection as P
from graphloom.plans.queries import query
from graphloom.sources import biofiles as S


@query("""WITH l AS (SELECT 'e' || l_partkey AS protein1, 'e' || l_suppkey AS protein2, 600 + (l_orderkey * 7 + l_linenumber) % 400 AS s, l_orderkey * 100000000
  + l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS pos FROM lineitem),
a AS (SELECT 'e' || p_partkey AS ensp, upper(p_brand || p_size % 7) AS symbol FROM part), j AS (SELECT l.*, a.symbol AS s1, b.symbol AS s2 FROM l JOIN
  a ON a.ensp = protein1 JOIN a b ON b.ensp = protein2 WHERE s >= 700 AND a.symbol <> b.symbol)
SELECT s1 AS src, s2 AS dst, s / 1000.0::double AS score FROM (SELECT *, row_number() OVER (PARTITION BY least(s1, s2), greatest(s1, s2) ORDER BY pos)
  AS r FROM j) WHERE r = 1""")
def s5_string_edges(spark, d):
    li = P.table(spark, d, "lineitem")
    pos = F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    links = li.select(F.concat(F.lit("e"), F.col("l_partkey").cast("string")).alias("protein1"), F.concat(F.lit("e"), F.col("l_suppkey").cast("string")).alias("protein2"), (600 + (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 400).cast("string").alias("combined_score"), pos.alias("pos"))
    alias = P.table(spark, d, "part").select(F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("ensp"), F.concat("p_brand", (F.col("p_size") % 7).cast("string")).alias("alias"), F.lit("BioMart_HUGO").alias("source"), F.col("p_partkey").alias("pos"))
    return S.string_edges(links, alias)


@query("""SELECT upper(trim(p_brand)) AS src, upper(trim(p_type)) AS dst, k AS regulation_type, CASE k WHEN 'Activation' THEN 'positive' WHEN 'Repression' THEN
  'negative' ELSE 'unknown' END AS direction, cast(p_partkey AS varchar) AS pmid FROM (SELECT *, (['Activation', 'Repression', 'Unknown'])[p_size % 3
  + 1] AS k FROM part) WHERE p_partkey % 10 <> 0""")
def s6_regulations(spark, d):
    kind = F.element_at(F.array(F.lit("Activation"), F.lit("Repression"), F.lit("Unknown")), F.col("p_size") % 3 + 1)
    tf = F.when(F.col("p_partkey") % 10 != 0, F.col("p_brand"))
    rows = P.table(spark, d, "part").select(tf.alias("tf"), F.col("p_type").alias("target"), kind.alias("regulation_type"), F.col("p_partkey").cast("string").alias("pmid"))
    return S.trrust_edges(rows)


@query("""SELECT 'P' || l_partkey AS src, 'CellMarker:' || replace(n_name, ' ', '_') AS dst, tissue FROM (SELECT l_partkey, n_name, l_shipdate::date::varchar AS
  tissue, row_number() OVER (PARTITION BY l_partkey, n_name ORDER BY l_orderkey, l_linenumber, l_shipdate) AS r FROM lineitem JOIN supplier ON
  l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) WHERE r = 1""")
def s17_marker_edges(spark, d):
    home = P.table(spark, d, "supplier").join(P.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    rows = P.table(spark, d, "lineitem").join(home, "l_suppkey")
    rows = rows.select(F.lit("Human").alias("species"), P.gene("l_partkey").alias("symbol"), F.col("n_name").alias("cell_name"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("tissue"), F.struct("l_orderkey", "l_linenumber", "l_shipdate").alias("pos"))
    return S.cell_edges(rows, "Human")


REACT = """WITH p AS (SELECT 'R-HSA-' || o_custkey % 50 AS id, max(o_orderkey) AS k FROM orders WHERE o_custkey % 50 < 30 GROUP BY 1),
g AS (SELECT l_partkey AS e, 'R-HSA-' || l_orderkey % 40 AS pathway, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey
  AS pos, CASE WHEN l_linenumber % 4 = 0 THEN 'Mus musculus' ELSE 'Homo sapiens' END AS sp FROM lineitem), j AS (SELECT * FROM g JOIN part ON
  p_partkey = e WHERE sp = 'Homo sapiens') """


def _reactome(spark, d):
    o = P.table(spark, d, "orders").where(F.col("o_custkey") % 50 < 30)
    paths = o.select(F.concat(F.lit("R-HSA-"), (F.col("o_custkey") % 50).cast("string")).alias("id"), F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderkey").alias("pos"))
    li = P.table(spark, d, "lineitem")
    pos = F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    way = F.concat(F.lit("R-HSA-"), (F.col("l_orderkey") % 40).cast("string"))
    genes = li.select(F.col("l_partkey").cast("string").alias("entrez"), way.alias("pathway"), F.concat(F.lit("x"), way).alias("name"), F.when(F.col("l_linenumber") % 4 == 0, "Mus musculus").otherwise("Homo sapiens").alias("species"), F.lit("TAS").alias("evidence"), pos.alias("pos"))
    ids = P.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("entrez"), P.gene("p_partkey").alias("symbol"), F.col("p_partkey").alias("pos"))
    return S.reactome_edges(paths, genes, ids)


@query(REACT + "SELECT id, 'n' || k AS name FROM p UNION ALL SELECT DISTINCT pathway, 'x' || pathway FROM j WHERE pathway NOT IN (SELECT id FROM p)")
def s20_pathway_nodes(spark, d):
    return _reactome(spark, d)[0]


@query(REACT + "SELECT DISTINCT 'P' || e AS src, pathway AS dst FROM j")
def s20_pathway_edges(spark, d):
    return _reactome(spark, d)[1].select("src", "dst")


PHENO = """WITH d AS (SELECT p_partkey,
  (['{Foo syndrome (AD), ', '[Bar disease, ', '?Baz, AR, ', 'Qux, XLR, ', 'Plain '])[p_size % 5 + 1] || (100000 + p_partkey % 300) || CASE p_size % 5 WHEN 1 THEN ']' ELSE '' END AS phenotype, 'g' || p_partkey || ', g' || (p_partkey + 1) AS genes, cast(100000 + p_partkey % 300 AS varchar) AS mim FROM part),
c AS (SELECT *, CASE WHEN contains(phenotype, '(AD)') OR contains(phenotype, ', AD') THEN 'Autosomal dominant' WHEN contains(phenotype, '(AR)') OR contains(phenotype, ', AR') THEN 'Autosomal recessive' WHEN contains(phenotype, '(XL)') OR contains(phenotype, ', XL') THEN 'X-linked' END AS inheritance,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(phenotype), '^\\[', ''), '^\\{', ''), '^\\?', ''), '\\]$', ''), '\\}$', ''), ',\\s*\\d+\\s*$', '')) AS name FROM d),
e AS (SELECT upper(trim(unnest(string_split(genes, ',')))) AS src, 'OMIM:' || mim AS dst, name, inheritance, p_partkey AS pos FROM c)
SELECT src, dst, name, inheritance FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY pos) AS r FROM e) WHERE r = 1"""


@query(PHENO)
def s24_disease_edges(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("{Foo syndrome (AD), ", "[Bar disease, ", "?Baz, AR, ", "Qux, XLR, ", "Plain ")]), F.col("p_size") % 5 + 1)
    mim = (100000 + F.col("p_partkey") % 300).cast("string")
    text = F.concat(kind, mim, F.when(F.col("p_size") % 5 == 1, "]").otherwise(""))
    genes = F.concat(F.lit("g"), F.col("p_partkey").cast("string"), F.lit(", g"), (F.col("p_partkey") + 1).cast("string"))
    rows = P.table(spark, d, "part").select(text.alias("phenotype"), genes.alias("genes"), mim.alias("mim"), F.col("p_partkey").alias("pos"))
    return S.morbidmap_edges(rows)


@query("SELECT 'P' || p_partkey AS node_id, 'gene' AS node_label, p_name AS name, cast(p_partkey AS varchar) AS entrez_id FROM part WHERE p_size <> 7")
def s1_gene_nodes(spark, d):
    """Symbols padded and in small letters, ids that came as floats, some missing."""
    sym = F.when(F.col("p_size") != 7, F.concat(F.lit(" p"), F.col("p_partkey").cast("string"), F.lit(" ")))
    return S.hgnc_nodes(P.table(spark, d, "part").select(sym.alias("symbol"), F.col("p_name").alias("name"), F.concat(F.col("p_partkey").cast("string"), F.lit(".0")).alias("entrez_id")))


@query("""WITH t AS (SELECT upper(regexp_replace(split_part(text, ' ', 1), '[^A-Za-z]', '', 'g')) AS s, text, row_number() OVER (PARTITION BY
  upper(regexp_replace(split_part(text, ' ', 1), '[^A-Za-z]', '', 'g')) ORDER BY doc_id DESC) AS r FROM documents WHERE text IS NOT NULL) SELECT
  upper(p_brand) AS symbol, md5(coalesce((SELECT min(text) FROM t WHERE r = 1 AND s = upper(p_brand)), 'none')) AS summary FROM (SELECT DISTINCT
  p_brand FROM part) UNION ALL SELECT s, md5(text) FROM t WHERE r = 1""")
def s55_summaries(spark, d):
    """The last summary of each symbol, joined to nodes that may have none."""
    docs = P.table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.upper(F.regexp_replace(F.substring_index("text", " ", 1), "[^A-Za-z]", "")).alias("s"), "text", "doc_id")
    last = I.last_of(docs, ["s"], ["doc_id"]).select("s", "text")
    nodes = P.table(spark, d, "part").select(F.upper("p_brand").alias("s")).distinct()
    joined = nodes.join(last, "s", "left").select(F.col("s").alias("symbol"), F.md5(F.coalesce("text", F.lit("none")).cast("binary")).alias("summary"))
    return joined.unionByName(last.select(F.col("s").alias("symbol"), F.md5(F.col("text").cast("binary")).alias("summary")))


MAPS = """WITH m AS (SELECT 'symbol' AS kind, 'P' || p_partkey AS key, 'P' || p_partkey AS symbol, p_partkey AS pos FROM part UNION ALL SELECT 'alias',
  upper(p_brand || '-' || p_size), 'P' || p_partkey, p_partkey FROM part), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, key
  ORDER BY pos DESC) AS r FROM m) WHERE r = 1), s AS (SELECT DISTINCT 'p' || l_suppkey AS raw FROM lineitem UNION SELECT DISTINCT lower(p_brand) ||
  '-' || p_size % 60 FROM part UNION SELECT 'nobody') """


def _maps(spark, d):
    part = P.table(spark, d, "part")
    rows = part.select(F.lit("symbol").alias("kind"), P.gene("p_partkey").alias("key"), P.gene("p_partkey").alias("symbol"), F.col("p_partkey").alias("pos"))
    rows = rows.unionByName(part.select(F.lit("alias").alias("kind"), F.upper(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"))).alias("key"), P.gene("p_partkey").alias("symbol"), F.col("p_partkey").alias("pos")))
    names = P.table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("raw"))
    names = names.union(part.select(F.concat(F.lower("p_brand"), F.lit("-"), (F.col("p_size") % 60).cast("string")))).union(spark.createDataFrame([("nobody",)], "raw string")).distinct()
    return I.last_of(rows, ["kind", "key"], ["pos"]), names


@query(MAPS + """SELECT raw, coalesce(a.symbol, b.symbol) AS symbol FROM s LEFT JOIN k a ON a.kind = 'symbol' AND a.key = upper(raw) LEFT JOIN k b ON b.kind = 'alias'
  AND b.key = upper(raw)""")
def p8_normalised_symbols(spark, d):
    maps, names = _maps(spark, d)
    return I.normalised(names, maps)


@query(MAPS + "SELECT upper(raw) AS raw, a.symbol AS converted FROM s LEFT JOIN k a ON a.kind = 'alias' AND a.key = upper(raw)")
def p9_batch_convert(spark, d):
    maps, names = _maps(spark, d)
    return I.batch_convert(names.select(F.upper("raw").alias("raw")), maps, "alias")


@query("""SELECT p_type AS cell, max(o) AS organ, count(*) AS n FROM (SELECT p_type, first_value(p_brand) OVER (PARTITION BY p_type ORDER BY p_partkey) AS o
  FROM part) GROUP BY 1""")
def s43_first_organ(spark, d):
    part = P.table(spark, d, "part")
    return part.groupBy(F.col("p_type").alias("cell")).agg(F.min_by("p_brand", "p_partkey").alias("organ"), F.count("*").alias("n"))


@query("SELECT p_brand AS organ, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def s45_top_organs(spark, d):
    return P.table(spark, d, "part").groupBy(F.col("p_brand").alias("organ")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "organ").limit(20)


@query("""WITH l AS (SELECT p_type AS t, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 100) SELECT 'P' || p_partkey AS gene, p_type AS gene_type FROM
  part JOIN l ON t = p_type""")
def s60_frequent_types(spark, d):
    part = P.table(spark, d, "part").select(P.gene("p_partkey").alias("gene"), F.col("p_type").alias("gene_type"))
    often = part.groupBy("gene_type").agg(F.count("*").alias("n")).where("n >= 100").select("gene_type")
    return part.join(often, "gene_type", "left_semi")


@query("""WITH e AS (SELECT task, best, iteration FROM (SELECT user_id AS task, max(least(1.0::double, value / 100.0::double)) OVER (PARTITION BY user_id) AS
  best, event_id AS iteration, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1) SELECT task, iteration,
  round(best, 9) AS best FROM e""")
def k6_latest_checkpoints(spark, d):
    from graphloom.sources.stores import latest

    e = P.table(spark, d, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("iteration"), F.least(F.lit(1.0), F.col("value") / 100.0).alias("m"))
    best = F.max("m").over(Window.partitionBy("task"))
    return latest(e.withColumn("best", F.round(best, 9)), ["task"], ["iteration"]).select("task", "iteration", "best")
