"""Queries of source adapters and look-ups, with their SQL.

Rows of the source files are derived from the tables; ``pos`` is a place in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import identifiers as I
from graphloom.plans import projection as P
from graphloom.plans.projection import with_sql
from graphloom.plans.queries import query
from graphloom.plans.source_queries import MAPS, _maps
from graphloom.sources import adapters as A
from graphloom.sources import biofiles as B

#: A place for each line of an order.
POS = "l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey"


def _pos():
    return F.expr(POS)


# ---- regulation, ontology, phenotypes


@query("SELECT DISTINCT upper(trim(p_brand)) AS tf FROM part WHERE p_partkey % 10 <> 0")
def s8_tf_set(spark, d):
    part = P.table(spark, d, "part")
    return A.tf_set(part.select(F.when(F.col("p_partkey") % 10 != 0, F.concat(F.lit(" "), F.lower("p_brand"))).alias("tf")))


@query(P.with_sql("all_edges").rstrip() + " SELECT source, fetched, CASE WHEN t.edge_type IS NOT NULL THEN coalesce(n, 0) END AS edges FROM (VALUES " + ", ".join(f"('{s}', '{f}')" for s, f in A.CATALOGUE) + ") c(source, fetched) LEFT JOIN (VALUES " + ", ".join(f"('{s}', '{t}')" for s, t in A.BRINGS.items()) + ") t(source, edge_type) USING (source) LEFT JOIN (SELECT edge_type, count(*) AS n FROM edges GROUP BY 1) e ON e.edge_type = t.edge_type")
def s56_catalogue(spark, d):
    return A.checked(spark, P.edges(spark, d, P.ALL_TYPES))


@query("""WITH a AS (SELECT 'GO:' || p_type AS dst, (['P', 'F', 'C', 'X'])[p_size % 4 + 1] AS aspect, p_partkey AS pos FROM part),
f AS (SELECT dst, aspect FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY pos) AS r FROM a) WHERE r = 1),
o AS (SELECT DISTINCT 'GO:' || p_type AS id, lower(p_type) AS name, 'about ' || p_type AS definition FROM part WHERE p_type LIKE '%A%')
SELECT dst AS node_id, CASE aspect WHEN 'F' THEN 'molecular function' WHEN 'C' THEN 'cellular component' ELSE 'biological process' END AS node_label,
  coalesce(name, dst) AS name, definition FROM f LEFT JOIN o ON id = dst""")
def s11_go_nodes(spark, d):
    part = P.table(spark, d, "part")
    term = F.concat(F.lit("GO:"), "p_type")
    aspect = F.element_at(F.array(*[F.lit(x) for x in "PFCX"]), F.col("p_size") % 4 + 1)
    known = part.where(F.contains("p_type", F.lit("A"))).select(term.alias("id"), F.lower("p_type").alias("name"), F.concat(F.lit("about "), "p_type").alias("definition")).distinct()
    return A.go_nodes(part.select(term.alias("dst"), aspect.alias("aspect"), F.col("p_partkey").alias("pos")), known)


HPO = f"""WITH h AS (SELECT CASE WHEN l_linenumber = 7 THEN ' ' ELSE ' p' || l_partkey || ' ' END AS gene, CASE WHEN l_linenumber = 6 THEN 'x' ELSE 'HP:' ||
  l_suppkey % 40 END AS hpo_id,
  'name ' || l_orderkey AS hpo_name, l_shipdate::date::varchar AS frequency, {POS} AS pos FROM lineitem), v AS (SELECT * FROM h WHERE trim(gene) <> ''
  AND starts_with(hpo_id, 'HP:')) """


def _hpo(spark, d):
    line = F.col("l_linenumber")
    gene = F.when(line == 7, F.lit(" ")).otherwise(F.concat(F.lit(" p"), F.col("l_partkey").cast("string"), F.lit(" ")))
    term = F.when(line == 6, "x").otherwise(F.concat(F.lit("HP:"), (F.col("l_suppkey") % 40).cast("string")))
    rows = P.table(spark, d, "lineitem").select(
        F.lit("9606").alias("NCBI gene"), gene.alias("Gene-Symbol"), term.alias("HPO Term ID"), F.concat(F.lit("name "), F.col("l_orderkey").cast("string")).alias("HPO term name"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("Frequency"), _pos().alias("pos"),
    )
    return A.hpo_rows(rows.drop("NCBI gene"))


@query(HPO + """SELECT hpo_id AS node_id, 'phenotypic feature' AS node_label, hpo_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY hpo_id ORDER BY pos) AS
  r FROM v) WHERE r = 1""")
def s14_phenotype_nodes(spark, d):
    return A.hpo_nodes(_hpo(spark, d))


@query(HPO + "SELECT upper(trim(gene)) AS src, hpo_id AS dst, frequency FROM (SELECT *, row_number() OVER (PARTITION BY gene, hpo_id ORDER BY pos) AS r FROM v) WHERE r = 1")
def s15_phenotype_edges(spark, d):
    return A.hpo_edges(_hpo(spark, d))


@query("""WITH c AS (SELECT n_name AS cell, CASE WHEN l_linenumber % 2 = 0 THEN 'Normal' ELSE 'Cancer' END AS kind, l_shipdate::date::varchar AS tissue,
  l_orderkey AS a, l_linenumber AS b, l_shipdate AS c
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT 'CellMarker:' || replace(cell, ' ', '_') AS node_id, 'cell' AS node_label, cell AS name, tissue FROM (SELECT *, row_number() OVER (PARTITION BY
  cell ORDER BY a, b, c) AS r FROM c WHERE kind = 'Normal') WHERE r = 1""")
def s16_cell_nodes(spark, d):
    home = P.table(spark, d, "supplier").join(P.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    kind = F.when(F.col("l_linenumber") % 2 == 0, "Normal").otherwise("Cancer")
    rows = P.table(spark, d, "lineitem").join(home, "l_suppkey").select(
        F.lit("Human").alias("species"), F.col("n_name").alias("cell_name"), kind.alias("cancer_type"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("tissue"), F.struct("l_orderkey", "l_linenumber", "l_shipdate").alias("pos"),
    )
    return A.cell_nodes(rows, "Human", "Normal")


@query("SELECT 'R-HSA-' || o_custkey AS src, 'R-HSA-' || o_orderkey AS dst FROM orders WHERE o_custkey % 3 <> 0 AND o_orderkey % 5 <> 0")
def s21_pathway_hierarchy(spark, d):
    end = lambda c, n: F.concat(F.when(F.col(c) % n == 0, "R-MMU-").otherwise("R-HSA-"), F.col(c).cast("string"))
    return A.hierarchy(P.table(spark, d, "orders").select(end("o_custkey", 3).alias("parent"), end("o_orderkey", 5).alias("child")))


# ---- diseases

GENEMAP = """WITH g AS (SELECT 'p' || p_partkey || ', p' || (p_partkey + 1) AS genes, 'Foo ' || p_size || ', ' || (100000 + p_partkey % 500) || ' (3); Bar ' ||
  p_size || '; {Baz}, (AR), ' || (200000 + p_size) AS phenotypes, p_partkey AS pos FROM part),
e AS (SELECT genes, trim(unnest(string_split(phenotypes, ';'))) AS phenotype, pos FROM g),
m AS (SELECT *, coalesce(nullif(list_filter(list_transform(string_split(phenotype, ','), lambda x: regexp_extract(x,
  '^\\s*(\\d{6})(?:\\s*\\(\\d\\))?\\s*$', 1)), lambda x: x <> '')[-1], ''), 'H' || substr(md5(phenotype), 1, 8)) AS mim FROM e) """


def _genemap(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    genes = F.concat(F.lit("p"), k.cast("string"), F.lit(", p"), (k + 1).cast("string"))
    text = F.concat(F.lit("Foo "), size, F.lit(", "), (100000 + k % 500).cast("string"), F.lit(" (3); Bar "), size, F.lit("; {Baz}, (AR), "), (200000 + F.col("p_size")).cast("string"))
    return A.genemap_rows(P.table(spark, d, "part").select(genes.alias("genes"), text.alias("phenotypes"), k.alias("pos")))


@query(GENEMAP + "SELECT phenotype, genes, mim FROM m")
def s25_genemap_rows(spark, d):
    return _genemap(spark, d).drop("pos")


@query(GENEMAP + """, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mim ORDER BY pos) AS r FROM m) WHERE r = 1)
SELECT 'OMIM:' || mim AS node_id, 'disease' AS node_label, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(phenotype),
  '^\\{', ''), '\\]$', ''), '\\}$', ''), ',\\s*\\d+\\s*$', '')) AS name,
  CASE WHEN contains(phenotype, '(AR)') THEN 'Autosomal recessive' END AS inheritance FROM f""")
def s28_disease_nodes(spark, d):
    return A.disease_nodes(_genemap(spark, d))


@query("SELECT 'Foo ' || p_type AS phenotype, 'g' || p_partkey AS genes, cast(100000 + p_partkey % 300 AS varchar) AS mim FROM part")
def s26_generic_diseases(spark, d):
    part = P.table(spark, d, "part")
    mim = (100000 + F.col("p_partkey") % 300).cast("string")
    rows = part.select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("Gene Symbol"), mim.alias("MIM Number"), F.concat(F.lit("Foo "), "p_type").alias("Disease"), F.col("p_partkey").alias("pos"))
    return A.generic_disease_rows(rows).drop("pos")


@query("""SELECT p_partkey AS k, (['/x/MorbidMap', 'genemap2.', '/morbidmap/'])[p_partkey % 3 + 1] || lower(replace(p_brand, '#', '')) || CASE WHEN p_size % 2 = 0 THEN '.txt' ELSE
  '.csv/' END AS omim_file, (['morbidmap', 'genemap', 'generic'])[p_partkey % 3 + 1] AS kind FROM part""")
def s23_disease_layouts(spark, d):
    head = F.element_at(F.array(F.lit("/x/MorbidMap"), F.lit("genemap2."), F.lit("/morbidmap/")), (F.col("p_partkey") % 3 + 1).cast("int"))
    file = F.concat(head, F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.when(F.col("p_size") % 2 == 0, ".txt").otherwise(".csv/"))
    return P.table(spark, d, "part").select(F.col("p_partkey").alias("k"), file.alias("omim_file"), A.omim_kind_of(file).alias("kind"))


# ---- complexes, cells, chromatin

_members = "WITH m AS (SELECT DISTINCT 'CORUM:' || l_suppkey % 50 AS dst, 'P' || l_partkey AS src FROM lineitem) "


@query(_members + "SELECT dst, array_to_string(list_sort(list(src)), ',') AS genes FROM m GROUP BY 1")
def s40_genes_of_complexes(spark, d):
    return A.genes_of_complexes(P.edges(spark, d, ("CORUM",))).withColumn("genes", F.array_join("genes", ","))


@query(_members + "SELECT src, array_to_string(list_sort(list(dst)), ',') AS complexes FROM m GROUP BY 1")
def s41_complexes_of_genes(spark, d):
    return A.complexes_of_genes(P.edges(spark, d, ("CORUM",))).withColumn("complexes", F.array_join("complexes", ","))


@query("""SELECT 'CORUM:' || s_suppkey % 60 AS node_id, 'protein complex' AS node_label, s_name AS name, 'a;b' || s_suppkey || ';c;d;e' AS go_ids
FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey % 60 ORDER BY s_suppkey) AS r FROM supplier WHERE s_suppkey % 4 <> 0) WHERE r = 1""")
def s38_complex_nodes(spark, d):
    k = F.col("s_suppkey")
    go = F.concat(F.lit("a; b"), k.cast("string"), F.lit(";c ;;d;e;f;g"))
    organism = F.when(k % 4 == 0, "Mouse").otherwise("Human (all)")
    rows = P.table(spark, d, "supplier").select((k % 60).cast("string").alias("complex_id"), F.col("s_name").alias("complex_name"), go.alias("go_ids"), organism.alias("organism"), k.alias("pos"))
    return A.complex_nodes(rows)


PANGLAO = f"""WITH p AS (SELECT upper('p' || l_partkey) AS src, 'PanglaoDB:' || replace(n_name, ' ', '_') AS dst, n_name AS cell, cast(l_quantity AS double) / 100
  AS sensitivity, cast(l_linenumber AS double) / 10 AS specificity, {POS} AS pos
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_linenumber % 3 <> 0) """


def _panglao(spark, d):
    home = P.table(spark, d, "supplier").join(P.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    species = F.when(F.col("l_linenumber") % 3 == 0, "Mm").otherwise("Mm Hs")
    rows = P.table(spark, d, "lineitem").join(home, "l_suppkey").select(
        species.alias("Species"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("Official Gene Symbol"), F.col("n_name").alias("Cell Type"), F.lit("x").alias("organ"),
        (F.col("l_quantity").cast("double") / 100).alias("Sensitivity_Human"), (F.col("l_linenumber").cast("double") / 10).alias("specificity_human"), _pos().alias("pos"),
    )
    return A.panglao_rows(rows)


@query(PANGLAO + "SELECT src, dst, sensitivity, specificity FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY pos) AS r FROM p) WHERE r = 1")
def s44_cell_type_edges(spark, d):
    return A.panglao_edges(_panglao(spark, d))


@query(PANGLAO + "SELECT cell AS cell_type, count(*) AS n, min(src) AS first, max(src) AS last FROM (SELECT DISTINCT cell, src FROM p) GROUP BY 1")
def s46_markers_of_cells(spark, d):
    m = A.markers_of(_panglao(spark, d))
    return m.select("cell_type", F.size("markers").cast("long").alias("n"), F.element_at("markers", 1).alias("first"), F.element_at("markers", -1).alias("last"))


@query(PANGLAO + "SELECT upper(cell) AS cell_type, count(*) AS n FROM p GROUP BY 1")
def s42_cell_type_rows(spark, d):
    return _panglao(spark, d).groupBy(F.upper("cell_type").alias("cell_type")).agg(F.count("*").alias("n"))


#: Of the genes by order status and flag: active and silent marks, and none.
CHROM = """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'A'), r AS (SELECT DISTINCT l_partkey AS k FROM
  lineitem WHERE l_linenumber = 2 AND l_returnflag = 'R'),
b AS (SELECT p_partkey AS k FROM part WHERE p_size % 2 = 0), st AS (SELECT coalesce(a.k, r.k) AS k, CASE WHEN a.k IS NOT NULL AND r.k IS NOT NULL THEN
  'bivalent' WHEN a.k IS NOT NULL THEN 'lys4_only' ELSE 'lys27_only' END AS state FROM a FULL JOIN r ON a.k = r.k),
an AS (SELECT coalesce(st.k, b.k) AS k, coalesce(state, 'no_methylation') AS state FROM st FULL JOIN b ON st.k = b.k) """


def _chromatin(spark, d):
    lines = P.table(spark, d, "lineitem")
    own = lambda n, f: lines.where((F.col("l_linenumber") == n) & (F.col("l_returnflag") == f)).select(P.gene("l_partkey").alias("gene")).distinct()
    bare = P.table(spark, d, "part").where("p_size % 2 = 0").select(P.gene("p_partkey").alias("gene"))
    return B.chromatin_states(own(1, "A"), own(2, "R")), bare


@query(CHROM + "SELECT 'P' || k AS gene, state FROM an")
def s50_chromatin_annotations(spark, d):
    return A.chromatin_annotations(*_chromatin(spark, d))


@query(CHROM + "SELECT 'P' || p_partkey AS gene, coalesce(state, 'unknown') AS state FROM part LEFT JOIN st ON k = p_partkey")
def s49_state_of_genes(spark, d):
    states, _ = _chromatin(spark, d)
    return P.table(spark, d, "part").select(P.gene("p_partkey").alias("gene")).join(states, "gene", "left").select("gene", F.coalesce("state", F.lit("unknown")).alias("state"))


@query(CHROM + "SELECT 'P' || k AS gene FROM st WHERE state = 'bivalent'")
def s51_bivalent_genes(spark, d):
    return _chromatin(spark, d)[0].where("state = 'bivalent'").select("gene")


@query(CHROM + "SELECT 'P' || k AS gene FROM st WHERE state <> 'lys27_only' UNION SELECT 'P' || k FROM b")
def s52_annotated_genes(spark, d):
    return A.annotated_genes(*_chromatin(spark, d))


@query(CHROM + "SELECT state, count(*) AS n FROM an GROUP BY 1")
def s53_chromatin_counts(spark, d):
    return A.chromatin_counts(*_chromatin(spark, d))


@query(CHROM + "SELECT 'P' || k AS gene, max(y)::int AS label FROM (SELECT k, 1 AS y FROM st WHERE state = 'bivalent' UNION ALL SELECT k, 0 FROM b) GROUP BY 1")
def s54_task_labels(spark, d):
    states, bare = _chromatin(spark, d)
    return A.labelled(states.where("state = 'bivalent'"), bare)


@query("""SELECT DISTINCT upper(trim(n)) AS gene, y AS label FROM (SELECT p_brand AS n, 1 AS y FROM part UNION ALL SELECT p_type, 0 FROM part WHERE p_size <> 3)
  WHERE trim(n) <> ''""")
def s61_two_column_sets(spark, d):
    rows = P.table(spark, d, "part").select(F.concat(F.lit(" "), F.lower("p_brand")).alias("yes"), F.when(F.col("p_size") != 3, F.col("p_type")).otherwise(" ").alias("no"))
    return A.two_column_sets(rows, "yes", "no")


@query("SELECT DISTINCT upper(trim(p_brand)) AS gene FROM part WHERE p_size <> 5")
def s62_positive_list(spark, d):
    text = P.table(spark, d, "part").select(F.when(F.col("p_size") == 5, F.concat(F.lit("# "), "p_brand")).otherwise(F.concat(F.lower("p_brand"), F.lit("  "))).alias("value"))
    return B.gene_list(text)


@query("SELECT doc_id, lang AS cell_type FROM documents WHERE lang IS NOT NULL AND lang <> 'en'")
def s58_known_cells(spark, d):
    cells = P.table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", "Unknown").otherwise(F.col("lang")).alias("cell_type"))
    return A.known_cells(cells)


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def a7_cell_type_distribution(spark, d):
    return A.class_counts(P.table(spark, d, "documents"), "source")


@query("WITH l AS (SELECT p_partkey AS k, p_size % 4 AS r FROM part) SELECT 'P' || k AS gene, CASE r WHEN 0 THEN 1 ELSE 0 END AS label FROM l WHERE r IN (0, 1)")
def s63_disjoint_lists(spark, d):
    """Two lists that overlap: genes of both are in neither."""
    own = lambda *r: P.table(spark, d, "part").where((F.col("p_size") % 4).isin(*r)).select(P.gene("p_partkey").alias("gene"))
    return B.without_overlap(own(0, 2), own(1, 2))


# ---- identifiers


@query("SELECT upper('P' || p_partkey) AS symbol, 'P' || p_partkey AS node_id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'ENSG' || p_partkey END AS ensembl FROM part")
def p4_id_cache(spark, d):
    return A.id_cache(_gene_nodes(spark, d))


def _gene_nodes(spark, d):
    part = P.table(spark, d, "part")
    ensembl = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("ENSG"), F.col("p_partkey").cast("string")))
    return part.select(P.gene("p_partkey").alias("node_id"), F.lit("gene").alias("node_label"), ensembl.alias("ensembl"))


@query("""WITH e AS (SELECT 'P' || vec_id AS id FROM embeddings), q AS (SELECT p_partkey AS k, p_size % 3 = 0 AS lost, CASE WHEN p_partkey % 7 = 0 THEN 'P' ||
  p_partkey || '.2' WHEN p_partkey % 7 = 1 THEN 'P' || p_partkey ELSE 'ENSG' || p_partkey || '.1' END AS ensembl FROM part)
SELECT ensembl, CASE WHEN k % 7 > 1 AND lost THEN NULL ELSE id END AS key FROM q LEFT JOIN e ON id = 'P' || k""")
def p6_ensembl_keys(spark, d):
    """Identifiers as they are, with a version, and by the cache's symbol."""
    k = F.col("p_partkey")
    name = F.when(k % 7 == 0, F.concat(P.gene("p_partkey"), F.lit(".2"))).when(k % 7 == 1, P.gene("p_partkey")).otherwise(F.concat(F.lit("ENSG"), k.cast("string"), F.lit(".1")))
    rows = P.table(spark, d, "part").select(name.alias("ensembl"))
    return A.ensembl_keys(rows, P.embeddings(spark, d).select("id"), A.id_cache(_gene_nodes(spark, d)))


@query("""WITH e AS (SELECT 'P' || vec_id AS id FROM embeddings) SELECT s.symbol, coalesce(e.id, c.id, l.id) AS key FROM (
  SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'P' || p_partkey WHEN 1 THEN 'sym' || p_partkey ELSE 'p' || p_partkey END AS symbol FROM part) s
LEFT JOIN e ON e.id = s.symbol LEFT JOIN e c ON s.k % 3 = 1 AND c.id = 'P' || s.k LEFT JOIN e l ON s.k % 3 = 2 AND l.id = 'P' || s.k""")
def p5_keys_by_every_branch(spark, d):
    """A third of the symbols exact, a third in the cache, a third in small letters."""
    k = F.col("p_partkey")
    part = P.table(spark, d, "part")
    name = F.when(k % 3 == 0, P.gene("p_partkey")).when(k % 3 == 1, F.concat(F.lit("sym"), k.cast("string"))).otherwise(F.concat(F.lit("p"), k.cast("string")))
    cache = part.where(k % 3 == 1).select(name.alias("symbol"), P.gene("p_partkey").alias("ensembl"))
    return I.embedding_keys(part.select(name.alias("symbol")), P.embeddings(spark, d).select("id"), cache)


#: A table of genes with every kind of identifier, lists among them.
GENES = """WITH m AS (SELECT 'P' || p_partkey AS symbol, 'E' || p_partkey AS ensembl, cast(p_partkey AS varchar) AS entrez, 'U' || p_partkey || '|' || 'V' ||
  p_partkey % 90 AS uniprot, 'A' || p_partkey % 80 || '|' || p_brand AS alias, p_partkey AS pos FROM part),
l AS (SELECT 'symbol' AS kind, symbol AS key, symbol, pos FROM m UNION ALL SELECT 'ensembl', ensembl, symbol, pos FROM m UNION ALL SELECT 'entrez',
  entrez, symbol, pos FROM m
  UNION ALL SELECT 'uniprot', unnest(string_split(uniprot, '|')), symbol, pos FROM m UNION ALL SELECT 'alias', unnest(string_split(alias, '|')),
  symbol, pos FROM m),
k AS (SELECT kind, key, symbol FROM (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY pos DESC, symbol DESC) AS r FROM l) WHERE r = 1) """


def _mapper(spark, d):
    k = F.col("p_partkey").cast("string")
    rows = P.table(spark, d, "part").select(
        P.gene("p_partkey").alias("symbol"), F.concat(F.lit("E"), k).alias("ensembl"), k.alias("entrez"), F.concat(F.lit("U"), k, F.lit("|V"), (F.col("p_partkey") % 90).cast("string")).alias("uniprot"),
        F.lit("").alias("prev"), F.concat(F.lit("A"), (F.col("p_partkey") % 80).cast("string"), F.lit("|"), "p_brand").alias("alias"), F.col("p_partkey").alias("pos"),
    )
    return I.mapper(rows)


@query(GENES + "SELECT kind, key, symbol FROM k")
def p7_mapper_of_all_kinds(spark, d):
    return _mapper(spark, d)


def _convert(spark, d, kind):
    maps = _mapper(spark, d)
    asked = maps.select(F.col("key").alias("raw")).union(spark.createDataFrame([("nobody",)], "raw string")).distinct()
    return I.batch_convert(asked, maps, kind)


def _convert_sql(kind: str) -> str:
    return GENES + f", q AS (SELECT DISTINCT key AS raw FROM k UNION SELECT 'nobody') SELECT raw, symbol AS converted FROM q LEFT JOIN k ON kind = '{kind}' AND key = raw"


@query(_convert_sql("ensembl"))
def p9_from_ensembl(spark, d):
    return _convert(spark, d, "ensembl")


@query(_convert_sql("entrez"))
def p9_from_entrez(spark, d):
    return _convert(spark, d, "entrez")


@query(_convert_sql("uniprot"))
def p9_from_uniprot(spark, d):
    return _convert(spark, d, "uniprot")


def _inverse_sql(kind: str) -> str:
    return GENES + f"SELECT symbol, min(key) AS key FROM k WHERE kind = '{kind}' GROUP BY 1"


@query(_inverse_sql("ensembl"))
def p15_symbol_to_ensembl(spark, d):
    return A.inverse_map(_mapper(spark, d), "ensembl")


@query(_inverse_sql("entrez"))
def p15_symbol_to_entrez(spark, d):
    return A.inverse_map(_mapper(spark, d), "entrez")


@query(_inverse_sql("uniprot"))
def p15_symbol_to_uniprot(spark, d):
    return A.inverse_map(_mapper(spark, d), "uniprot")


@query(GENES + "SELECT key AS symbol, pos % 3 = 0 AS even FROM (SELECT k.key, m.pos FROM k JOIN m ON m.symbol = k.symbol WHERE kind = 'symbol')")
def p10_gene_rows(spark, d):
    """What the mapper knows of each symbol: its first row."""
    part = P.table(spark, d, "part").select(P.gene("p_partkey").alias("symbol"), F.col("p_partkey").alias("pos"))
    twice = part.unionByName(part.withColumn("pos", F.col("pos") + 10**9))
    return A.first_row(twice, "symbol", ["pos"]).select("symbol", (F.col("pos") % 3 == 0).alias("even"))


@query(MAPS + "SELECT DISTINCT symbol FROM k")
def p11_all_symbols(spark, d):
    return _maps(spark, d)[0].select("symbol").distinct()


@query(with_sql("ppi") + "SELECT dst, count(*) AS n FROM (SELECT src AS s, dst FROM ppi) GROUP BY 1")
def k1_degree_table(spark, d):
    """Statistics that are kept beside a graph: in-degrees of its interactions."""
    return A.class_counts(P.edges(spark, d, ("PPI",)), "dst")


# ---- parsers by themselves


@query("""SELECT 'GO:' || p_partkey AS id, p_name AS name, 'x_' || p_size AS namespace, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'about ' || p_type END AS definition, p_size % 5 = 0 AS obsolete
FROM part WHERE p_size % 3 <> 0""")
def s9_obo_terms(spark, d):
    """Stanzas as text, of which a third are of another kind."""
    size = F.col("p_size")
    text = F.concat(
        F.when(size % 3 == 0, "[Typedef]").otherwise("[Term]"), F.lit("\nid: GO:"), F.col("p_partkey").cast("string"), F.lit("\nname: "), "p_name", F.lit("\nnamespace: x_"), size.cast("string"),
        F.when(size % 4 == 0, "").otherwise(F.concat(F.lit('\ndef: "about '), "p_type", F.lit('" [a:b]'))), F.when(size % 5 == 0, "\nis_obsolete: true").otherwise(""),
    )
    return B.obo_terms(P.table(spark, d, "part").select(text.alias("value")))


@query(f"""WITH g AS (SELECT upper('p' || l_partkey) AS src, 'GO:' || l_suppkey % 30 AS dst, l_returnflag AS evidence, CASE WHEN l_linenumber % 2 = 0 THEN 'F' ELSE 'P' END AS aspect, {POS} AS pos FROM lineitem WHERE l_linenumber <> 5)
SELECT src, dst, evidence, aspect FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY pos) AS r FROM g WHERE aspect = 'P') WHERE r = 1""")
def s10_annotation_lines(spark, d):
    """Lines of fifteen fields; comments and shorter lines are left out."""
    line = F.col("l_linenumber")
    fields = F.concat_ws(
        "\t", F.lit("db"), F.lit("id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.lit(""), F.concat(F.lit("GO:"), (F.col("l_suppkey") % 30).cast("string")), F.lit("ref"), F.col("l_returnflag"),
        F.lit(""), F.when(line % 2 == 0, "F").otherwise("P"), *[F.lit("x")] * 6,
    )
    short = F.when(line == 5, F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("!"), fields)).otherwise("a\tb")).otherwise(fields)
    return B.gaf_annotations(P.table(spark, d, "lineitem").select(short.alias("value"), _pos().alias("pos")))


@query("SELECT 'P' || p_partkey AS gene, upper(p_brand) || ',' || upper(replace(p_type, ' ', '')) AS members, 2 AS n FROM part")
def s36_subunits(spark, d):
    """Members between semicolons; brackets are cut and names that begin with a digit dropped."""
    text = F.concat(F.lower("p_brand"), F.lit("(x); "), F.replace("p_type", F.lit(" "), F.lit("")), F.lit(" ;9"), "p_brand")
    rows = P.table(spark, d, "part").select(P.gene("p_partkey").alias("gene"), B.subunits(text).alias("m"))
    return rows.select("gene", F.array_join("m", ",").alias("members"), F.size("m").alias("n"))


@query("SELECT p_partkey AS k, 'a' || p_size || ',b' AS items FROM part")
def s37_lists(spark, d):
    text = F.concat(F.lit(" a"), F.col("p_size").cast("string"), F.lit(" ;; b ;"))
    return P.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.array_join(B.listed(text), ",").alias("items"))


@query(CHROM + "SELECT 'P' || k AS gene, 'both' AS kind FROM (SELECT k FROM a INTERSECT SELECT k FROM r) UNION ALL SELECT 'P' || k, 'first' FROM (SELECT k FROM a EXCEPT SELECT k FROM r)")
def u1_set_operations(spark, d):
    lines = P.table(spark, d, "lineitem")
    own = lambda n, f: lines.where((F.col("l_linenumber") == n) & (F.col("l_returnflag") == f)).select(P.gene("l_partkey").alias("gene"))
    a, r = own(1, "A"), own(2, "R")
    return a.intersect(r).withColumn("kind", F.lit("both")).unionByName(a.subtract(r).withColumn("kind", F.lit("first")))
