"""Nodes, edges and look-ups of the biomedical sources beyond the plain readers.

Rows come with ``pos``, their place in the file, wherever the first or last of a
key counts.  Headers are resolved on the driver, rows never are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.identifiers import exploded, first_of
from graphloom.sources import biofiles as B

# Node labels of the ontology's namespaces.
NAMESPACES = {"P": "biological process", "F": "molecular function", "C": "cellular component"}
HPO_ROLES = {"gene": ("gene_symbol", "gene"), "hpo_id": ("hpo_id", "hpo_term_id", "term_id"), "hpo_name": ("hpo_name", "hpo_term_name", "term_name"), "frequency": ("frequency",)}
HPO_PLACES = {"gene": 1, "hpo_id": 2, "hpo_name": 3, "frequency": 4}
OMIM_ROLES = {"genes": ("gene_symbol", "gene"), "mim": ("mim", "omim"), "phenotype": ("phenotype", "disease")}
CATALOGUE = (
    ("string_links", "automatic"), ("string_aliases", "automatic"), ("trrust", "automatic"), ("go_basic", "automatic"), ("goa_human", "automatic"),
    ("hgnc", "automatic"), ("reactome", "automatic"), ("hpo", "automatic"), ("gtex", "automatic"),
    ("omim", "manual"), ("cellmarker", "manual"), ("corum", "manual"), ("panglaodb", "manual"),
)


def existing(spark: SparkSession, path: str) -> str:
    """The path, if there is something; FileNotFoundError else."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)
    return path


#: The type of edges that a source brings.
BRINGS = {"string_links": "PPI", "trrust": "TRRUST", "goa_human": "GO", "hpo": "HPO", "cellmarker": "CellMarker", "reactome": "Reactome", "omim": "OMIM", "gtex": "GTEx", "corum": "CORUM"}


def checked(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """source, fetched, edges: the catalogue with the edges that are there of each
    source; null for sources that bring none."""
    brings = spark.createDataFrame(list(BRINGS.items()), "source string, edge_type string")
    n = edges.groupBy("edge_type").agg(F.count("*").alias("n"))
    return catalogue(spark).join(brings, "source", "left").join(n, "edge_type", "left").select("source", "fetched", F.when(F.col("edge_type").isNotNull(), F.coalesce("n", F.lit(0))).alias("edges"))


def catalogue(spark: SparkSession) -> DataFrame:
    """source, fetch: what is downloaded and what a user has to bring (no network here)."""
    return spark.createDataFrame(list(CATALOGUE), "source string, fetched string")


def tf_set(rows: DataFrame) -> DataFrame:
    """Distinct regulators of a regulation table."""
    return rows.where(F.col("tf").isNotNull()).select(B.symbol("tf").alias("tf")).distinct()


def go_nodes(annotations: DataFrame, ontology: DataFrame) -> DataFrame:
    """Terms as first annotated, with the ontology's name and text where it has
    them: annotations dst, aspect, pos; ontology id, name, definition."""
    label = F.lit(NAMESPACES["P"])
    for k, v in NAMESPACES.items():
        label = F.when(F.col("aspect") == k, v).otherwise(label)
    seen = first_of(annotations, ["dst"], ["pos"]).select(F.col("dst").alias("node_id"), label.alias("node_label"))
    known = ontology.select(F.col("id").alias("node_id"), "name", "definition")
    return seen.join(known, "node_id", "left").select("node_id", "node_label", F.coalesce("name", "node_id").alias("name"), "definition")


def hpo_rows(table: DataFrame) -> DataFrame:
    """gene, hpo_id, hpo_name, frequency, pos by header, else by place; rows
    without a gene or term are left out."""
    names = B.resolve_header([c for c in table.columns if c != "pos"], HPO_ROLES, HPO_PLACES)
    own = [F.col(f"`{names[r]}`").cast("string").alias(r) if r in names else F.lit(None).cast("string").alias(r) for r in HPO_ROLES]
    rows = table.select(*own, "pos")
    return rows.where(F.trim("gene") != "").where(F.col("hpo_id").startswith("HP:"))


def hpo_nodes(rows: DataFrame) -> DataFrame:
    return first_of(rows, ["hpo_id"], ["pos"]).select(F.col("hpo_id").alias("node_id"), F.lit("phenotypic feature").alias("node_label"), F.coalesce("hpo_name", "hpo_id").alias("name"))


def hpo_edges(rows: DataFrame) -> DataFrame:
    own = rows.select(B.symbol("gene").alias("src"), F.col("hpo_id").alias("dst"), "frequency", "pos")
    return first_of(own, ["src", "dst"], ["pos"]).select("src", "dst", "frequency")


def marker_rows(sheet: DataFrame) -> DataFrame:
    """species, cancer_type, symbol, cell_name, tissue, ontology, pmid, pos of a
    sheet of cell markers; genes stand under Symbol or, without it, marker, and
    numbers lose their fraction.  Columns that the sheet lacks are null."""
    has = {c.lower(): c for c in sheet.columns}
    own = lambda *names: next((F.trim(F.col(f"`{has[n]}`")) for n in names if n in has), F.lit(None).cast("string"))
    number = F.regexp_replace(own("pmid"), r"\.0*$", "")
    return sheet.select(
        own("species").alias("species"), own("cancer_type").alias("cancer_type"), own("symbol", "marker").alias("symbol"), own("cell_name").alias("cell_name"),
        own("tissue_type").alias("tissue"), own("cellontology_id").alias("ontology"), number.alias("pmid"), "pos",
    )


def cell_nodes(rows: DataFrame, species: str, cancer: str | None = None) -> DataFrame:
    """Cells of a marker table with the tissue of their first row."""
    own = rows.where((F.col("species") == species) & F.col("cell_name").isNotNull())
    if cancer is not None:
        own = own.where(F.col("cancer_type") == cancer)
    first = first_of(own, ["cell_name"], ["pos"])
    node = F.concat(F.lit("CellMarker:"), F.replace("cell_name", F.lit(" "), F.lit("_")))
    return first.select(node.alias("node_id"), F.lit("cell").alias("node_label"), F.col("cell_name").alias("name"), "tissue")


def hierarchy(rows: DataFrame, prefix: str = "R-HSA") -> DataFrame:
    """Pathway to pathway edges with both ends of the species."""
    return rows.where(F.col("parent").startswith(prefix) & F.col("child").startswith(prefix)).select(F.col("parent").alias("src"), F.col("child").alias("dst"))


def omim_kind_of(path: Column) -> Column:
    """``omim_kind`` of a column of paths."""
    name = F.lower(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1))
    return F.when(F.contains(name, F.lit("morbidmap")), "morbidmap").when(F.contains(name, F.lit("genemap")), "genemap").otherwise("generic")


def omim_kind(path: str) -> str:
    """Which layout a disease file has, by its name."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return "morbidmap" if "morbidmap" in name else "genemap" if "genemap" in name else "generic"


def genemap_rows(rows: DataFrame) -> DataFrame:
    """phenotype, genes, mim, pos of (genes, phenotypes, pos): phenotypes stand
    between semicolons; the MIM number is the last six digits alone between commas
    or, without any, eight digits of a hash of the text, the same in every run."""
    each = exploded(rows.select("genes", F.col("phenotypes").alias("phenotype"), "pos"), "phenotype", ";")
    number = F.element_at(F.filter(F.transform(F.split("phenotype", ","), lambda x: F.regexp_extract(x, r"^\s*(\d{6})(?:\s*\(\d\))?\s*$", 1)), lambda x: x != ""), -1)
    fallback = F.concat(F.lit("H"), F.substring(F.md5(F.col("phenotype").cast("binary")), 1, 8))
    several = F.size(F.filter(F.split("phenotype", ","), lambda x: F.regexp_like(x, F.lit(r"^\s*\d{6}(\s*\(\d\))?\s*$")))) > 0
    return each.select("phenotype", "genes", F.when(several, number).otherwise(fallback).alias("mim"), "pos")


def generic_disease_rows(table: DataFrame) -> DataFrame:
    """The same of any table whose headers name genes, numbers and phenotypes."""
    names = B.resolve_header([c for c in table.columns if c != "pos"], OMIM_ROLES, {"genes": 0, "mim": 1, "phenotype": 2})
    return table.select(*[F.col(f"`{names[r]}`").cast("string").alias(r) for r in ("phenotype", "genes", "mim")], "pos")


def disease_nodes(rows: DataFrame) -> DataFrame:
    """Diseases of (phenotype, genes, mim, pos), as first named."""
    name, kind = B.phenotype(F.col("phenotype"))
    own = rows.where(F.col("mim").isNotNull()).select(F.concat(F.lit("OMIM:"), "mim").alias("node_id"), name.alias("name"), kind.alias("inheritance"), "pos")
    return first_of(own, ["node_id"], ["pos"]).select("node_id", F.lit("disease").alias("node_label"), "name", "inheritance")


def gct(spark: SparkSession, path: str) -> DataFrame:
    """A GCT expression table: two lines before the header; pos and all columns."""
    text = B.numbered(B.lines(spark, path), "value")
    head = text.where("i = 2").first()
    parts = F.split("value", "\t", -1)
    rows = text.where((F.col("i") > 2) & (F.col("value") != ""))
    return rows.select(F.col("i").alias("pos"), *[parts[k].alias(n) for k, n in enumerate(head["value"].split("\t"))])


def expression_table(table: DataFrame) -> tuple[DataFrame, str]:
    """A wide expression table without its identifier columns, and its gene column."""
    names = B.resolve_header([c for c in table.columns if c != "pos"], {"gene": ("description", "gene_symbol", "symbol", "gene"), "id": ("name", "ensembl", "gene_id")}, {"gene": 0})
    gene = names["gene"]
    drop = [c for c in table.columns if c not in (gene, "pos") and (c == names.get("id") or c.lower() in ("id", "name", "gene_id"))]
    return table.drop(*drop), gene


def complex_nodes(rows: DataFrame, organism: str = "human") -> DataFrame:
    """Complexes of (complex_id, complex_name, go_ids, subunits, organism, pos),
    with their first five annotations."""
    own = first_of(rows.where(F.contains(F.lower("organism"), F.lit(organism.lower()))), ["complex_id"], ["pos"])
    go = F.array_join(F.slice(B.listed(F.col("go_ids")), 1, 5), ";")
    return own.select(F.concat(F.lit("CORUM:"), "complex_id").alias("node_id"), F.lit("protein complex").alias("node_label"), F.col("complex_name").alias("name"), go.alias("go_ids"))


def genes_of_complexes(edges: DataFrame) -> DataFrame:
    """dst and the sorted genes of each complex."""
    return edges.groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("genes"))


def complexes_of_genes(edges: DataFrame) -> DataFrame:
    """src and the sorted complexes of each gene."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("complexes"))


def panglao_rows(table: DataFrame, species: str = "Hs") -> DataFrame:
    """symbol, cell_type, organ, sensitivity, specificity, pos of one species,
    with headers in any case."""
    names = {c.lower().strip(): c for c in table.columns}
    pick = lambda role, *words: next((F.col(f"`{names[w]}`") for w in words if w in names), F.lit(None).cast("string")).alias(role)
    rows = table.select(
        pick("species", "species"), pick("symbol", "official gene symbol", "symbol"), pick("cell_type", "cell type", "cell_type"), pick("organ", "organ"),
        pick("sensitivity", "sensitivity_human", "sensitivity"), pick("specificity", "specificity_human", "specificity"), "pos",
    )
    return rows.where(F.contains(F.lower("species"), F.lit(species.lower()))).drop("species")


def panglao_edges(rows: DataFrame) -> DataFrame:
    cell = F.concat(F.lit("PanglaoDB:"), F.replace("cell_type", F.lit(" "), F.lit("_")))
    own = rows.where(F.col("symbol").isNotNull() & F.col("cell_type").isNotNull())
    own = own.select(B.symbol("symbol").alias("src"), cell.alias("dst"), F.col("sensitivity").cast("double").alias("sensitivity"), F.col("specificity").cast("double").alias("specificity"), "pos")
    return first_of(own, ["src", "dst"], ["pos"]).drop("pos")


def markers_of(rows: DataFrame) -> DataFrame:
    """cell_type and its sorted distinct markers."""
    return rows.where(F.col("symbol").isNotNull()).groupBy("cell_type").agg(F.array_sort(F.collect_set(B.symbol("symbol"))).alias("markers"))


def chromatin_annotations(states: DataFrame, bare: DataFrame) -> DataFrame:
    """gene, state: of (gene, state) and genes without methylation, which take
    part only where no other state is known (later sets overwrite earlier ones)."""
    both = bare.select("gene", F.lit("no_methylation").alias("b")).join(states, "gene", "full")
    return both.select("gene", F.coalesce("state", "b").alias("state"))


def annotated_genes(states: DataFrame, bare: DataFrame) -> DataFrame:
    """All genes of the three sets that tasks use; silent-only ones are none of them."""
    return states.where(F.col("state").isin("bivalent", "lys4_only")).select("gene").union(bare.select("gene")).distinct()


def chromatin_counts(states: DataFrame, bare: DataFrame) -> DataFrame:
    return chromatin_annotations(states, bare).groupBy("state").agg(F.count("*").alias("n"))


def labelled(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """gene, label of two sets: 1 wins where a gene is in both."""
    rows = positive.select("gene", F.lit(1).alias("label")).unionByName(negative.select("gene", F.lit(0).alias("label")))
    return rows.groupBy("gene").agg(F.max("label").alias("label"))


def two_column_sets(rows: DataFrame, first: str, second: str) -> DataFrame:
    """gene, label of a table with a column of positives and one of negatives."""
    side = lambda c, y: rows.select(F.upper(F.trim(c)).alias("gene"), F.lit(y).alias("label")).where((F.col("gene") != ""))
    return side(first, 1).unionByName(side(second, 0)).distinct()


def known_cells(cells: DataFrame, column: str = "cell_type") -> DataFrame:
    """Rows with a cell type that is neither null nor ``Unknown``."""
    return cells.where(F.col(column).isNotNull() & (F.col(column) != "Unknown"))


def class_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def id_cache(nodes: DataFrame) -> DataFrame:
    """symbol, node_id, ensembl of gene nodes: what look-ups join with."""
    return nodes.where("node_label = 'gene'").select(F.upper("node_id").alias("symbol"), "node_id", "ensembl")


def ensembl_keys(rows: DataFrame, ids: DataFrame, cache: DataFrame) -> DataFrame:
    """ensembl, key: an embedding's id by the identifier itself, without its
    version, or by the symbol that the cache has for it."""
    bare = F.substring_index("ensembl", ".", 1)
    known = ids.select(F.col("id").alias("a"))
    out = rows.select("ensembl", bare.alias("bare")).join(known, F.col("ensembl") == F.col("a"), "left")
    out = out.join(ids.select(F.col("id").alias("b")), F.col("bare") == F.col("b"), "left")
    symbol = cache.where(F.col("ensembl").isNotNull()).groupBy(F.col("ensembl").alias("bare")).agg(F.min("node_id").alias("symbol"))
    named = symbol.join(ids.select(F.col("id").alias("symbol")), "symbol", "left_semi").select("bare", F.col("symbol").alias("c"))
    return out.join(named, "bare", "left").select("ensembl", F.coalesce("a", "b", "c").alias("key"))


def inverse_map(maps: DataFrame, kind: str) -> DataFrame:
    """symbol, key: one identifier of a kind for each symbol, the least."""
    return maps.where(F.col("kind") == kind).groupBy("symbol").agg(F.min("key").alias("key"))


def first_row(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's first row: what a look-up by it returns."""
    return first_of(rows, [key], order)

