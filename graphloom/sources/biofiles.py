"""Readers of the biomedical source files, each a plan over its text.

Positions in files come with the rows where "first" or "later wins" matters: rows
of one file stand in its order, whatever other files are packed into the same
partition, and files in the order of their names (``place``).  Every reader
takes a path that Spark reads, compressed or not, and gives columns named
alike; nothing is parsed on the driver but a header line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.identifiers import exploded, first_of, last_of

# Accepted sources of symbols.
STRING_SOURCES = ("BioMart_HUGO", "Ensembl_HGNC", "Ensembl_HGNC_symbol", "BLAST_KEGG_NAME")
# Inheritance codes in the order in which they are tried.
INHERITANCE = (("AD", "Autosomal dominant"), ("AR", "Autosomal recessive"), ("XL", "X-linked"), ("XLR", "X-linked recessive"), ("XLD", "X-linked dominant"), ("YL", "Y-linked"), ("Mi", "Mitochondrial"))


def place() -> Column:
    """Where a row stands: its file, the block of the file and the row in it.
    Compared in this order, rows of any number of files are in file order."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, pos of a text file."""
    return spark.read.text(path).select("value", place().alias("pos"))


def tsv(spark: SparkSession, path: str, names: list[str], header: bool = False, sep: str = "\t", comment: str | None = None) -> DataFrame:
    """Text columns by name, and pos."""
    schema = ", ".join(f"`{n}` string" for n in names)
    r = spark.read.schema(schema).option("sep", sep).option("header", header).option("quote", "")
    return (r.option("comment", comment) if comment else r).csv(path).select("*", place().alias("pos"))


def symbol(c: str) -> Column:
    return F.upper(F.trim(F.col(c)))


def hgnc_nodes(rows: DataFrame) -> DataFrame:
    """Gene nodes of an HGNC table; rows without a symbol are skipped, ids that
    came as floats lose their fraction."""
    entrez = F.regexp_replace("entrez_gene_id" if "entrez_gene_id" in rows.columns else "entrez_id", r"\.0+$", "")
    return rows.where(F.trim("symbol") != "").select(symbol("symbol").alias("node_id"), F.lit("gene").alias("node_label"), F.col("name"), entrez.alias("entrez_id"))


def string_edges(links: DataFrame, aliases: DataFrame, threshold: int = 700) -> DataFrame:
    """Interactions with a score of the threshold or more between mapped,
    different symbols; one for each unordered pair, the first in the file."""
    known = first_of(aliases.where(F.col("source").isin(*STRING_SOURCES)), ["ensp"], ["pos"]).select("ensp", F.upper("alias").alias("symbol"))
    strong = links.where(F.col("combined_score").cast("int") >= threshold)
    a, b = known.select(F.col("ensp").alias("protein1"), F.col("symbol").alias("s1")), known.select(F.col("ensp").alias("protein2"), F.col("symbol").alias("s2"))
    pairs = strong.join(a, "protein1").join(b, "protein2").where("s1 <> s2")
    pairs = pairs.withColumn("lo", F.least("s1", "s2")).withColumn("hi", F.greatest("s1", "s2"))
    return first_of(pairs, ["lo", "hi"], ["pos"]).select(F.col("s1").alias("src"), F.col("s2").alias("dst"), (F.col("combined_score").cast("double") / 1000).alias("score"))


def trrust_edges(rows: DataFrame) -> DataFrame:
    kind = F.col("regulation_type")
    direction = F.when(kind == "Activation", "positive").when(kind == "Repression", "negative").otherwise("unknown")
    return rows.where(F.col("tf").isNotNull() & F.col("target").isNotNull()).select(symbol("tf").alias("src"), symbol("target").alias("dst"), kind.alias("regulation_type"), direction.alias("direction"), "pmid")


def obo_terms(text: DataFrame) -> DataFrame:
    """id, name, namespace, definition of each [Term] stanza; text: value, the
    file split at blank lines."""
    tag = lambda t: F.nullif(F.regexp_extract("value", rf"(?m)^{t}: (.*)$", 1), F.lit(""))
    body = text.where(F.regexp_like("value", F.lit(r"(?m)^\[Term\]")))
    return body.select(tag("id").alias("id"), tag("name").alias("name"), tag("namespace").alias("namespace"), F.nullif(F.regexp_extract("value", r'(?m)^def: "([^"]*)"', 1), F.lit("")).alias("definition"), F.coalesce(tag("is_obsolete") == "true", F.lit(False)).alias("obsolete")).where("id IS NOT NULL")


def gaf_annotations(text: DataFrame, aspects: tuple[str, ...] = ("P",)) -> DataFrame:
    """First annotation of each (gene, term) of a GAF file's lines (value, pos)."""
    f = text.where(~F.col("value").startswith("!")).select(F.split("value", "\t").alias("f"), "pos").where(F.size("f") >= 15)
    rows = f.select(F.upper(F.col("f")[2]).alias("src"), F.col("f")[4].alias("dst"), F.col("f")[6].alias("evidence"), F.col("f")[8].alias("aspect"), "pos").where(F.col("aspect").isin(*aspects))
    return first_of(rows, ["src", "dst"], ["pos"]).drop("pos")


def reactome_edges(pathways: DataFrame, genes: DataFrame, entrez: DataFrame, prefix: str = "R-HSA", species: str = "Homo sapiens") -> tuple[DataFrame, DataFrame]:
    """Pathway nodes, those only named by an association included, and gene
    edges once each."""
    named = last_of(pathways.where(F.col("id").startswith(prefix)), ["id"], ["pos"]).select("id", "name")
    ids = last_of(entrez, ["entrez"], ["pos"]).select("entrez", "symbol")
    own = genes.where((F.col("species") == species) & F.col("pathway").startswith(prefix)).join(ids, "entrez")
    edges = first_of(own, ["symbol", "pathway"], ["pos"]).select(F.col("symbol").alias("src"), F.col("pathway").alias("dst"), "evidence")
    missing = first_of(own, ["pathway"], ["pos"]).join(named.select(F.col("id").alias("pathway")), "pathway", "left_anti").select(F.col("pathway").alias("id"), F.col("name"))
    return named.unionByName(missing), edges


def pathway_stats(edges: DataFrame) -> DataFrame:
    per = edges.groupBy("dst").agg(F.countDistinct("src").alias("n"))
    return per.agg(F.count("*").alias("pathways"), F.sum("n").alias("associations"), F.round(F.avg("n"), 6).alias("avg_genes"), F.max("n").alias("max_genes"))


def phenotype(text: Column) -> tuple[Column, Column]:
    """Name and inheritance of an OMIM phenotype: a code in brackets or after a
    comma; one leading [ { ? and one closing ] } go, and a trailing number."""
    kind = F.lit(None).cast("string")
    for code, name in reversed(INHERITANCE):
        kind = F.when(F.contains(text, F.lit(f"({code})")) | F.contains(text, F.lit(f", {code}")), name).otherwise(kind)
    name = F.trim(text)
    for pattern in (r"^\[", r"^\{", r"^\?", r"\]$", r"\}$"):
        name = F.regexp_replace(name, pattern, "")
    return F.trim(F.regexp_replace(name, r",\s*\d+\s*$", "")), kind


def morbidmap_edges(rows: DataFrame) -> DataFrame:
    """Gene to disease edges of (phenotype, genes, mim, pos), once each."""
    name, kind = phenotype(F.col("phenotype"))
    own = exploded(rows.where(F.col("mim").isNotNull()), "genes", ",").select(F.upper("genes").alias("src"), F.concat(F.lit("OMIM:"), "mim").alias("dst"), name.alias("name"), kind.alias("inheritance"), "pos")
    return first_of(own, ["src", "dst"], ["pos"]).drop("pos")


def tissue_edges(wide: DataFrame, gene: str, least_tpm: float = 1.0, least_tau: float = 0.0) -> DataFrame:
    """src, tissue, tpm, relative, tau of a wide expression table: tau is the
    mean of 1 - x / max over the other tissues; the best row of a pair stays."""
    tissues = [c for c in wide.columns if c not in (gene, "pos")]
    return expression(wide.select(gene, "pos", *tissues).unpivot([gene, "pos"], tissues, "tissue", "tpm").withColumnRenamed(gene, "src"), least_tpm, least_tau)


def expression(long: DataFrame, least_tpm: float = 1.0, least_tau: float = 0.0) -> DataFrame:
    """The same from rows src, pos, tissue, tpm; a gene's row is (src, pos)."""
    w = Window.partitionBy("src", "pos")
    top, n = F.max("tpm").over(w), F.count("*").over(w)
    r = long.withColumn("tpm", F.col("tpm").cast("double")).withColumn("top", top).withColumn("n", n)
    share = F.when(F.col("top") > 0, 1 - F.col("tpm") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)).otherwise(0.0)
    r = r.withColumn("lack", F.sum(share).over(w))
    tau = F.when((F.col("n") <= 1) | (F.col("top") <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("lack") / F.greatest(F.col("n") - 1, F.lit(1)))))
    r = r.withColumn("tau", tau).where((F.col("tpm") >= least_tpm) & (F.col("tau") >= least_tau))
    r = r.withColumn("relative", F.col("tpm") / F.col("top"))
    return first_of(r, ["src", "tissue"], [F.desc("tpm"), F.asc("pos")]).select("src", "tissue", "tpm", "relative", "tau")


def subunits(text: Column) -> Column:
    """Members of a complex: by ; else , else white space; cut at a bracket;
    names that begin with a digit are none."""
    parts = F.when(F.contains(text, F.lit(";")), F.split(text, ";")).when(F.contains(text, F.lit(",")), F.split(text, ",")).otherwise(F.split(text, r"\s+"))
    clean = F.transform(parts, lambda x: F.upper(F.trim(F.substring_index(F.trim(x), "(", 1))))
    return F.filter(clean, lambda x: (x != "") & ~F.regexp_like(x, F.lit("^[0-9]")))


def listed(text: Column, sep: str = ";") -> Column:
    return F.filter(F.transform(F.split(text, sep), lambda x: F.trim(x)), lambda x: x != "")


def corum_edges(rows: DataFrame, organism: str = "human") -> DataFrame:
    """Gene to complex edges of (complex_id, complex_name, subunits, organism, pos)."""
    own = rows.where(F.contains(F.lower("organism"), F.lit(organism.lower()))).withColumn("members", subunits(F.col("subunits")))
    e = own.select(F.concat(F.lit("CORUM:"), "complex_id").alias("dst"), "complex_name", F.size("members").alias("subunit_count"), F.explode("members").alias("src"), "pos")
    return first_of(e, ["src", "dst"], ["pos"]).select("src", "dst", "complex_name", "subunit_count")


def cell_edges(rows: DataFrame, species: str, prefix: str = "CellMarker:") -> DataFrame:
    """Marker edges of (species, symbol, cell_name, tissue, pos), once each."""
    own = rows.where((F.col("species") == species) & F.col("symbol").isNotNull() & F.col("cell_name").isNotNull())
    e = own.select(symbol("symbol").alias("src"), F.concat(F.lit(prefix), F.replace("cell_name", F.lit(" "), F.lit("_"))).alias("dst"), F.col("tissue"), "pos")
    return first_of(e, ["src", "dst"], ["pos"]).drop("pos")


def gene_list(text: DataFrame) -> DataFrame:
    """gene of each line that is neither empty nor a comment, once."""
    return text.select(F.upper(F.trim("value")).alias("gene")).where((F.col("gene") != "") & ~F.col("gene").startswith("#")).distinct()


def chromatin_states(active: DataFrame, silent: DataFrame) -> DataFrame:
    """gene, state of two gene lists: bivalent in both, else lys4 or lys27 only."""
    both = active.select("gene", F.lit(1).alias("a")).join(silent.select("gene", F.lit(1).alias("b")), "gene", "full")
    return both.select("gene", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "bivalent").when(F.col("a").isNotNull(), "lys4_only").otherwise("lys27_only").alias("state"))


def gene_pairs(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """g1, g2, label of two files read side by side, as long as the shorter.
    Lines (value, pos) are numbered partition by partition."""
    both = numbered(texts.withColumnRenamed("value", "pair"), "pair").join(numbered(labels.withColumnRenamed("value", "label"), "label"), "i")
    parts = F.split(F.trim("pair"), r"\s+")
    return both.where(F.size(parts) >= 2).select(F.upper(parts[0]).alias("g1"), F.upper(parts[1]).alias("g2"), F.col("label").cast("int").alias("label"))


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """``column`` and i: places from 0 without gaps in the order of ``pos`` (see
    ``place``).  Blocks of files are numbered side by side and shifted by the rows
    of those before."""
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_file": F.col("pos.file"), "_start": F.col("pos.start")})
    first = rows.groupBy("_file", "_start").agg(F.count("*").alias("_n"))
    first = first.select("_file", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    nth = F.row_number().over(Window.partitionBy("_file", "_start").orderBy("pos")) - 1
    own = rows.join(F.broadcast(first), ["_file", "_start"])  # a row for each block of a file
    return own.select(F.col(column), (F.col("_first") + nth).alias("i"))


def without_overlap(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """gene, label of two lists; genes of both are left out."""
    p, n = positive.select("gene").distinct(), negative.select("gene").distinct()
    return p.join(n, "gene", "left_anti").withColumn("label", F.lit(1)).unionByName(n.join(p, "gene", "left_anti").withColumn("label", F.lit(0)))


def resolve_header(columns: list[str], roles: dict[str, tuple[str, ...]], positions: dict[str, int] | None = None) -> dict[str, str]:
    """Which column has each role: the first that holds one of its words, else
    the one at its usual position."""
    norm = {c: c.lower().strip().replace(" ", "_").replace("-", "_") for c in columns}
    out = {}
    for role, words in roles.items():
        hit = next((c for c in columns for w in words if w in norm[c]), None)
        at = (positions or {}).get(role)
        if hit is None and at is not None and at < len(columns):
            hit = columns[at]
        if hit is not None:
            out[role] = hit
    return out


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Parquet tables; edges apart by type, so that a type reads only itself."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
