"""Text of neighbourhoods: numbered sections, sentences and contexts.

Lists are ranked by a window first and cut there, so no group is collected
beyond what is printed; the counts come along from the same window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import HUBS, looked_up
from graphloom.sources.graph_store import dealt

# Headings, empty texts and sizes of the sections.
SECTIONS = {
    "PPI": ("Found {n} protein interaction partners:", "No protein-protein interactions found.", 10),
    "GO": ("Participates in {n} biological processes:", "No biological process annotations found.", 10),
    "HPO": ("Associated with {n} phenotypes:", "No phenotype associations found.", 10),
    "TRRUST": ("Regulates {n} target genes:", "No transcription factor regulation information found.", 5),
    "TRRUST_IN": ("Regulated by {n} transcription factors:", "", 5),
    "CellMarker": ("Marker for {n} cell types:", "No cell type marker information found.", 10),
    "Reactome": ("Participates in {n} biological pathways:", "No pathway information found.", 10),
    "OMIM": ("Associated with {n} diseases:", "No disease associations found.", 10),
    "GTEx": ("Expressed in {n} tissues:", "No tissue expression data found.", 10),
    "CORUM": ("Member of {n} protein complexes:", "No protein complex membership found.", 10),
}
CONTEXT_ORDER = ("HPO", "TRRUST", "GO", "PPI", "Reactome", "CellMarker", "OMIM", "GTEx", "CORUM")
HEADERS = {
    "PPI": "Protein-Protein Interactions", "GO": "Gene Ontology Annotations", "HPO": "Phenotype Associations", "TRRUST": "Regulatory Relationships", "Reactome": "Pathway Membership",
    "CellMarker": "Cell Type Markers", "OMIM": "Disease Associations", "GTEx": "Tissue Expression", "CORUM": "Protein Complex Membership",
}
LINES = {"minimal": 5, "local": 15, "extended": 30}


def fixed(x: Column, places: int) -> Column:
    """A number with so many decimals; half-way cases go away from zero, by its
    decimal digits (nine after the point)."""
    return F.round(x.cast("decimal(28,9)"), places).cast(f"decimal(28,{places})").cast("string")


def scaled_score(score: Column) -> Column:
    """0-1000 without decimals for scores under 1; 1.0 and above as they are."""
    return F.when(score < 1, F.floor(score * 1000).cast("string")).otherwise(fixed(score, 1))


def section_rows(edges: DataFrame) -> DataFrame:
    """What each section of each centre lists: one row for each end that tells of
    the other, in one pass over the edges, with what its line says and no more."""
    t = F.col("edge_type")
    end = lambda a, b, section: F.struct(F.col(a).alias("center"), F.col(b).alias("neighbor"), section.alias("section"))
    out = end("src", "dst", t)
    back = end("dst", "src", F.when(t == "TRRUST", "TRRUST_IN").otherwise(t))
    ends = F.explode(F.when(t.isin("PPI", "TRRUST"), F.array(out, back)).otherwise(F.array(out)))
    score = F.when(t.isin("PPI", "GTEx"), F.col("score")).alias("score")
    said = F.when(t.isin("TRRUST", "CellMarker", "OMIM", "GTEx", "CORUM"), F.col("evidence")).alias("evidence")
    return edges.select(ends.alias("e"), score, said).select("e.*", "score", "evidence")


def section_line(name: Column) -> Column:
    """The text of a listed row with its neighbour's name."""
    t, e, score = F.col("section"), F.col("evidence"), F.coalesce("score", F.lit(0.0))
    bracket = lambda *parts: F.when(e.isNotNull(), F.concat(F.lit(" ("), *parts, F.lit(")"))).otherwise("")
    return (
        F.when(t == "PPI", F.concat("neighbor", F.lit(" (confidence score: "), scaled_score(score), F.lit(")")))
        .when(t.isin("TRRUST", "TRRUST_IN"), F.concat("neighbor", F.lit(" ("), F.coalesce(e, F.lit("unknown")), F.lit(")")))
        .when(t == "CellMarker", F.concat(name, bracket(F.lit("tissue: "), e)))
        .when(t == "OMIM", F.concat(name, bracket(e)))
        .when(t == "GTEx", F.concat(name, F.lit(" (TPM: "), fixed(score, 1), F.lit(", specificity: "), fixed(F.coalesce(e, F.lit("0")).cast("double") / 1000, 2), F.lit(")")))
        .when(t == "CORUM", F.concat(name, bracket(e, F.lit(" subunits"))))
        .otherwise(name)
    )


def sections(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text for each (center, section): a count and the first lines, by place
    and then id.  A centre's rows come together in one shuffle, where they are ranked,
    counted and cut and where their texts are made: names of few targets are broadcast,
    only those of many come by a shuffle of what is listed."""
    n = 2 * edges.count()
    rows, group = dealt(section_rows(edges), n, "center"), Window.partitionBy("center", "section")
    place = F.when(F.col("section").isin("PPI", "GTEx"), -F.coalesce("score", F.lit(0.0))).otherwise(0.0)
    ranked = rows.withColumn("r", F.row_number().over(group.orderBy(place, "neighbor"))).withColumn("n", F.count("*").over(group))
    most = F.lit(10)
    for name, (_, _, k) in SECTIONS.items():
        most = F.when(F.col("section") == name, k).otherwise(most)
    shown = ranked.where(F.col("r") <= most)
    # interactions and regulations are told by ids
    targets = edges.where(~F.col("edge_type").isin("PPI", "TRRUST")).groupBy(F.col("dst").alias("neighbor")).agg(F.count("*").alias("n"))
    names = nodes.select(F.col("node_id").alias("neighbor"), "name")
    if targets.limit(HUBS + 1).count() <= HUBS:
        shown = shown.join(F.broadcast(names.join(F.broadcast(targets), "neighbor", "left_semi")), "neighbor", "left")
    else:
        shown = looked_up(shown, names, "neighbor", "center", targets, n)
    shown = shown.withColumn("line", section_line(F.coalesce("name", "neighbor")))
    shown = shown.groupBy("center", "section").agg(F.max("n").alias("n"), F.count("*").alias("k"), F.array_sort(F.collect_list(F.struct("r", "line"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda x: F.concat(F.lit("  "), x["r"].cast("string"), F.lit(". "), x["line"])), "\n")
    head = F.lit("")
    for name, (text, _, _) in SECTIONS.items():
        before, after = text.split("{n}")
        head = F.when(F.col("section") == name, F.concat(F.lit(before), F.col("n").cast("string"), F.lit(after))).otherwise(head)
    rest = F.when(F.col("n") > F.col("k"), F.concat(F.lit("\n  ... and "), (F.col("n") - F.col("k")).cast("string"), F.lit(" more"))).otherwise("")
    return shown.select("center", "section", F.col("n").cast("long").alias("n"), F.concat(head, F.lit("\n"), body, rest).alias("text"))


# Names of the sections in a gene's description, in their order.
INFO = {"ppi_info": "PPI", "go_info": "GO", "phenotype_info": "HPO", "tf_info": "TRRUST", "celltype_info": "CellMarker", "pathway_info": "Reactome", "disease_info": "OMIM", "tissue_info": "GTEx", "complex_info": "CORUM"}


def subgraph_text(centers: DataFrame, texts: DataFrame) -> DataFrame:
    """center and its nine sections; what a gene lacks has its empty text, and
    regulation holds both directions."""
    by = texts.groupBy("center").agg(F.map_from_entries(F.collect_list(F.struct("section", "text"))).alias("m"))
    rows = centers.select("center").join(by, "center", "left")
    said = lambda s: F.try_element_at("m", F.lit(s))
    both = F.concat_ws("\n", said("TRRUST"), said("TRRUST_IN"))
    text = {s: F.coalesce(said(s), F.lit(SECTIONS[s][1])) for s in INFO.values()}
    text["TRRUST"] = F.coalesce(F.nullif(both, F.lit("")), F.lit(SECTIONS["TRRUST"][1]))
    return rows.select("center", *[text[s].alias(c) for c, s in INFO.items()])


# What a selection of features keeps, and what the rest says.
FEATURES = {"essential": ("ppi_info", "go_info", "phenotype_info"), "diverse": ("ppi_info", "go_info", "phenotype_info", "tf_info", "pathway_info", "celltype_info")}
LEFT_OUT = "Not included (feature selection)"


def feature_selection(info: dict[str, Column], mode: str, wanted: Column | None = None) -> dict[str, Column]:
    """Sections by name after a selection: ``all`` keeps them, ``task_specific``
    those in ``wanted`` (an array of names), a known mode its own, others all."""
    if mode == "task_specific" and wanted is not None:
        return {k: F.when(F.array_contains(wanted, k), v).otherwise(LEFT_OUT) for k, v in info.items()}
    keep = FEATURES.get(mode)
    return info if keep is None else {k: v if k in keep else F.lit(LEFT_OUT) for k, v in info.items()}


# Labels of the sections in a styled prompt.
STYLE_LABELS = {
    "ppi_info": "Protein Interactions", "go_info": "Biological Processes", "phenotype_info": "Phenotypes",
    "tf_info": "Regulatory Relations", "pathway_info": "Pathways", "celltype_info": "Cell Type Markers",
}


def style_context(info: dict[str, Column]) -> Column:
    """The sections that say something, each after its label."""
    line = lambda k, v: F.when((v != "") & ~F.contains(v, F.lit("Not included")) & ~F.contains(F.left(v, F.lit(10)), F.lit("No ")), F.concat(F.lit(f"- {STYLE_LABELS[k]}: "), v))
    parts = F.array_compact(F.array(*[line(k, info[k]) for k in STYLE_LABELS if k in info]))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise("Limited information available.")


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with its {names} replaced; unknown names stand as they are."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


def styled_prompt(base: Column, context: Column, style: str, templates: dict[str, str], focus: str = "", keywords: Column | None = None) -> Column:
    """A prompt in a style: its template around the base prompt and the context
    (``analytical`` is the base alone), then guidance and up to five keywords."""
    out = base if style == "analytical" else filled(templates.get(style, "{base_prompt}"), {"base_prompt": base, "context": context})
    if focus:
        out = F.concat(out, F.lit("\n\n" + focus))
    if keywords is not None:
        out = F.when(F.size(keywords) > 0, F.concat(out, F.lit("\n\nEmphasize these aspects if relevant: "), F.array_join(F.slice(keywords, 1, 5), ", "))).otherwise(out)
    return out


def query_text(symbol: Column, name: Column, summary: Column, task: Column) -> Column:
    """What is asked for a gene: symbol and name, the first sentence of its
    summary if it has over 20 characters, and the task."""
    first = F.trim(F.substring_index(F.coalesce(summary, F.lit("")), ".", 1))
    head = F.concat(F.lit("Gene "), symbol, F.when(name.isNotNull() & (name != "") & (name != symbol), F.concat(F.lit(" ("), name, F.lit(")"))).otherwise(""))
    return F.concat_ws(" ", head, F.when(F.length(first) > 20, F.concat(first, F.lit("."))), F.when(F.coalesce(task, F.lit("")) != "", F.concat(F.lit("Task: "), task)))


def triplets(edges: DataFrame, nodes: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Sentences of all edges with ids t_0, t_1, ... without gaps, in the order of
    a hash of src, then src, dst and type.

    Rows are numbered in 4,096 hash buckets side by side; the buckets' counts give
    each its first number."""
    own = sentences(edges, nodes, include, exclude).withColumn("_b", F.substring(F.md5(F.col("src").cast("binary")), 1, 3))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = own.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    nth = F.row_number().over(Window.partitionBy("_b").orderBy("src", "dst", "edge_type")) - 1
    rows = own.join(F.broadcast(first), "_b")  # 4,096 rows at most
    return rows.select(F.concat(F.lit("t_"), (F.col("_first") + nth).cast("string")).alias("triplet_id"), "src", "dst", "edge_type", "score", "text")


def membership(triplets: DataFrame) -> DataFrame:
    """gene, triplet_id of both ends of each triplet, once each."""
    return triplets.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("gene"), "triplet_id")


def short_description(text: Column, most: int = 200) -> Column:
    """None for texts of ten characters or fewer; longer ones end at a word."""
    cut = F.when(F.length(text) >= most, F.concat(F.regexp_replace(F.substring(text, 1, most), r" [^ ]*\z", ""), F.lit("..."))).otherwise(text)
    return F.when(F.length(text) > 10, cut)


def sentences(edges: DataFrame, nodes: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """One sentence for each edge of the types included and not excluded."""
    own = edges
    if include:
        own = own.where(F.col("edge_type").isin(include))
    if exclude:
        own = own.where(~F.col("edge_type").isin(exclude))
    a = nodes.select(F.col("node_id").alias("src"), F.col("name").alias("name_a"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("name").alias("name_b"), F.col("definition").alias("def_b"))
    n, counts = edges.count(), own.groupBy("dst").agg(F.count("*").alias("n"))
    # edges to nodes of most edges get their names where their sources' are; only others travel on
    hubs = F.broadcast(counts.orderBy(F.desc("n"), "dst").limit(HUBS).select("dst").join(b.select("dst"), "dst", "left_semi"))
    near, far = own.join(hubs, "dst", "left_semi"), own.join(hubs, "dst", "left_anti")
    near = dealt(near, n, "src").join(a, "src", "left").join(F.broadcast(b.join(hubs, "dst", "left_semi")), "dst", "left")
    far = dealt(dealt(far, n, "src").join(a, "src", "left"), n, "dst").join(b, "dst", "left")
    rows = near.unionByName(far)
    x, y, t = F.coalesce("name_a", "src"), F.coalesce("name_b", "dst"), F.col("edge_type")
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    score = F.coalesce("score", F.lit(0.0))
    score = F.when((t == "PPI") & (score > 1), score / 1000).otherwise(score)
    d, e = short_description(F.col("def_b")), F.col("evidence")
    text = (
        F.when(t == "PPI", say(x, " physically interacts with ", y, " (confidence: ", fixed(score, 2), ")"))
        .when((t == "GO") & d.isNotNull(), say(x, " participates in ", y, ": ", d, " (evidence: ", F.coalesce(e, F.lit("unknown")), ")"))
        .when(t == "GO", say(x, " participates in biological process ", y, " (evidence: ", F.coalesce(e, F.lit("unknown")), ")"))
        .when((t == "HPO") & e.isNotNull(), say(x, " is associated with phenotype ", y, " (frequency: ", e, ")"))
        .when(t == "HPO", say(x, " is associated with phenotype ", y))
        .when((t == "TRRUST") & (e == "Activation"), say(x, " activates expression of ", y))
        .when((t == "TRRUST") & (e == "Repression"), say(x, " represses expression of ", y))
        .when(t == "TRRUST", say(x, " regulates ", y))
        .when(t == "Reactome", say(x, " is involved in pathway ", y))
        .when((t == "CellMarker") & e.isNotNull(), say(x, " is a marker for ", y, " in ", e))
        .when(t == "CellMarker", say(x, " is a marker for cell type ", y))
        .when(t == "OMIM", say(x, " is associated with disease ", y))
        .when((t == "GTEx") & (score > 0), say(x, " is expressed in ", y, " (TPM: ", fixed(F.col("score"), 1), ")"))
        .when(t == "GTEx", say(x, " is expressed in tissue ", y))
        .when(t == "CORUM", say(x, " is part of protein complex ", y))
        .otherwise(say(x, " is related to ", y, " via ", t))
    )
    return rows.select("src", "dst", "edge_type", "score", text.alias("text"))


def contexts(found: DataFrame, per_type: int = 10) -> DataFrame:
    """One context for each query from (query_id, edge_type, text, score, rank):
    types in a fixed order, ``per_type`` each."""
    w = Window.partitionBy("query_id", "edge_type").orderBy("rank")
    top = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_type)
    lines = top.groupBy("query_id", "edge_type").agg(F.count("*").alias("k"), F.array_sort(F.collect_list(F.struct("r", F.concat(F.lit("- "), "text", F.lit(" (relevance: "), F.format_string("%.2f", F.col("score")), F.lit(")")).alias("line")))).alias("rows"))
    place = F.array_position(F.array(*[F.lit(t) for t in CONTEXT_ORDER]), F.col("edge_type"))
    header = F.col("edge_type")
    for t, name in HEADERS.items():
        header = F.when(F.col("edge_type") == t, name).otherwise(header)
    section = F.concat(F.lit("### "), header, F.lit(" ("), F.col("k").cast("string"), F.lit(" items):\n"), F.array_join(F.transform("rows", lambda x: x["line"]), "\n"))
    parts = lines.select("query_id", F.struct(F.when(place == 0, 100).otherwise(place).alias("p"), F.col("edge_type").alias("t"), section.alias("s")).alias("part"))
    return parts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["s"]), "\n\n").alias("context"))


def context_window(text: Column, window: str) -> Column:
    """The first lines of a text, or parts between commas if it has few lines,
    as many as the window's name allows; other windows keep all."""
    if window not in LINES:
        return text
    k, lines, parts = LINES[window], F.split(text, "\n"), F.split(text, ", ")
    few = F.when(F.size(parts) > k, F.concat(F.array_join(F.slice(parts, 1, k), ", "), F.lit(", ... ("), (F.size(parts) - k).cast("string"), F.lit(" more)"))).otherwise(text)
    return F.when(F.size(lines) > k, F.concat(F.array_join(F.slice(lines, 1, k), "\n"), F.lit(f"\n... (truncated to {k} items)"))).otherwise(few)


def feedback(metric: Column, best: Column) -> Column:
    """The verdict's wording for a metric and what it did to the best one."""
    # Lower bounds and wordings.
    bands = (
        (0.95, "EXCEPTIONAL - Outstanding strategy performance."),
        (0.92, "EXCELLENT - The strategy is working very well."),
        (0.88, "VERY GOOD - Strong performance with minor room for improvement."),
        (0.85, "GOOD - The strategy is effective."),
        (0.75, "MODERATE - There is room for improvement."),
        (0.65, "BELOW AVERAGE - The strategy needs changes."),
        (0.55, "POOR - The strategy needs significant changes."),
    )
    level = F.lit("VERY POOR - Consider a major strategy revision.")
    for bound, name in reversed(bands):
        level = F.when(metric >= bound, name).otherwise(level)
    d = metric - best
    number = lambda x: F.format_string("%.4f", x)
    suffix = F.when(best.isNull(), "").when(d > 0.001, F.concat(F.lit(" (\u2191"), number(d), F.lit(" from best, NEW BEST!)"))).when(d < -0.01, F.concat(F.lit(" (\u2193"), number(-d), F.lit(" from best)"))).when(d < -0.001, F.concat(F.lit(" (\u2193"), number(-d), F.lit(" from best, minor decline)"))).otherwise(" (\u2248 best performance)")
    return F.concat(F.lit("Performance: "), level, suffix)
