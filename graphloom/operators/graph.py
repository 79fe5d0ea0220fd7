"""Typed neighbourhoods over edge tables, for all centres at once.

Edges are (src, dst, edge_type, score, evidence).  Ranks are written as
``row_number() <= k``, which Spark limits where a centre's rows lie; ties go by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.graph_store import dealt, written

#: Types whose edges count from both ends.
UNDIRECTED = ("PPI",)
#: Types along which a neighbourhood grows further.
EXPANDABLE = ("PPI", "TRRUST", "CORUM")
LEAST_CAP = 5


def incident(edges: DataFrame, undirected: tuple[str, ...] = UNDIRECTED, best: int | None = None) -> DataFrame:
    """center, neighbor, edge_type, score, evidence, direction.

    Undirected edges give both ends' rows in one pass over the edges, so that
    what makes them runs once.  best: leaves out a source's row of an edge whose
    ``place`` among the source's edges of its type, if there is one, is past it."""
    end = lambda a, b, way: F.struct(F.col(a).alias("center"), F.col(b).alias("neighbor"), F.lit(way).alias("direction"))
    out, back = end("src", "dst", "out"), end("dst", "src", "in")
    ways = F.when(F.col("edge_type").isin(*undirected), F.array(out, back)).otherwise(F.array(out))
    if best is not None and "place" in edges.columns:
        past = F.when(F.col("edge_type").isin(*undirected), F.array(back)).otherwise(F.slice(F.array(out), 1, 0))
        ways = F.when(F.col("place") > best, past).otherwise(ways)
    return edges.select(F.explode(ways).alias("e"), "edge_type", "score", "evidence").select("e.center", "e.neighbor", "edge_type", "score", "evidence", "e.direction")


def cap_of(k: int, weights: dict[str, float] | None = None) -> Column:
    """A type's cap: k times its weight, whole, LEAST_CAP at least."""
    cap = F.lit(max(LEAST_CAP, int(k)))
    for t, w in (weights or {}).items():
        cap = F.when(F.col("edge_type") == t, F.lit(max(LEAST_CAP, int(k * w)))).otherwise(cap)
    return cap


def unit_hash(*parts: Column | str) -> Column:
    """A reproducible number in (0, 1) from the md5 of the joined parts."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def typed_neighbors(edges: DataFrame, k: int = 50, method: str = "top_k", weights: dict[str, float] | None = None, seed: str = "0") -> DataFrame:
    """The neighbours of each centre by type, capped, with their rank.

    top_k: best scores first (missing 0).  random: by a seeded hash.  weighted:
    without replacement, with chances as score ** weight (Efraimidis and
    Spirakis).  Any other method gives none."""
    top = max([max(LEAST_CAP, int(k)), *(max(LEAST_CAP, int(k * x)) for x in (weights or {}).values())])
    rows = incident(edges, best=top if method == "top_k" else None)
    u = unit_hash(F.lit(seed), "center", "neighbor", "edge_type")
    if method == "top_k":
        order = [F.coalesce("score", F.lit(0.0)).desc()]
    elif method == "random":
        order = [u.asc()]
    elif method == "weighted":
        base = F.greatest(F.lit(0.1), F.coalesce("score", F.lit(1.0)))
        power = F.lit(1.0)
        for t, w in (weights or {}).items():
            power = F.when(F.col("edge_type") == t, F.lit(max(w, 0.1))).otherwise(power)
        order = [(-F.log(u) / F.pow(base, power)).asc()]
    else:
        return rows.withColumn("rank", F.lit(0).cast("long")).limit(0)
    w = Window.partitionBy("center", "edge_type").orderBy(*order, F.col("neighbor"), F.col("direction"))
    ranked = dealt(rows, 2 * edges.count(), "center").withColumn("rank", F.row_number().over(w).cast("long"))
    # the constant bound is what Spark limits by
    return ranked.where(F.col("rank") <= top).where(F.col("rank") <= cap_of(k, weights))


#: Keys of most rows, whose facts are broadcast: of the rows that are counted no
#: other key has more than a share of 1 / HUBS.
HUBS = 1024


def looked_up(rows: DataFrame, facts: DataFrame, key: str, spread: str, counts: DataFrame, n_rows: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``facts`` (null where it lacks ``key``).

    A key of many rows would gather them in one task: the facts of the largest, a
    fixed number of them by ``counts`` (key, n), go to all tasks, and their rows are
    dealt by ``spread``.  n_rows: about how many rows there are."""
    own = [c for c in facts.columns if c != key]
    hubs = counts.orderBy(F.desc("n"), key).limit(HUBS).select(key)
    of_hubs = facts.join(F.broadcast(hubs), key, "left_semi").select(key, F.lit(True).alias("_hub"), F.struct(*own).alias("_hub_facts"))
    place = F.when(F.col("_hub"), F.concat(F.lit("\0"), spread)).otherwise(F.col(key))
    named = rows.columns
    rows = dealt(rows.join(F.broadcast(of_hubs), key, "left").withColumn("_key", place), n_rows, "_key")
    rows = rows.join(facts.select(F.col(key).alias("_id"), F.struct(*own).alias("_facts")), (F.col("_key") == F.col("_id")) & F.col("_hub").isNull(), "left")
    return rows.withColumn("_facts", F.coalesce("_hub_facts", "_facts")).select(*named, *[F.col(f"_facts.{c}").alias(c) for c in own])


def summary(edges: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """One row for each centre: neighbours by type, and in all."""
    counts = [F.count_if(F.col("edge_type") == t).alias(f"n_{t.lower()}") for t in types]
    return incident(edges).groupBy("center").agg(*counts, F.count("*").alias("total"))


def edge_types_of(edges: DataFrame) -> DataFrame:
    return incident(edges).select("center", "edge_type").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree (in and out), out_degree."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(F.count("*").alias("degree"), F.sum("e.o").alias("out_degree"))


def center_of(edges: DataFrame) -> DataFrame:
    """The node with most out-edges (ties: least id), one row."""
    out = edges.groupBy("src").agg(F.count("*").alias("out_degree"))
    return out.orderBy(F.desc("out_degree"), "src").limit(1).select(F.col("src").alias("center"), "out_degree")


def undirected_pairs(edges: DataFrame) -> DataFrame:
    own = edges.where(F.col("edge_type").isin(*UNDIRECTED) & (F.col("src") != F.col("dst")))
    return own.select(F.least("src", "dst").alias("gene_a"), F.greatest("src", "dst").alias("gene_b")).distinct()


def collapse_multi_edges(edges: DataFrame, priority: tuple[str, ...]) -> DataFrame:
    """One edge for each ordered pair: the type that comes last in ``priority``."""
    place = F.array_position(F.array(*[F.lit(t) for t in priority]), F.col("edge_type"))
    best = edges.groupBy("src", "dst").agg(F.max_by(F.struct("edge_type", "score", "evidence"), F.struct(place, "evidence")).alias("e"))
    return best.select("src", "dst", "e.*")


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, label, n of nodes and edges."""
    n = nodes.groupBy(F.col("node_label").alias("label")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "label", "n")
    return n.unionByName(edges.groupBy(F.col("edge_type").alias("label")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "label", "n"))


def subgraph_stats(neighbors: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each centre: distinct nodes with itself, genes among them, edges."""
    own = neighbors.join(nodes.select(F.col("node_id").alias("neighbor"), "node_label"), "neighbor", "left")
    per = own.groupBy("center", "neighbor").agg(F.count("*").alias("e"), F.first("node_label").alias("node_label"))
    return per.groupBy("center").agg((F.count("*") + 1).alias("n_nodes"), F.count_if(F.col("node_label") == "gene").alias("n_genes"), F.sum("e").alias("n_edges"))


def expand(edges: DataFrame, centers: DataFrame, hops: int = 2, k: int = 20, mode: str = "intended") -> DataFrame:
    """center, node, hop of bounded breadth-first neighbourhoods.

    Each hop's cap is 0.7 of the last one's (10 at least); each frontier node
    gives up to max(cap // frontier, 5) neighbours along expandable types.
    mode "reference" stops after the first hop, as nodes seen there are never
    expanded; "intended" goes on."""
    # a hop is read three times by the next one: written once, not made again
    first = typed_neighbors(edges, k).join(centers, "center", "left_semi").select("center", F.col("neighbor").alias("node")).distinct()
    if mode != "reference":
        first = written(first, "hop")
    seen = centers.select("center", F.col("center").alias("node"), F.lit(0).cast("long").alias("hop")).unionByName(first.where("center <> node").select("center", "node", F.lit(1).cast("long").alias("hop")))
    if mode == "reference":
        return seen
    most, caps = k, []
    for _ in range(2, hops + 1):
        most = max(10, int(most * 0.7))
        caps.append(most)
    # a node's best neighbours are the same for every centre, so they are ranked and cut once,
    # before frontiers meet them: no hub's whole neighbourhood is joined
    grow = incident(edges.where(F.col("edge_type").isin(*EXPANDABLE))).groupBy(F.col("center").alias("node"), "neighbor").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "neighbor"))
    grow = grow.withColumn("r", rank).where(F.col("r") <= max(caps, default=LEAST_CAP)).drop("score")
    for hop, cap in enumerate(caps, 2):
        frontier = seen.where(F.col("hop") == hop - 1)
        size = frontier.groupBy("center").agg(F.count("*").alias("size"))
        each = frontier.join(size, "center").select("center", "node", F.greatest(F.lit(5), F.floor(F.lit(cap) / F.col("size"))).alias("own"))
        found = each.join(grow, "node").where(F.col("r") <= F.col("own")).select("center", F.col("neighbor").alias("node")).distinct()
        new = found.join(seen, ["center", "node"], "left_anti").select("center", "node", F.lit(hop).cast("long").alias("hop"))
        seen = seen.unionByName(written(new, "hop") if hop < hops else new)
    return seen
