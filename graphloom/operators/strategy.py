"""Extraction strategies as columns: parsing, clamping, keys and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a strategy may hold, its bounds and its defaults.
EDGE_TYPES = ("PPI", "GO", "HPO", "TRRUST", "CellMarker", "Reactome")
SAMPLING = ("top_k", "random", "weighted")
LENGTHS = ("short", "medium", "long")
HOPS, NEIGHBORS, DEFAULT_TYPES = (1, 3), (10, 200), ("PPI", "GO", "HPO")
JSON_SCHEMA = "edge_types array<string>, max_hops string, max_neighbors string, sampling string, description_length string, edge_weights map<string,double>, neighbors_per_type map<string,bigint>, include_statistics boolean, focus_keywords array<string>, reasoning string"


def json_of(text: Column) -> Column:
    """The JSON object in a response: in a code fence, else from the first brace
    to the last, else null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    plain = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.nullif(F.coalesce(F.nullif(fenced, F.lit("")), plain), F.lit(""))


def _whole(text: Column, low: int, high: int, default: int) -> Column:
    n = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*(-?\d{1,9})(?:\.\d*)?\s*$", 1).try_cast("int")
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(n, F.lit(default))))


def sanitised(parsed: Column) -> Column:
    """A parsed strategy within its bounds; what is missing or unknown takes its
    default."""
    known = F.filter(F.coalesce(parsed["edge_types"], F.array().cast("array<string>")), lambda t: t.isin(*EDGE_TYPES))
    types = F.when(F.size(known) > 0, known).otherwise(F.array(*[F.lit(t) for t in DEFAULT_TYPES]))
    one_of = lambda c, values, default: F.when(F.lower(c).isin(*values), F.lower(c)).otherwise(default)
    weights = F.map_filter(parsed["edge_weights"], lambda k, v: k.isin(*EDGE_TYPES) & v.isNotNull())
    limits = F.map_filter(parsed["neighbors_per_type"], lambda k, v: k.isin(*EDGE_TYPES) & v.isNotNull())
    return F.struct(
        types.alias("edge_types"),
        _whole(parsed["max_hops"], *HOPS, 2).alias("max_hops"),
        _whole(parsed["max_neighbors"], *NEIGHBORS, 50).alias("max_neighbors"),
        one_of(parsed["sampling"], SAMPLING, "top_k").alias("sampling"),
        one_of(parsed["description_length"], LENGTHS, "medium").alias("description_length"),
        F.transform_values(weights, lambda k, v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))).alias("edge_weights"),
        F.transform_values(limits, lambda k, v: F.greatest(F.lit(NEIGHBORS[0]), F.least(F.lit(NEIGHBORS[1]), v))).alias("neighbors_per_type"),
        F.transform(F.slice(F.coalesce(parsed["focus_keywords"], F.array().cast("array<string>")), 1, 10), lambda k: F.substring(F.trim(k), 1, 50)).alias("focus_keywords"),
        F.substring(F.coalesce(parsed["reasoning"], F.lit("")), 1, 500).alias("reasoning"),
    )


def from_response(text: Column) -> Column:
    """A strategy from a response: its JSON, else what plain words say."""
    return sanitised(F.coalesce(F.from_json(json_of(text), JSON_SCHEMA), from_words(text)))


def from_words(text: Column) -> Column:
    """Edge types, hops, neighbours and sampling that a sentence names."""
    low = F.lower(text)
    number = lambda p: F.nullif(F.regexp_extract(low, p, 1), F.lit(""))
    named = F.array_compact(F.array(*[F.when(F.regexp_like(low, F.lit(rf"\b{t.lower()}\b")), t) for t in EDGE_TYPES]))
    method = F.when(F.contains(low, F.lit("weighted")), "weighted").when(F.contains(low, F.lit("random")), "random")
    empty = F.from_json(F.lit("{}"), JSON_SCHEMA)
    return F.struct(
        named.alias("edge_types"),
        number(r"(\d+)[- ]hops?").alias("max_hops"),
        number(r"(\d+) neighbors").alias("max_neighbors"),
        method.alias("sampling"),
        *[empty[c].alias(c) for c in ("description_length", "edge_weights", "neighbors_per_type", "include_statistics", "focus_keywords", "reasoning")],
    )


def features_from_keywords(keywords: Column) -> Column:
    """The sections that a list of keywords asks for."""
    text = F.lower(F.array_join(keywords, " "))
    has = lambda *w: F.regexp_like(text, F.lit("|".join(w)))
    more = F.array_compact(F.array(F.when(has("regulat", "transcript", "tf", "expression"), "tf_info"), F.when(has("pathway", "reactome", "signal"), "pathway_info"), F.when(has("cell", "tissue", "expression", "marker"), "celltype_info")))
    return F.concat(F.array(F.lit("ppi_info"), F.lit("go_info"), F.lit("phenotype_info")), more)


def suggestions(successes: DataFrame, current: DataFrame, k: int = 3) -> DataFrame:
    """Up to k strategies for each task: its own best ones, two of each task of
    its family and the best of every other, none with the current edge types.

    successes: task, family, edge_types (a sorted, joined list), improvement;
    current: task, family, edge_types.  A task meets no other task but those in two
    short tables: the best entries of its family, of which 2 k + 4 are enough for
    every member, and the best of all, of which 2 (k + 1) are."""
    rank = F.row_number().over(Window.partitionBy("task").orderBy(F.desc("improvement"), "edge_types"))
    s = successes.withColumn("r", rank)
    now = current.select(F.col("task").alias("for_task"), F.col("family").alias("f"), F.col("edge_types").alias("now"))
    own = s.where(F.col("r") <= k).join(now, F.col("task") == F.col("for_task")).withColumn("source", F.lit("same_task"))
    # of a family a task needs the k best entries that are neither its own (two at
    # most) nor have its current edge types: of each value of edge_types the first
    # k + 2 are enough, and of these the first 2 k + 4
    by = lambda *keys: F.row_number().over(Window.partitionBy("family", *keys).orderBy(F.desc("improvement"), "task", "edge_types"))
    best_kin = s.where("r <= 2").withColumn("t", by("edge_types")).where(F.col("t") <= k + 2).withColumn("t", by()).where(F.col("t") <= 2 * k + 4).drop("t")
    kin = best_kin.join(now, (F.col("family") == F.col("f")) & (F.col("task") != F.col("for_task"))).withColumn("source", F.lit("similar_task"))
    # a task needs the k + 1 best (one can be its own) without its current edge
    # types: of each value of edge_types k + 1 are enough, and of these the first
    # 2 (k + 1) hold k + 1 of other values, whichever value is left out
    of_types = F.row_number().over(Window.partitionBy("edge_types").orderBy(F.desc("improvement"), "task"))
    top = s.where("r = 1").withColumn("t", of_types).where(F.col("t") <= k + 1).drop("t").orderBy(F.desc("improvement"), "task").limit(2 * (k + 1))
    best = now.crossJoin(F.broadcast(top)).where(F.col("task") != F.col("for_task")).withColumn("source", F.lit("best_from"))
    cols = ["for_task", "source", "task", "edge_types", "improvement", "now"]
    rows = own.select(*cols).unionByName(kin.select(*cols)).unionByName(best.select(*cols)).where(F.col("edge_types") != F.col("now"))
    w = Window.partitionBy("for_task").orderBy(F.desc("improvement"), "source", "task", "edge_types")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).drop("now")


def thinking_mode(state: Column, prune: Column) -> Column:
    return F.when(prune & (state != "breakthrough"), "PRUNE").when(state == "breakthrough", "FINE_TUNE").when(state == "stagnation", "HIGH_ENTROPY").otherwise("ANALYZE_AND_PIVOT")


def weight_band(weight: Column) -> Column:
    return F.when(weight >= 0.8, "RECOMMENDED").when(weight >= 0.6, "useful").when(weight <= 0.3, "discouraged").when(weight <= 0.5, "neutral").otherwise("")


def adapted_weights(trends: DataFrame, start: tuple[float, float, float] = (0.10, 0.10, 0.80), step: float = 0.1, pull: float = 0.3) -> DataFrame:
    """task, iterations, baseline, relative, raw after a fold over its trends in
    order: plateaus weigh changes more, declines the level, oscillations the
    baseline, improvements pull back to the start; the three sum to one."""
    ordered = trends.groupBy("task").agg(F.transform(F.array_sort(F.collect_list(F.struct("iteration", "direction"))), lambda x: x["direction"]).alias("d"))
    b0, r0, w0 = start

    def one(acc, t):
        b, r, w = acc["baseline"], acc["relative"], acc["raw"]
        nb = F.when(t == "oscillating", F.least(F.lit(0.5), b + step * 0.4)).when(t == "improving", b + (F.lit(b0) - b) * pull).otherwise(b)
        nr = F.when(t == "plateau", F.least(F.lit(0.7), r + step * 0.5)).when(t == "declining", F.greatest(F.lit(0.3), r - step * 0.2)).when(t == "improving", r + (F.lit(r0) - r) * pull).otherwise(r)
        nw = F.when(t == "declining", F.least(F.lit(0.4), w + step * 0.3)).when(t == "improving", w + (F.lit(w0) - w) * pull).otherwise(w)
        total = nb + nr + nw
        return F.struct((nb / total).alias("baseline"), (nr / total).alias("relative"), (nw / total).alias("raw"))

    begin = F.struct(F.lit(b0).alias("baseline"), F.lit(r0).alias("relative"), F.lit(w0).alias("raw"))
    return ordered.select("task", F.size("d").cast("long").alias("iterations"), F.aggregate("d", begin, one).alias("w")).select("task", "iterations", "w.*")


def prompt_history(rewards: DataFrame, most: int = 3, near: float = 0.99) -> DataFrame:
    """The last rows near the best reward (else the last two) with what each did
    against the row before it."""
    w = Window.partitionBy("task")
    r = rewards.withColumn("best", F.max("reward").over(w)).withColumn("back", F.row_number().over(w.orderBy(F.desc("iteration"))))
    r = r.withColumn("good", (F.col("best") <= 0) | (F.col("reward") >= F.col("best") * near)).withColumn("any", F.max(F.col("good").cast("int")).over(w))
    r = r.where(F.col("good") | ((F.col("any") == 0) & (F.col("back") <= 2)))
    r = r.withColumn("back", F.row_number().over(w.orderBy(F.desc("iteration")))).where(F.col("back") <= most)
    d = F.col("reward") - F.lag("reward").over(w.orderBy("iteration"))
    return r.withColumn("effect", F.when(d.isNull(), "BASELINE").when(d > 0, "EFFECTIVE").when(d < 0, "INEFFECTIVE").otherwise("NEUTRAL")).select("task", "iteration", "reward", "effect")


def recommendations(stats: DataFrame) -> DataFrame:
    """edge_type, advice for types with mostly low scores (n_rows, n_low)."""
    share = F.col("n_low") / F.col("n_rows")
    bad = stats.where((share > 0.5) & (F.col("n_rows") >= 10))
    return bad.select("edge_type", F.concat("edge_type", F.lit(" has "), F.format_string("%.0f", share * 100), F.lit("% low-relevance neighbors -> consider reducing or removing")).alias("advice"))
