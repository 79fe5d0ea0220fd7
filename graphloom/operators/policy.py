"""Policies over strategies and selections, and the texts that tell of them.

Everything is a column expression or a window plan over tables of strategies,
scores or effects; choices that were drawn at random come from a seeded hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import unit_hash
from graphloom.operators.rendering import fixed
from graphloom.operators.scoring import HIGH, LOW
from graphloom.operators.strategy import EDGE_TYPES, SAMPLING
from graphloom.sources.graph_store import dealt

# Reward weights by task (baseline, relative, raw, bonus, plateau),
# and what tasks without an own entry have.
REWARD_WEIGHTS = {
    "ppi": (0.10, 0.10, 0.80, 0.0, -0.05), "ggi": (0.10, 0.10, 0.80, 0.0, -0.05), "genetype": (0.10, 0.10, 0.80, 0.0, -0.05), "cell": (0.10, 0.10, 0.80, 0.0, -0.05),
    "geneattribute": (0.10, 0.10, 0.80, 0.0, -0.05), "perturbation": (0.05, 0.10, 0.85, 0.0, -0.05),
}
DEFAULT_WEIGHTS = (0.10, 0.10, 0.80, 0.0, -0.05)
WEIGHT_NAMES = ("baseline_weight", "relative_weight", "raw_weight", "improvement_bonus", "plateau_penalty")
PRIMARY = {"ppi": "auc", "genetype": "f1", "ggi": "auc", "cell": "f1", "phenotype": "auc", "celltype": "f1", "dosage": "accuracy", "geneattribute": "auc"}
DISPLAY = {"ppi": "PPI Prediction", "genetype": "Gene Type Classification", "ggi": "Gene-Gene Interaction", "cell": "Cell Type Classification"}
# Advice for a task whose primary metric is low.
ADVICE = {
    "ppi": ("Consider increasing PPI edge weight in the strategy", "Try including more protein interaction partners in descriptions", "Focus prompt on protein domains and binding sites"),
    "genetype": (
        "Prioritize GO (Gene Ontology) edges for functional annotation", "Focus prompt on molecular function and biological processes",
        "Consider using balanced class weights for minority gene types",
    ),
    "ggi": (
        "Include both PPI and regulatory edges for interaction context", "Focus prompt on pathway membership and co-expression",
        "Consider using pre-trained gene2vec features as initialization",
    ),
    "cell": (
        "Prioritize CellMarker edges for cell-type specificity", "Focus prompt on tissue-specific expression patterns",
        "Consider using top-expressed genes only (reduce noise)",
    ),
    "phenotype": ("Consider prioritizing HPO edges", "Focus prompt on disease associations and clinical features"),
    "celltype": ("Consider prioritizing CellMarker edges", "Focus prompt on tissue-specific expression patterns"),
    "dosage": ("Consider including both TRRUST and GO edges", "Focus prompt on gene essentiality and regulatory networks"),
}
GENERAL_ADVICE = ("Consider increasing max_neighbors to capture more context", "Try different sampling methods (e.g., weighted vs top_k)")
ESSENTIAL_KEYS = (
    "edge_types", "max_neighbors", "max_hops", "sampling", "description_length", "description_focus",
    "context_window", "prompt_style", "feature_selection", "focus_keywords", "include_statistics",
)


def array_of(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def extraction_strategy(edge_types: Column, neighbors: Column, sampling: Column, hops: Column) -> dict[str, Column]:
    """The four keys that extraction reads: unknown edge types go (null: the usual
    three), negative or missing numbers and unknown methods take their defaults."""
    known = F.filter(edge_types, lambda t: t.isin(*EDGE_TYPES))
    return {
        "edge_types": F.when(edge_types.isNull(), array_of(("PPI", "GO", "HPO"))).otherwise(known),
        "max_neighbors": F.when(neighbors.isNull() | (neighbors < 0), 50).otherwise(neighbors).cast("long"),
        "sampling": F.when(sampling.isin(*SAMPLING), sampling).otherwise("top_k"),
        "max_hops": F.when(hops.isNull() | (hops < 0) | (hops > 3), 2).otherwise(hops).cast("long"),
    }


def essential(document: Column) -> Column:
    """A JSON strategy with its essential keys alone, as a map of texts."""
    return F.map_filter(F.from_json(document, "map<string,string>"), lambda k, v: k.isin(*ESSENTIAL_KEYS))


def same_types(a: Column, b: Column) -> Column:
    """Strategies are alike whose sets of edge types are equal."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def should_prune(neighbors: Column, best: Column) -> Column:
    """Over one and a half times the neighbours of the best strategy."""
    return F.coalesce(neighbors > best * 1.5, F.lit(False))


def best_neighbors(history: DataFrame) -> DataFrame:
    """Each iteration with the neighbours of the best one before it (first if tied)."""
    w = Window.partitionBy("task").orderBy("iteration").rowsBetween(Window.unboundedPreceding, -1)
    return history.withColumn("best_neighbors", F.max_by("max_neighbors", F.struct("metric", -F.col("iteration"))).over(w))


def reward_weights(tasks: DataFrame) -> DataFrame:
    """task and its weights: by its name, by the part before an underscore, or the
    usual ones."""
    names = list(REWARD_WEIGHTS)
    whole, family = F.col("task"), F.substring_index("task", "_", 1)
    key = F.when(whole.isin(*names), whole).when(family.isin(*names), family)
    # a name that merely begins like a known one counts as it
    for n in reversed(names):
        key = F.when(~F.coalesce(key.isin(*names), F.lit(False)) & F.startswith(whole, F.lit(n)), n).otherwise(key)
    out = tasks.withColumn("_k", key)
    for at, name in enumerate(WEIGHT_NAMES):
        value = F.lit(DEFAULT_WEIGHTS[at])
        for n, w in REWARD_WEIGHTS.items():
            value = F.when(F.col("_k") == n, w[at]).otherwise(value)
        out = out.withColumn(name, value)
    return out.select("task", *WEIGHT_NAMES)


def normalised_weights(weights: DataFrame) -> DataFrame:
    """The three shares divided by their sum, and whether they summed to one."""
    total = F.col("baseline_weight") + F.col("relative_weight") + F.col("raw_weight")
    rows = weights.withColumn("valid", F.abs(total - 1.0) < 0.01).withColumn("_t", F.when(total > 0, total).otherwise(1.0))
    return rows.withColumns({c: F.col(c) / F.col("_t") for c in WEIGHT_NAMES[:3]}).drop("_t")


def perturbed(strategies: DataFrame, strength: float = 0.3, seed: str = "0") -> DataFrame:
    """Variations of (id, edge_types, max_neighbors, max_hops, sampling): a swap of
    two neighbouring edge types, one more or one fewer; neighbours within 30 %; a
    hop more or fewer; another method.  Draws are seeded hashes of id."""
    u = lambda what: unit_hash(F.lit(seed), F.col("id").cast("string"), F.lit(what))
    types, n = F.col("edge_types"), F.size("edge_types")
    at = F.floor(u("swap") * F.greatest(n - 1, F.lit(1))).cast("int")
    swapped = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(types, F.when(i == at, i + 1).when(i == at + 1, i - 1).otherwise(i)))
    unused = F.array_except(array_of(EDGE_TYPES), types)
    more = F.array_append(types, F.get(unused, F.floor(u("add") * F.size(unused)).cast("int")))
    gone = F.floor(u("drop") * n).cast("int")
    fewer = F.filter(types, lambda x, i: i != gone)
    a, b, c = u("a"), u("b"), u("c")
    new_types = (
        F.when(a < strength, F.when(n > 1, swapped).otherwise(types))
        .when(b < strength * 0.5, F.when(F.size(unused) > 0, more).otherwise(types))
        .when((c < strength * 0.3) & (n > 2), fewer).otherwise(types)
    )
    count = F.greatest(F.lit(10), F.least(F.lit(200), F.floor(F.col("max_neighbors") * (u("by") * 0.6 + 0.7))))
    hops = F.greatest(F.lit(1), F.least(F.lit(3), F.col("max_hops") + F.when(u("way") < 0.5, -1).otherwise(1)))
    others = F.array_except(array_of(SAMPLING), F.array("sampling"))
    return strategies.select(
        "id", new_types.alias("edge_types"), F.when(u("n") < strength, count).otherwise(F.col("max_neighbors")).cast("long").alias("max_neighbors"),
        F.when(u("h") < strength, hops).otherwise(F.col("max_hops")).cast("long").alias("max_hops"),
        F.when(u("s") < strength * 0.5, F.get(others, F.floor(u("m") * F.size(others)).cast("int"))).otherwise(F.col("sampling")).alias("sampling"),
    )


def enforced(rows: DataFrame) -> DataFrame:
    """Proposals (p_*) beside current strategies (c_*): in HIGH_ENTROPY mode one
    nearer than 0.3 to the current strategy must differ - another method, 40 more
    neighbours where they differ by under 30, and with equal edge types the first
    unused one (under five) or all but the last (over two).  Other modes change nothing."""
    far = (F.col("mode") != "HIGH_ENTROPY") | (F.col("distance") >= 0.3)
    other = F.get(F.array_except(array_of(SAMPLING), F.array("c_sampling")), 0)
    sampling = F.when(far | (F.col("p_sampling") != F.col("c_sampling")), F.col("p_sampling")).otherwise(other)
    near = F.abs(F.col("p_max_neighbors") - F.col("c_max_neighbors")) < 30
    neighbors = F.when(far | ~near, F.col("p_max_neighbors")).otherwise(F.least(F.lit(200), F.greatest(F.lit(10), F.col("c_max_neighbors") + 40)))
    unused, n = F.array_except(array_of(EDGE_TYPES), F.col("c_edge_types")), F.size("c_edge_types")
    changed = (
        F.when((F.size(unused) > 0) & (n < 5), F.array_append("c_edge_types", F.get(unused, 0)))
        .when(n > 2, F.slice("c_edge_types", F.lit(1), n - 1)).otherwise(F.col("p_edge_types"))
    )
    types = F.when(far | ~same_types(F.col("p_edge_types"), F.col("c_edge_types")), F.col("p_edge_types")).otherwise(changed)
    return rows.select("id", types.alias("edge_types"), neighbors.cast("long").alias("max_neighbors"), sampling.alias("sampling"))


def consistency_advice(rows: DataFrame) -> DataFrame:
    """id, changes, advice: what a proposal (p_*) changes of the best strategy
    (c_*), and how an advantage bears on that.  The proposal itself stays."""
    part = lambda name, cond: F.when(cond, F.lit(name))
    changes = F.array_compact(F.array(
        part("edge_types", ~same_types(F.col("p_edge_types"), F.col("c_edge_types"))), part("max_hops", F.col("p_max_hops") != F.col("c_max_hops")),
        part("max_neighbors", F.abs(F.col("p_max_neighbors") - F.col("c_max_neighbors")) > 20), part("sampling", F.col("p_sampling") != F.col("c_sampling")),
    ))
    advice = F.when(F.size(changes) == 0, "similar").when(F.col("advantage") > 0.1, "explore").when(F.col("advantage") < -0.2, "caution").otherwise("allow")
    return rows.select("id", changes.alias("changes"), advice.alias("advice"))


def select_by_policy(scores: DataFrame, policies: DataFrame) -> DataFrame:
    """scores with ``selected`` by each centre's own policy (center, mode, top_k,
    threshold): defaults for zero and missing numbers, all for unknown modes and
    centres without a policy."""
    rows = scores.join(policies.select("center", "mode", "top_k", "threshold"), "center", "left")
    rank = F.row_number().over(Window.partitionBy("center").orderBy(F.desc("total"), "neighbor"))
    k = F.when(F.coalesce("top_k", F.lit(0)) > 0, F.col("top_k")).otherwise(20)
    least = F.when(F.coalesce("threshold", F.lit(0.0)) > 0, F.col("threshold")).otherwise(0.4)
    keep = F.when(F.col("mode") == "top_k", rank <= k).when(F.col("mode") == "threshold", F.col("total") >= least).otherwise(True)
    return rows.withColumn("selected", keep).drop("mode", "top_k", "threshold")


# ---- texts


def minimal_summary(scores: DataFrame) -> DataFrame:
    """center, text: how many neighbours, their mean, and high and low ones."""
    total = F.col("total")
    per = scores.groupBy("center").agg(F.count("*").alias("n"), F.avg("total").alias("a"), F.count_if(total >= HIGH).alias("h"), F.count_if(total < LOW).alias("l"))
    number = lambda c: F.col(c).cast("string")
    return per.select("center", F.concat("center", F.lit(": "), number("n"), F.lit(" neighbors, avg="), fixed(F.col("a"), 2), F.lit(", high="), number("h"), F.lit(", low="), number("l")).alias("text"))


def listed(rows: DataFrame, keys: list[str], place: str, line: Column, sep: str = "\n") -> DataFrame:
    """keys and the lines of each group joined in the order of ``place``."""
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), line.alias("line")))).alias("l"), F.count("*").alias("n"))
    return g.select(*keys, "n", F.array_join(F.transform("l", lambda x: x["line"]), sep).alias("lines"))


def detailed(scores: DataFrame) -> DataFrame:
    """center, text: every neighbour, best first, with the parts of its score."""
    w = Window.partitionBy("center").orderBy(F.desc("total"), "neighbor")
    three = lambda c: fixed(F.col(c), 3)
    line = F.concat(
        F.lit("### "), F.col("r").cast("string"), F.lit(". "), "neighbor", F.lit("\n  - Edge type: "), "edge_type", F.lit(" ("), "direction", F.lit(")\n  - Total score: "), three("total"),
        F.lit(" (confidence: "), fixed(F.col("confidence"), 2), F.lit(")\n  - Breakdown:\n    * Structural: "), three("structural"), F.lit("\n    * Task relevance: "), three("task_relevance"),
        F.lit("\n    * Semantic: "), three("semantic"), F.lit("\n    * Memory: "), three("memory"), F.lit("\n"),
    )
    g = listed(dealt(scores, scores.count(), "center").withColumn("r", F.row_number().over(w)), ["center"], "r", line)
    return g.select("center", F.concat(F.lit("## Detailed Neighbor Analysis for "), "center", F.lit("\nTotal neighbors: "), F.col("n").cast("string"), F.lit("\n\n"), "lines").alias("text"))


def analysis(scores: DataFrame, most: int = 10) -> DataFrame:
    """center, text: neighbours by relevance with up to ``most`` named in each
    band, and what to do about them."""
    band = F.when(F.col("total") >= HIGH, 1).when(F.col("total") >= LOW, 2).otherwise(3)
    w = Window.partitionBy("center", "b")
    rows = dealt(scores, scores.count(), "center").withColumn("b", band).withColumn("r", F.row_number().over(w.orderBy(F.desc("total"), "neighbor"))).withColumn("n", F.count("*").over(w)).where(F.col("r") <= most)
    one = F.concat("neighbor", F.lit(" ("), fixed(F.col("total"), 2), F.lit(", "), "edge_type", F.lit(")"))
    lines = rows.groupBy("center", "b").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("r"), one.alias("line"), "neighbor"))).alias("l"))
    title = (
        F.when(F.col("b") == 1, F.concat(F.lit(f"### High relevance (score >= {HIGH}): "), F.col("n").cast("string")))
        .when(F.col("b") == 2, F.concat(F.lit(f"### Medium relevance ({LOW} - {HIGH}): "), F.col("n").cast("string")))
        .otherwise(F.concat(F.lit(f"### Low relevance (score < {LOW}): "), F.col("n").cast("string")))
    )
    rest = F.when(F.col("n") > most, F.concat(F.lit("\n  ... and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    text = F.concat(title, F.lit(" neighbors\n  "), F.array_join(F.transform("l", lambda x: x["line"]), ", "), rest, F.lit("\n"))
    lows = F.array_join(F.transform(F.slice("l", 1, 5), lambda x: x["neighbor"]), ", ")
    parts = lines.select("center", "b", "n", text.alias("t"), lows.alias("lows"))
    pick = lambda b, c: F.max(F.when(F.col("b") == b, F.col(c)))
    g = parts.groupBy("center").agg(F.array_sort(F.collect_list(F.struct("b", "t"))).alias("s"), F.sum("n").alias("n"), pick(1, "n").alias("h"), pick(2, "n").alias("m"), pick(3, "n").alias("l"), pick(3, "lows").alias("lows"))
    advice = F.array_compact(F.array(
        F.when(F.col("l") > 3, F.concat(F.lit("- Consider excluding low-relevance neighbors: "), "lows")),
        F.when(F.col("h").isNull() & F.col("m").isNotNull(), "- No high-relevance neighbors found. Consider broadening edge types."),
        F.when(F.col("h") > 10, F.concat(F.lit("- Many high-relevance neighbors ("), F.col("h").cast("string"), F.lit("). Consider using top_k selection."))),
    ))
    head = F.concat(F.lit("## Neighbor Analysis for "), "center", F.lit("\nTotal neighbors: "), F.col("n").cast("string"), F.lit("\n"))
    return g.select("center", F.array_join(F.concat(F.array(head), F.transform("s", lambda x: x["t"]), F.array(F.lit("### Recommendations")), advice), "\n").alias("text"))


def several(texts: DataFrame, group: list[str], minimal: bool = False) -> DataFrame:
    """One text for each group of centres, in the order of their names.  Groups
    are a handful of genes that one prompt is about."""
    g = listed(texts, group, "center", F.col("text"), "\n" if minimal else "\n\n---\n\n")
    return g.select(*group, F.col("lines").alias("text"))


def suggestion_text(suggestions: DataFrame) -> DataFrame:
    """for_task, text of memory's suggestions (source, edge_types, improvement, rank)."""
    line = F.concat(
        F.lit("### Suggestion "), F.col("rank").cast("string"), F.lit(" (from "), "source", F.lit("):\n- Edge types: "), "edge_types",
        F.lit("\n- Improvement: +"), fixed(F.col("improvement"), 4), F.lit("\n"),
    )
    g = listed(suggestions, ["for_task"], "rank", line)
    return g.select("for_task", F.concat(F.lit("## Suggestions (from previous successful runs):\n\n"), "lines").alias("text"))


def signed(x: Column, places: int) -> Column:
    text = fixed(x, places)
    return F.when(F.startswith(text, F.lit("-")), text).otherwise(F.concat(F.lit("+"), text))


def ablation_text(effects: DataFrame) -> DataFrame:
    """task, text: what each edge type did, best net first; of two samples or more."""
    own = effects.where(F.col("n_added") + F.col("n_removed") >= 2)
    w = Window.partitionBy("task").orderBy(F.desc(F.round("net", 9)), "edge_type")
    number = lambda c: F.col(c).cast("string")
    line = F.concat(
        F.lit("- **"), "edge_type", F.lit("**: added="), signed(F.col("when_added"), 4), F.lit(" (n="), number("n_added"), F.lit("), removed="), signed(F.col("when_removed"), 4),
        F.lit(" (n="), number("n_removed"), F.lit(") -> **"), "class", F.lit("** (net="), signed(F.col("net"), 4), F.lit(")"),
    )
    g = listed(own.withColumn("r", F.row_number().over(w)), ["task"], "r", line)
    return g.select("task", F.concat(F.lit("## EDGE TYPE ABLATION HISTORY (Marginal Contributions)\n"), "lines").alias("text"))


def parameter_text(effects: DataFrame) -> DataFrame:
    """task, text: each parameter's best value if it helped and worst if it hurt."""
    e = effects.withColumn("effect", F.round("effect", 9))
    w = Window.partitionBy("task", "param")
    e = e.withColumn("b", F.row_number().over(w.orderBy(F.desc("effect"), "value"))).withColumn("w", F.row_number().over(w.orderBy("effect", "value")))
    good = F.when((F.col("b") == 1) & (F.col("effect") > 0), F.concat(F.lit("- "), "param", F.lit(": "), "value", F.lit(" worked well (effect: +"), fixed(F.col("effect"), 3), F.lit(")")))
    bad = F.when((F.col("w") == 1) & (F.col("effect") < 0), F.concat(F.lit("- "), "param", F.lit(": avoid "), "value", F.lit(" (effect: "), fixed(F.col("effect"), 3), F.lit(")")))
    rows = e.select("task", F.explode(F.array_compact(F.array(F.when(good.isNotNull(), F.struct(F.concat("param", F.lit("1")).alias("p"), good.alias("t"))), F.when(bad.isNotNull(), F.struct(F.concat("param", F.lit("2")).alias("p"), bad.alias("t")))))).alias("x")).select("task", "x.*")
    g = listed(rows, ["task"], "p", F.col("t"))
    none = effects.select("task").distinct()
    return none.join(g, "task", "left").select("task", F.coalesce(F.concat(F.lit("Based on historical performance:\n"), "lines"), F.lit("No historical guidance available yet.")).alias("text"))


def value_key(value: Column, kind: str) -> Column:
    """A parameter's value as a text: lists sorted, maps by key, in JSON; flags in
    small letters."""
    if kind == "list":
        return F.to_json(F.array_sort(value))
    if kind == "map":
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))))
    return F.lower(value.cast("string")) if kind == "flag" else value.cast("string")


def task_advice(rows: DataFrame) -> DataFrame:
    """task, advice (an array) from (task, auc, f1, accuracy, ari)."""
    family = F.substring_index("task", "_", 1)
    metric = F.lit("f1")
    for t, m in PRIMARY.items():
        metric = F.when(family == t, m).otherwise(metric)
    value = F.coalesce(F.when(metric == "auc", F.col("auc")).when(metric == "accuracy", F.col("accuracy")).otherwise(F.col("f1")), F.lit(0.0))
    say = lambda cond, *texts: F.when(cond, array_of(texts)).otherwise(F.array().cast("array<string>"))
    low = value < 0.7
    parts = [say((family == t) & low, *texts) for t, texts in ADVICE.items()]
    parts += [
        say((family == "ppi") & (F.coalesce("f1", F.lit(0.0)) < F.coalesce("auc", F.lit(0.0)) - 0.1), "Class imbalance detected - consider adjusting negative sampling"),
        say((family == "cell") & (F.coalesce("ari", F.lit(0.0)) < 0.5), "Low clustering agreement - embeddings may lack cell-type specificity"),
        say((family == "geneattribute") & low, "Focus on regulatory network information (TRRUST edges)", "Include GO biological process annotations"),
        say((family == "geneattribute") & F.contains("task", F.lit("dosage")), "Prioritize gene essentiality and constraint information"),
        say((family == "geneattribute") & ~F.contains("task", F.lit("dosage")) & F.regexp_like("task", F.lit("methylation|lys4|bivalent")), "Focus on chromatin state and epigenetic context"),
        say(value < 0.6, *GENERAL_ADVICE),
    ]
    return rows.select("task", F.flatten(F.array(*parts)).alias("advice"))


def quoted(text: Column, key: str) -> Column:
    """The text that a key has in a response, with escaped quotes; empty if none."""
    return F.replace(F.regexp_extract(text, rf'"{key}":\s*"((?:[^"\\]|\\.)*)"', 1), F.lit('\\"'), F.lit('"'))


def scientist_response(text: Column) -> dict[str, Column]:
    """hypothesis and expected_outcome of a response; empty if not given."""
    plain = lambda key: F.regexp_extract(text, rf'"{key}":\s*"([^"]*)"', 1)
    return {"hypothesis": plain("hypothesis"), "expected_outcome": plain("expected_outcome")}


def reasoned_response(text: Column) -> dict[str, Column]:
    """Diagnosis, hypothesis and falsification of a response: from its JSON block
    if that parses, else from the quoted texts after their keys."""
    block = F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1)
    schema = "biological_diagnosis string, hypothesis string, falsification_criteria string"
    parsed = F.from_json(block, schema)
    sound = (block != "") & F.get_json_object(block, "$").isNotNull()
    inner = F.from_json(parsed["hypothesis"], "statement string, biological_basis string, expected_outcome string")
    nested = F.startswith(F.ltrim(parsed["hypothesis"]), F.lit("{"))
    own = lambda c: F.coalesce(parsed[c], F.lit(""))
    part = lambda c, plain: F.when(sound, F.coalesce(F.when(nested, inner[c]).otherwise(plain), F.lit(""))).otherwise(quoted(text, c))
    return {
        "biological_diagnosis": F.when(sound, own("biological_diagnosis")).otherwise(quoted(text, "biological_diagnosis")),
        "statement": part("statement", parsed["hypothesis"]),
        "biological_basis": part("biological_basis", F.lit(None).cast("string")),
        "expected_outcome": part("expected_outcome", F.lit(None).cast("string")),
        "falsification_criteria": F.when(sound, own("falsification_criteria")).otherwise(quoted(text, "falsification_criteria")),
    }


def repaired(responses: DataFrame, parsed: Column, repair) -> DataFrame:
    """responses with ``strategy``: what parses, else what a second response from
    ``repair`` (a column function of the text) parses to, else null.  Only failures
    are asked again.  First responses are written before they are split: a client
    is asked once for each, and a row is on one side."""
    from graphloom.sources.graph_store import written

    first = written(responses.withColumn("strategy", parsed), "responses")
    again = first.where(F.col("strategy").isNull()).withColumn("text", repair(F.col("text"))).withColumn("strategy", parsed)
    return first.where(F.col("strategy").isNotNull()).unionByName(again)


POLICY = "mode string, top_k long, threshold double, exclude_neighbors array<string>, per_edge_type map<string,long>, reason string"


def policy_record(json: Column) -> Column:
    """A selection policy's record from JSON, unknown keys left out; a policy that
    names no mode keeps all."""
    p = F.from_json(json, POLICY)
    return p.withField("mode", F.coalesce(p["mode"], F.lit("retain_all")))


def policy_of_strategy(json: Column) -> Column:
    """The selection policy in a strategy's JSON, where keys have other names."""
    s = F.from_json(json, "neighbor_selection_mode string, top_k long, threshold double, exclude_neighbors array<string>, neighbors_per_type map<string,long>, neighbor_selection_reason string")
    return F.struct(
        F.coalesce(s["neighbor_selection_mode"], F.lit("retain_all")).alias("mode"), s["top_k"].alias("top_k"), s["threshold"].alias("threshold"),
        s["exclude_neighbors"].alias("exclude_neighbors"), s["neighbors_per_type"].alias("per_edge_type"), s["neighbor_selection_reason"].alias("reason"),
    )


def policy_json(policy: Column) -> Column:
    return F.to_json(policy, {"ignoreNullFields": "false"})


def experiment_report(iteration: Column, hypothesis: Column, expected: Column, state: Column, metric: Column, reward: Column, analysis: Column, edge_types: Column, neighbors: Column, sampling: Column) -> Column:
    """An experiment's entry as the text that a model is shown."""
    four = lambda x: F.coalesce(fixed(x, 4), F.lit("N/A"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(edge_types, F.array().cast("array<string>")), lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))
    # The report's labels.
    return F.concat(
        F.lit("## Experiment "), iteration.cast("string"), F.lit("\n**Hypothesis**: "), hypothesis, F.lit("\n**Expected**: "), expected,
        F.lit("\n**Result**: "), F.coalesce(state, F.lit("UNKNOWN")), F.lit(" (metric="), four(metric), F.lit(", reward="), four(reward), F.lit(")\n**Analysis**: "), analysis,
        F.lit("\n**Strategy**: edge_types="), listed, F.lit(", max_neighbors="), F.coalesce(neighbors, F.lit(50)).cast("string"), F.lit(", sampling="), F.coalesce(sampling, F.lit("top_k")),
    )


#: What of a strategy is compared, by its older names.
KEY_FEATURES = ("edge_priorities", "max_neighbors", "subgraph_depth", "prompt_template", "sampling_method")


def key_features(json: Column) -> Column:
    """Those of a strategy's JSON object that are compared, as a map of texts."""
    return F.map_filter(F.from_json(json, "map<string,string>"), lambda k, _: k.isin(*KEY_FEATURES))


def task_context(tasks: DataFrame, contexts: DataFrame, general: str = "") -> DataFrame:
    """task, context: the text that a table (task, context) has for each task, or
    that there is none; with general knowledge after it, if given."""
    rows = tasks.select("task").join(F.broadcast(contexts.select("task", "context")), "task", "left")  # a row for each kind of task
    own = F.coalesce("context", F.lit("No specific biological context available."))
    return rows.select("task", (F.concat(own, F.lit("\n\n" + general)) if general else own).alias("context"))


def primary_value(combined: Column, single: Column) -> Column:
    """A task's metric: of all models together if there is one, else the only one's, else 0."""
    return F.coalesce(combined, single, F.lit(0.0))
