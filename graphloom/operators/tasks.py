"""Prediction tasks: what they join, how they are split, guarded and summarised.

A task's rows are (id, label, x); x is an array of features.  Joins with embeddings
are inner, so rows without a vector are left out, as counts of them show."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import evaluation as E
from graphloom.operators.graph import unit_hash
from graphloom.operators.sampling import numbered
from graphloom.operators.rendering import fixed
from graphloom.operators.scoring import clip, dot

# What an evaluation without usable rows counts as.
EMPTY_CLASSIFICATION = {"accuracy": 0.0, "f1": 0.0, "auc": 0.5, "ap": 0.5}
EMPTY_REGRESSION = {"delta_correlation": 0.0, "mse": float("inf"), "de_correlation": 0.0}
METHODS = ("no_kg", "full_kg", "rule_rag", "true_rag")


@dataclass(frozen=True)
class TaskSpec:
    """What the rest of the engine has to know of a task."""

    name: str
    kind: str  # binary, multiclass or regression
    metric: str
    clustering: bool = False


# The tasks by name.
TASKS = {
    t.name: t
    for t in (
        TaskSpec("ppi", "binary", "auc"), TaskSpec("ggi", "binary", "auc"), TaskSpec("genetype", "multiclass", "f1"), TaskSpec("cell", "multiclass", "f1", True),
        TaskSpec("geneattribute_dosage_sensitivity", "binary", "auc"), TaskSpec("geneattribute_lys4_only", "binary", "auc"),
        TaskSpec("geneattribute_no_methylation", "binary", "auc"), TaskSpec("geneattribute_bivalent", "binary", "auc"), TaskSpec("perturbation", "regression", "delta_correlation"),
    )
}


def registered(spark) -> DataFrame:
    """task, kind, metric, clustering of every task."""
    return spark.createDataFrame([(t.name, t.kind, t.metric, t.clustering) for t in TASKS.values()], "task string, kind string, metric string, clustering boolean")


def keyed(names: DataFrame, ids: DataFrame) -> DataFrame:
    """name, key: an id by the name itself, else by equal letters in any case (the least)."""
    exact = ids.select(F.col("id").alias("name"), F.col("id").alias("a"))
    loose = ids.groupBy(F.upper("id").alias("u")).agg(F.min("id").alias("b"))
    rows = names.select("name").distinct().withColumn("u", F.upper("name"))
    return rows.join(exact, "name", "left").join(loose, "u", "left").select("name", F.coalesce("a", "b").alias("key")).where("key IS NOT NULL")


def pair_features(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """g1, g2, label, x of labelled pairs: the vectors of both genes one after the
    other, in the order of the symbols as given."""
    ids = embeddings.select("id")
    names = pairs.select(F.col("g1").alias("name")).union(pairs.select("g2"))
    keys = keyed(names, ids).join(embeddings.select(F.col("id").alias("key"), "emb"), "key").select("name", "emb")
    end = lambda c, v: keys.select(F.col("name").alias(c), F.col("emb").alias(v))
    both = pairs.join(end("g1", "_a"), "g1").join(end("g2", "_b"), "g2")
    x = F.when(F.col("g1") <= F.col("g2"), F.concat("_a", "_b")).otherwise(F.concat("_b", "_a"))
    return both.select("g1", "g2", "label", x.alias("x"))


def typed_features(genes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """id, label, x of (ensembl, name, label): the vector of the identifier, else
    of the name."""
    v = embeddings.select("id", "emb")
    rows = genes.join(v.select(F.col("id").alias("ensembl"), F.col("emb").alias("_a")), "ensembl", "left")
    keys = keyed(rows.where("_a IS NULL").select("name"), v).join(v.withColumnRenamed("id", "key"), "key").select("name", F.col("emb").alias("_b"))
    return rows.join(keys, "name", "left").select(F.col("ensembl").alias("id"), "label", F.coalesce("_a", "_b").alias("x")).where("x IS NOT NULL")


def attribute_features(positive: DataFrame, negative: DataFrame, embeddings: DataFrame, cache: DataFrame) -> DataFrame:
    """id, label, x of two sets of genes (gene): identifiers are looked up by the
    cache (ensembl, node_id), negatives by their own id first."""
    v = embeddings.select("id", "emb")
    known = cache.where("ensembl IS NOT NULL").groupBy("ensembl").agg(F.min("node_id").alias("key"))
    by_cache = lambda rows: rows.join(known, F.col("gene") == F.col("ensembl")).join(v.withColumnRenamed("id", "key"), "key").select("gene", "emb")
    direct = lambda rows: rows.join(v.withColumnRenamed("id", "gene"), "gene").select("gene", "emb")
    up = direct(positive).unionByName(by_cache(positive)).dropDuplicates(["gene"]).withColumn("label", F.lit(1))
    own = direct(negative)
    rest = by_cache(negative.join(own.select("gene"), "gene", "left_anti")).dropDuplicates(["gene"])
    down = own.unionByName(rest).withColumn("label", F.lit(0))
    return up.unionByName(down).select(F.col("gene").alias("id"), "label", F.col("emb").alias("x"))


def condition_features(delta: DataFrame, embeddings: DataFrame) -> DataFrame:
    """cond, x, y of (cond, gene, delta): a condition's vector and its changes by
    gene in the genes' order; none if no condition has a vector."""
    y = delta.groupBy("cond").agg(F.transform(F.array_sort(F.collect_list(F.struct("gene", "delta"))), lambda p: p["delta"]).alias("y"))
    keys = keyed(y.select(F.col("cond").alias("name")), embeddings.select("id"))
    v = keys.join(embeddings.select(F.col("id").alias("key"), F.col("emb").alias("x")), "key")
    return y.join(v, F.col("cond") == F.col("name")).select("cond", "x", "y")


def condition_means(cells: DataFrame, least: int = 1) -> DataFrame:
    """cond, gene, m: mean expression in each condition with ``least`` cells or more.

    cells: cond, gene, cell, v (one row for each cell and gene)."""
    means = cells.groupBy("cond", "gene").agg(F.avg("v").alias("m"))
    if least <= 1:
        return means
    # distinct cells are counted in two steps, so a condition's cells don't meet
    enough = cells.select("cond", "cell").distinct().groupBy("cond").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    return means.join(enough, "cond", "left_semi")


def pseudo_bulk(cells: DataFrame, controls: DataFrame, least: int = 3) -> DataFrame:
    """cond, gene, delta: what each condition's mean differs by from the control's,
    for conditions with ``least`` cells; a gene that the control lacks counts as 0 there.

    controls: cond, the conditions that are no perturbation; their mean is that of
    all their cells together."""
    named = F.broadcast(controls.select("cond").distinct())  # few names
    base = cells.join(named, "cond", "left_semi").groupBy("gene").agg(F.avg("v").alias("base"))
    other = condition_means(cells.join(named, "cond", "left_anti"), least)
    return other.join(base, "gene", "left").select("cond", "gene", (F.col("m") - F.coalesce("base", F.lit(0.0))).alias("delta"))


def perturbation_info(delta: DataFrame) -> DataFrame:
    """One row: how many conditions there are, and how many genes an answer has."""
    return delta.agg(F.countDistinct("cond").alias("num_conditions"), F.countDistinct("gene").alias("output_dim"))


def pair_genes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("g1").alias("gene")).union(pairs.select("g2")).distinct()


def labelled_genes(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Symbols of labelled identifiers (gene) that the cache knows."""
    return rows.select(F.col("gene").alias("ensembl")).distinct().join(cache.where("ensembl IS NOT NULL"), "ensembl").select(F.col("node_id").alias("gene")).distinct()


def splits(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several splits with their names."""
    out = None
    for name, rows in parts.items():
        own = rows.withColumn("split", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def train_test(rows: DataFrame, key: str, label: str | None = None, share: float = 0.2, seed: str = "42") -> DataFrame:
    """rows with ``test``: a share of each class by a seeded hash order, rounded up
    to whole rows; where a class has one row only, of all rows together."""
    unit = unit_hash(F.lit(seed), F.col(key).cast("string"))
    by = [label] if label is not None else []
    if by:  # classes are few: one look at their sizes decides for all
        least = rows.groupBy(label).agg(F.count("*").alias("c")).agg(F.min("c")).first()[0]
        by = by if least is None or least > 1 else []
    r = numbered(rows, by, unit, [F.col(key)])
    return r.withColumn("test", F.col("_r") <= F.ceil(F.col("_n") * share)).drop("_r", "_n")


def usable(rows: DataFrame, x: str = "x") -> DataFrame:
    """One row: how many rows there are, and whether all features are finite."""
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.coalesce(sound, F.lit(False))), F.lit(False)).alias("finite"))


def guarded(metrics: DataFrame, state: DataFrame, empty: dict[str, float]) -> DataFrame:
    """Metrics (one row), or neutral ones where there were no rows or bad values."""
    ok = (F.col("n") > 0) & F.col("finite")
    both = state.join(metrics, F.lit(True), "left")  # one row each
    return both.select(*[F.when(ok, F.col(c) if c in metrics.columns else F.lit(None).cast("double")).otherwise(F.lit(v)).alias(c) for c, v in empty.items()])


def guarded_by(metrics: DataFrame, state: DataFrame, by: list[str], empty: dict[str, float]) -> DataFrame:
    """``guarded`` for many groups at once: state has n and finite of each."""
    ok = (F.col("n") > 0) & F.col("finite")
    both = state.join(metrics, by, "left")
    return both.select(*by, *[F.when(ok, F.col(c) if c in metrics.columns else F.lit(None).cast("double")).otherwise(F.lit(v)).alias(c) for c, v in empty.items()])


def fold_means(folds: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    return folds.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics], *[F.stddev_pop(m).alias(f"{m}_std") for m in metrics])


def combined(by_model: DataFrame, metrics: list[str], name: str = "combined") -> DataFrame:
    """Rows of several models with one of their means; what only one model has is
    taken from it."""
    mean = by_model.agg(*[F.avg(m).alias(m) for m in metrics]).select(F.lit(name).alias("model"), *metrics)
    return by_model.select("model", *metrics).unionByName(mean)


def row_correlation(pairs: DataFrame, row: str) -> DataFrame:
    """row, corr of (row, place, truth, predicted); 0 where there is none."""
    return E.regression(pairs, row).select(row, "corr")


def sampled_negatives(available: DataFrame, positives: DataFrame, ratio: float = 1.0, seed: str = "42") -> DataFrame:
    """id: a seeded sample of what is no positive, ``ratio`` times their number."""
    n = positives.select("id").distinct().join(available.select("id").distinct(), "id", "left_semi").agg(F.floor(F.count("*") * ratio).alias("_n"))
    rest = available.select("id").distinct().join(positives.select("id"), "id", "left_anti")
    r = numbered(rest, [], unit_hash(F.lit(seed), F.col("id")), ["id"]).drop("_n")
    return r.crossJoin(F.broadcast(n)).where("_r <= _n").select("id")  # one row


def pooled_cells(expression: DataFrame, embeddings: DataFrame, how: str = "weighted", least: int = 10, top: int = 500) -> DataFrame:
    """cell, dim, p: a cell's vector from those of its expressed genes (cell, id,
    expr), of the ``top`` most expressed; cells with fewer than ``least`` such genes
    have none.  how: mean, weighted (by expression) or max."""
    w = Window.partitionBy("cell")
    x = expression.where("expr > 0").join(embeddings.select("id", "emb"), "id")
    x = x.withColumn("r", F.row_number().over(w.orderBy(F.desc("expr"), "id"))).withColumn("n", F.count("*").over(w)).where((F.col("r") <= top) & (F.col("n") >= least))
    long = x.select("cell", "expr", F.posexplode("emb").alias("dim", "v")).groupBy("cell", "dim")
    value = {"mean": F.avg("v"), "max": F.max("v"), "weighted": F.sum(F.col("v") * F.col("expr")) / F.sum("expr")}
    return long.agg(value[how].alias("p"))


def normalised_metric(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """A metric between its bounds, mapped to -1 to 1."""
    return clip((x - low) / (high - low) * 2 - 1, -1.0, 1.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one has no length."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    length = na * nb
    return F.when(length > 0, dot(a, b) / F.when(length > 0, length).otherwise(1.0)).otherwise(0.0)


def baseline_text(gene: Column, summary: Column) -> Column:
    """What stands for a gene without a description."""
    return F.coalesce(F.nullif(F.trim(summary), F.lit("")), F.concat(gene, F.lit(" is a human gene.")))


def clustering_text(m: dict[str, Column]) -> Column:
    """The lines of clustering metrics by name."""
    # The labels.
    line = lambda label, c, places=4: F.concat(F.lit(f"    - {label}: "), fixed(m[c], places))
    return F.concat_ws(
        "\n", F.lit("Clustering Metrics:"), F.lit("  External (vs true labels):"), line("Adjusted Rand Index", "ari"), line("Normalized Mutual Info", "nmi"), line("V-measure", "v_measure"),
        F.lit("  Internal (cluster quality):"), line("Silhouette Score", "silhouette"), line("Calinski-Harabasz", "calinski_harabasz", 2), line("Davies-Bouldin", "davies_bouldin"),
    )


def regression_text(m: dict[str, Column]) -> Column:
    """The lines of regression metrics by name."""
    # The labels.
    line = lambda label, c, places: F.concat(F.lit(f"  - {label}: "), fixed(m[c], places))
    std = F.concat(F.lit("    (std: "), fixed(m["delta_correlation_std"], 4), F.lit(")"))
    return F.concat_ws(
        "\n", F.lit("Regression Metrics (Perturbation):"), line("Delta Correlation", "delta_correlation", 4), F.when(m["delta_correlation_std"].isNotNull(), std), line("MSE", "mse", 6),
        line("RMSE", "rmse", 6), line("DE Correlation (top50)", "de_correlation", 4), line("DE MSE (top50)", "de_mse", 6),
    )


def embedding_text(stats: DataFrame) -> DataFrame:
    """text of (n, mean_norm, std_norm, mean_var)."""
    line = lambda label, value: F.concat(F.lit(f"  - {label}: "), value)
    return stats.select(F.concat_ws(
        "\n", line("Number of embeddings", F.col("n").cast("string")), line("Mean embedding norm", fixed(F.col("mean_norm"), 4)),
        line("Std embedding norm", fixed(F.col("std_norm"), 4)), line("Mean dimension variance", fixed(F.col("mean_var"), 6)),
    ).alias("text"))


def compared(results: DataFrame, base: str = "no_kg") -> DataFrame:
    """method, metric, gain over the base method, place (best first)."""
    own = results.where(F.col("method") == base).agg(F.max("metric").alias("_b"))
    w = Window.orderBy(F.desc("metric"), "method")  # a row for each method
    return results.crossJoin(own).select("method", "metric", (F.col("metric") - F.col("_b")).alias("gain"), F.row_number().over(w).cast("long").alias("place"))


def mlp_regression(points: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """id, predicted: a network with one hidden layer, fitted on all points (id, x,
    y) by ``network.fit`` and applied to queries (id, x) where they lie."""
    from graphloom.operators import network

    return network.predict(network.fit(points, **options), queries)


def forest_regression(points: DataFrame, queries: DataFrame, trees: int = 100, seed: int = 42, depth: int = 30) -> DataFrame:
    """The same by a random forest, a third of the features at a node: grown on executors
    (``operators.forest``), or where a task can't hold the rows' bins by Spark's own, where rows keep the
    node they have reached in each tree, so no level ships the trees so far."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    from graphloom.operators import forest as own

    forest = RandomForestRegressor(featuresCol="_v", labelCol="y", predictionCol="predicted", numTrees=trees, seed=seed, maxDepth=depth, cacheNodeIds=True)
    both = points.where("y IS NOT NULL").select("id", F.lit(-1).alias("fold"), F.col("y").cast("double").alias("y"), F.lit(1.0).alias("weight"), "x").unionByName(queries.select("id", F.lit(0).alias("fold"), F.lit(0.0).alias("y"), F.lit(1.0).alias("weight"), "x"))
    if own.fits(both, "x"):
        third = lambda width: math.ceil(width / 3)
        return own.held_out(both, [0], forest.getNumTrees(), forest.getMaxDepth(), forest.getSeed(), third).select("id", "predicted")
    model = forest.fit(points.withColumn("_v", array_to_vector("x")))
    return model.transform(queries.withColumn("_v", array_to_vector("x"))).select("id", "predicted")


def ridge_regression(points: DataFrame, queries: DataFrame, alpha: float = 1.0) -> DataFrame:
    """The same by a ridge regression; one expression over an array of weights, so
    the plan has one size for any width."""
    w, b = E.ridge(points, "x", "y", alpha)
    products = F.zip_with("x", F.array(*[F.lit(float(c)) for c in w]) if len(w) else F.array().cast("array<double>"), lambda x, c: x * c)
    return queries.select("id", (F.aggregate(products, F.lit(0.0), lambda a, x: a + x) + float(b)).alias("predicted"))


#: Regressors by name; ``knn`` is ``evaluation.knn_regression``.
REGRESSORS = {"ridge": ridge_regression, "mlp": mlp_regression, "forest": forest_regression}
CLASSIFIERS = ("logistic", "forest")


def regressor(name: str):
    if name not in REGRESSORS:
        raise ValueError(f"no regressor {name!r}; there are {sorted(REGRESSORS)}")
    return REGRESSORS[name]


def classifier_metrics(points: DataFrame, name: str, k: int = 5) -> DataFrame:
    """fold, auc, ap of one classifier by name."""
    if name not in CLASSIFIERS:
        raise ValueError(f"no classifier {name!r}; there are {sorted(CLASSIFIERS)}")
    return E.cross_validated(points, k).where(F.col("model") == name).drop("model")
