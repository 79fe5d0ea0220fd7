"""Analytics of experiment histories as window plans.

A history has task, iteration, metric and strategy columns.  Every operator is
a window over ``task`` ordered by ``iteration``, so tasks run side by side;
recursions are written in closed form (moving averages, backward sums) or as
islands (plateaus), never as loops on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the reward and trend formulas.
W_RELATIVE, W_RAW, W_BASELINE = 0.10, 0.80, 0.10
PLATEAU_SHARE, PLATEAU_BASE, PLATEAU_STEP, PLATEAU_MOST = 0.01, -0.05, 0.3, -0.3
FLAT, STEEP = 0.005, 0.01
EMA_KEEP = 0.7
# What an edge type weighs before anything is learned.
PRIORS = {"PPI": 0.7, "GO": 0.6, "HPO": 0.7, "TRRUST": 0.5, "CellMarker": 0.4, "Reactome": 0.5}
TREND_VALUES = {"improving": 0.85, "plateau": 0.15, "declining": 0.05, "oscillating": 0.20, "unknown": 0.40}


def by(order: str = "iteration"):
    return Window.partitionBy("task").orderBy(order)


def last(n: int):
    return by().rowsBetween(-(n - 1), 0)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def variance(values: Column) -> Column:
    """Population variance of an array, value after value by Welford's update with the
    new mean.  Spark's var_pop rounds that update otherwise, and thresholds and printed
    digits show the last bit, so the order of steps is fixed here."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("d"))

    def step(a: Column, x: Column) -> Column:
        mean = a["mean"] + (x - a["mean"]) / (a["n"] + 1.0)
        return F.struct((a["n"] + 1.0).alias("n"), mean.alias("mean"), (a["d"] + (x - mean) * (x - a["mean"])).alias("d"))

    return F.aggregate(values, start, step, lambda a: F.when(a["n"] > 0, a["d"] / F.greatest(a["n"], F.lit(1.0))))


def absolute_reward(metric: Column) -> Column:
    linear = metric * 2 - 1
    return F.when(metric > 0.8, F.least(F.lit(1.0), linear + (metric - 0.8) * (metric - 0.8) * 5)).otherwise(clip(linear, -1.0, 1.0))


def with_best(history: DataFrame) -> DataFrame:
    """n (0-based), previous, best_before, improved."""
    earlier = by().rowsBetween(Window.unboundedPreceding, -1)
    out = history.withColumn("n", F.row_number().over(by()) - 1).withColumn("previous", F.lag("metric").over(by())).withColumn("best_before", F.max("metric").over(earlier))
    return out.withColumn("improved", F.col("best_before").isNull() | (F.col("metric") > F.col("best_before")))


def gated_rewards(history: DataFrame) -> DataFrame:
    """Reward of each iteration: full where it beats the best so far, else a
    penalty; with the plateau's duration, an island of small steps."""
    h = with_best(history)
    three = by().rowsBetween(-3, -1)  # the last three before this one
    delta, threshold = F.col("metric") - F.col("previous"), F.greatest(F.col("previous"), F.lit(0.01)) * PLATEAU_SHARE
    small = (F.col("n") >= 2) & (F.abs(delta) < threshold)
    h = h.withColumn("std", F.sqrt(variance(F.collect_list("metric").over(three)))).withColumn("delta", delta).withColumn("thr", threshold)
    h = h.withColumn("inc", F.when(small & (F.col("std") < F.col("thr") * 1.5), 1).otherwise(0))
    reset = F.when(F.col("n") == 0, 1).when(small, 1 - F.col("inc")).when(F.col("improved"), 1).otherwise(0)
    h = h.withColumn("island", F.sum(reset).over(by().rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("task", "island").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("plateau_duration", F.sum("inc").over(run).cast("long"))
    plateau = F.when(F.col("inc") == 1, F.greatest(F.lit(PLATEAU_MOST), (F.col("plateau_duration") * PLATEAU_STEP + 1) * PLATEAU_BASE)).otherwise(0.0)
    absolute = absolute_reward(F.col("metric"))
    gap = F.col("best_before") - F.col("metric")
    penalty = F.when(F.col("improved"), 0.0).otherwise(clip(F.lit(-0.3) - gap * 2.0, -0.6, 0.0))
    gated = F.when(F.col("improved"), absolute).otherwise(absolute * 0.1)
    total = clip(delta, -1.0, 1.0) * W_RELATIVE + gated * W_RAW + clip(F.col("metric") - F.col("best_before"), -1.0, 1.0) * W_BASELINE + plateau + penalty
    total = F.when(F.col("improved"), total).otherwise(F.least(total, F.lit(-0.2)))
    total = F.when(F.col("n") == 0, absolute * W_RAW).otherwise(total)
    return h.select("task", "iteration", "metric", "improved", "plateau_duration", gated.alias("absolute"), clip(total, -1.0, 1.0).alias("reward"))


def discounted_return(rewards: DataFrame, gamma: float = 0.99) -> DataFrame:
    n = F.row_number().over(by()) - 1
    return rewards.withColumn("g", F.pow(F.lit(gamma), n) * F.col("reward")).groupBy("task").agg(F.sum("g").alias("discounted_return"), F.count("*").alias("n"))


def reward_signals(history: DataFrame, distance: Column, utility: float = 0.05, cost: float = 0.15, stagnant: float = 0.2) -> DataFrame:
    """State, exploration cost, context penalty and signal against the best so
    far.  Needs max_neighbors."""
    h = with_best(history).withColumn("distance", distance).withColumn("before", F.lag("max_neighbors").over(by()))
    best = F.coalesce("best_before", "metric")
    delta = F.col("metric") - best
    state = F.when(delta > 0, "breakthrough").when(F.col("distance") < stagnant, "stagnation").otherwise("exploration_failure")
    own = F.when(delta > 0, 0.0).when(F.col("distance") < stagnant, (1 - F.col("distance")) * cost).otherwise((1 - F.col("distance")) * cost * 0.5)
    growth = (F.col("max_neighbors") - F.col("before")) / F.col("before")
    context = F.when((F.col("before") > 0) & (growth > 0.2) & (delta <= 0.005), F.least(growth * 0.1, F.lit(0.15))).otherwise(0.0)
    gain = F.tanh(delta / utility)
    total = clip(F.when(delta > 0, gain).otherwise(gain - own - context), -1.0, 1.0)
    return h.select("task", "iteration", state.alias("state"), gain.alias("utility"), own.alias("exploration_cost"), context.alias("context_penalty"), total.alias("signal"))


def trends(history: DataFrame) -> DataFrame:
    """Direction, strength, duration, convergence and action from windows of
    three metrics; unknown before there are three."""
    h = history.withColumn("n", F.row_number().over(by()))
    w = last(3)
    # least squares over places 0, 1, 2 of a window
    slope = (F.col("metric") - F.lag("metric", 2).over(by())) / 2.0
    h = h.withColumn("slope", slope).withColumn("var", variance(F.collect_list("metric").over(w))).withColumn("top", F.max("metric").over(w))
    enough = F.col("n") >= 3
    direction = F.when(~enough, "unknown").when(F.col("var") < FLAT, "plateau").when(F.col("slope") > STEEP, "improving").when(F.col("slope") < -STEEP, "declining").otherwise("plateau")
    strength = F.when(~enough, 0.0).when(F.col("var") < FLAT, 1 - F.col("var") / FLAT).when(F.abs("slope") > STEEP, F.least(F.lit(1.0), F.abs("slope") / (STEEP * 5))).otherwise(0.5)
    h = h.withColumn("direction", direction).withColumn("strength", strength)
    turn = F.when(F.lag("direction").over(by()).eqNullSafe(F.col("direction")), 0).otherwise(1)
    h = h.withColumn("turn", turn).withColumn("island", F.sum("turn").over(by().rowsBetween(Window.unboundedPreceding, 0)))
    duration = F.when(enough, F.row_number().over(Window.partitionBy("task", "island").orderBy("iteration"))).otherwise(0).cast("long")
    flat = F.greatest(F.lit(0.0), 1 - F.col("var") / (FLAT * 10))
    level = F.greatest(F.lit(0.0), 1 - F.abs("slope") / STEEP)
    h = h.withColumn("duration", duration).withColumn("convergence", F.when(enough, flat * 0.4 + level * 0.3 + F.col("top") * 0.3).otherwise(0.0))
    c, d, s = F.col("convergence"), F.col("direction"), F.col("strength")
    action = F.when(~enough, "explore").when(c > 0.8, "exploit").when((d == "improving") & (s > 0.7), "exploit").when(d == "declining", "explore").when((d == "plateau") & (s > 0.6), "explore").when(d == "oscillating", "explore").when(c > 0.5, "exploit").otherwise("explore")
    return h.select("task", "iteration", "metric", "direction", "strength", "duration", "convergence", action.alias("action"))


def improvement_rate(history: DataFrame, n: int = 5) -> DataFrame:
    """Slope of a least-squares line through the last n metrics."""
    h = history.withColumn("i", F.row_number().over(by()).cast("double"))
    rate = F.when(F.count("*").over(last(n)) >= 2, F.regr_slope("metric", "i").over(last(n)))
    return h.select("task", "iteration", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def state_updates(history: DataFrame, eps: float = 1e-10) -> DataFrame:
    """Best metric so far and the iteration that set it first."""
    h = with_best(history)
    rises = F.when(F.col("best_before").isNull() | (F.col("metric") > F.col("best_before") + eps), F.col("iteration"))
    upto = by().rowsBetween(Window.unboundedPreceding, 0)
    return h.select("task", "iteration", F.max("metric").over(upto).alias("best_metric"), F.max(rises).over(upto).alias("best_iteration"))


def effectiveness(history: DataFrame, k: int = 3) -> DataFrame:
    """The k best and worst steps of a task, credited to the strategy before."""
    h = history.withColumn("next", F.lead("metric").over(by())).where(F.col("next").isNotNull()).withColumn("improvement", F.col("next") - F.col("metric"))
    up = F.row_number().over(Window.partitionBy("task").orderBy(F.desc("improvement"), "iteration"))
    down = F.row_number().over(Window.partitionBy("task").orderBy(F.asc("improvement"), F.desc("iteration")))
    h = h.withColumn("up", up).withColumn("down", down)
    good = h.where((F.col("up") <= k) & (F.col("improvement") > 0)).select("task", "iteration", F.lit("effective").alias("kind"), F.col("up").cast("long").alias("rank"), "improvement")
    bad = h.where((F.col("down") <= k) & (F.col("improvement") < 0)).select("task", "iteration", F.lit("ineffective").alias("kind"), F.col("down").cast("long").alias("rank"), "improvement")
    return good.unionByName(bad)


def ema(rows: DataFrame, keys: list[str], order: str, value: str, keep: float = EMA_KEEP) -> DataFrame:
    """Usage, successes, sum and moving average of a value by keys.

    e_1 = v_1, e_n = keep e_(n-1) + (1 - keep) v_n, as one weighted sum."""
    w = Window.partitionBy(*keys)
    r = rows.withColumn("_i", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    weight = F.pow(F.lit(keep), F.col("_n") - F.col("_i")) * F.when(F.col("_i") == 1, 1.0).otherwise(1 - keep)
    return r.groupBy(*keys).agg(F.count("*").alias("usage"), F.count_if(F.col(value) > 0).alias("successes"), F.sum(value).alias("total"), F.sum(weight * F.col(value)).alias("ema"))


def improvements(history: DataFrame) -> DataFrame:
    """history with delta to the iteration before (first ones left out)."""
    return history.withColumn("delta", F.col("metric") - F.lag("metric").over(by())).where(F.col("delta").isNotNull())


def edge_weights(effects: DataFrame, least_samples: int = 2, priors: dict[str, float] | None = None) -> DataFrame:
    """Weight of each edge type of a task from its record and its prior (0.5 if
    it has none), spread over [0.05, 1] within the task (0.5 if all are equal)."""
    prior = F.lit(0.5)
    for t, w in (PRIORS if priors is None else priors).items():
        prior = F.when(F.col("edge_type") == t, w).otherwise(prior)
    learned = F.col("successes") / F.col("usage") * 0.6 + clip((F.col("ema") + 0.1) / 0.2, 0.0, 1.0) * 0.4
    raw = F.when(F.col("usage") < least_samples, prior).otherwise(prior * 0.5 + learned * 0.5)
    w = Window.partitionBy("task")
    e = effects.withColumn("raw", raw).withColumn("low", F.min("raw").over(w)).withColumn("high", F.max("raw").over(w))
    spread = F.when(F.col("high") > F.col("low"), F.round(F.pow((F.col("raw") - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0), F.lit(0.7)) * 0.95 + 0.05, 3)).otherwise(0.5)
    return e.select("task", "edge_type", "raw", spread.alias("weight"))


def neighbor_suggestion(successes: Column, usage: Column, average: Column) -> Column:
    """How much a neighbour deserves to stay, from its record when left out."""
    return clip(1 - successes / usage + clip(average * -5.0, -0.3, 0.3), 0.0, 1.0)


def ucb(history: DataFrame, keys: list[str], reward: str, c: float = 1.414) -> DataFrame:
    """Upper confidence bound of each strategy key, against all visits."""
    per = history.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(reward).alias("mean"))
    total = F.sum("n").over(Window.partitionBy(*[k for k in keys if k == "task"]))
    return per.withColumn("ucb", F.col("mean") + F.sqrt(F.log(F.greatest(total, F.lit(2)).cast("double")) / F.col("n")) * c)


def epsilon(direction: Column, convergence: Column, iteration: Column, start: float = 0.2, decay: float = 0.3, floor: float = 0.05, plateau: float = 0.05, decline: float = 0.1) -> Column:
    base = F.greatest(F.lit(floor), F.lit(start) / (iteration * decay + 1.0))
    up = F.when(direction == "plateau", plateau).when(direction == "declining", decline).when(direction == "oscillating", plateau * 0.5).otherwise(0.0)
    raised = F.least(F.lit(1.0), base + up)
    return F.when((direction == "improving") & (convergence > 0.7), F.greatest(F.lit(floor), base - convergence * 0.2)).otherwise(raised)


def strategy_key(edge_types: Column, hops: Column, neighbors: Column, sampling: Column, bucket: int = 25) -> Column:
    return F.concat(F.lit("e:"), F.array_join(F.array_sort(edge_types), "-"), F.lit(":h:"), hops.cast("string"), F.lit(":n:"), (F.floor(neighbors / bucket) * bucket).cast("string"), F.lit(":s:"), sampling)


def critic_values(history: DataFrame, direction: DataFrame) -> DataFrame:
    """Value of each state: trend, best metric, consistency and progress,
    smoothed by 0.3 of the value before (closed form of the recursion).

    direction: task, iteration, direction."""
    h = history.join(direction.select("task", "iteration", "direction"), ["task", "iteration"])
    decline = (F.col("metric") <= F.lag("metric", 1).over(by())) & (F.lag("metric", 1).over(by()) <= F.lag("metric", 2).over(by()))
    trend = F.when(F.coalesce(decline, F.lit(False)), "declining").otherwise(F.col("direction"))
    h = h.withColumn("trend", trend).withColumn("best", F.max("metric").over(by().rowsBetween(Window.unboundedPreceding, 0)))
    mean, std, n = F.avg("metric").over(last(5)), F.sqrt(variance(F.collect_list("metric").over(last(5)))), F.row_number().over(by())
    h = h.withColumn("mean", mean).withColumn("std", std).withColumn("n", n)
    consistency = F.when((F.col("n") >= 3) & (F.col("mean") > 1e-8), 1 - F.least(F.lit(1.0), F.col("std") / F.greatest("mean", F.lit(1e-8)) * 2)).otherwise(0.5)
    value = F.lit(TREND_VALUES["unknown"])
    for k, v in TREND_VALUES.items():
        value = F.when(F.col("trend") == k, v).otherwise(value)
    raw = clip((value * 0.35 + clip(F.col("best"), 0.0, 1.0) * 0.30 + consistency * 0.20 + clip(F.col("metric"), 0.0, 1.0) * 0.15) * 2 - 1, -1.0, 1.0)
    # v_1 = r_1, v_n = 0.7 r_n + 0.3 v_(n-1): the sum is folded in order, since
    # weights of 0.3 ** k written as quotients would run out of range
    # of 40 entries, since 0.3 ** 40 is less than a double holds beside one
    past = F.collect_list("raw").over(by().rowsBetween(-39, 0))
    fold = F.aggregate(past, F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x).otherwise(x * 0.7 + a * 0.3))
    return h.withColumn("raw", raw).select("task", "iteration", "metric", consistency.alias("consistency"), fold.alias("value"))


def gae(rows: DataFrame, gamma: float = 0.99, lam: float = 0.95) -> DataFrame:
    """Temporal differences and generalised advantages of (task, iteration,
    reward, value), to the end of the task; terms beyond ``reach`` steps (601 by
    default) weigh under 1e-16, less than a double holds."""
    decay = gamma * lam
    reach = Window.unboundedFollowing if decay >= 1 else math.ceil(math.log(1e-16) / math.log(decay)) if decay > 0 else 0
    nxt = F.coalesce(F.lead("value").over(by()), F.lit(0.0))
    r = rows.withColumn("td", F.col("reward") + nxt * gamma - F.col("value"))
    ahead = F.collect_list("td").over(by().rowsBetween(0, reach))
    return r.select("task", "iteration", "td", F.aggregate(F.reverse(ahead), F.lit(0.0), lambda a, x: x + a * decay).alias("advantage"))


def strategy_distance(history: DataFrame) -> DataFrame:
    """Distance of each strategy to the one before (1 for the first): edge_types
    array, max_neighbors, max_hops, sampling."""
    before = lambda c: F.lag(c).over(by())
    h = history.withColumn("pe", before("edge_types")).withColumn("pn", before("max_neighbors")).withColumn("ph", before("max_hops")).withColumn("ps", before("sampling"))
    union = F.size(F.array_union("edge_types", "pe"))
    jaccard = F.when(union > 0, 1 - F.size(F.array_intersect("edge_types", "pe")) / F.greatest(union, F.lit(1))).otherwise(0.0)
    place = lambda c: F.when(F.col(c) == "top_k", 0).when(F.col(c) == "random", 1).when(F.col(c) == "weighted", 2).otherwise(0)
    d = jaccard * 0.30 + F.least(F.abs(F.col("max_neighbors") - F.col("pn")) / 190.0, F.lit(1.0)) * 0.20 + F.abs(F.col("max_hops") - F.col("ph")) / 2.0 * 0.15 + F.abs(place("sampling") - place("ps")) / 2.0 * 0.15
    return h.select("task", "iteration", F.when(F.col("pn").isNull(), 1.0).otherwise(clip(d, 0.0, 1.0)).alias("distance"))


def ablation(history: DataFrame) -> DataFrame:
    """Effects of adding and removing edge types: for each task and type the
    moving averages of the metric's step, counts, net and class."""
    h = history.withColumn("pe", F.lag("edge_types").over(by())).withColumn("delta", F.col("metric") - F.lag("metric").over(by())).where(F.col("pe").isNotNull())
    change = lambda a, b, kind: h.select("task", "iteration", "delta", F.explode(F.array_except(a, b)).alias("edge_type"), F.lit(kind).alias("kind"))
    moved = change("edge_types", "pe", "added").unionByName(change("pe", "edge_types", "removed"))
    e = ema(moved, ["task", "edge_type", "kind"], "iteration", "delta")
    pick = lambda kind, c: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    out = e.groupBy("task", "edge_type").agg(pick("added", "usage").alias("n_added"), pick("removed", "usage").alias("n_removed"), pick("added", "ema").cast("double").alias("when_added"), pick("removed", "ema").cast("double").alias("when_removed"))
    a, r = F.col("when_added"), F.col("when_removed")
    kind = F.when((a > 0.01) & (r < 0), "BENEFICIAL").when((a < -0.01) & (r > 0), "LIKELY NOISE").when(a < -0.01, "POSSIBLY NOISE").when((a > 0.01) & (r > 0), "UNCERTAIN").when((F.abs(a) < 0.005) & (F.abs(r) < 0.005), "NEUTRAL").otherwise("UNCERTAIN")
    return out.withColumn("net", a - r).withColumn("class", kind)


def parameter_effects(history: DataFrame, params: list[str], keep: float = 0.8) -> DataFrame:
    """param, value, n, effect: moving average of the metric's step by value."""
    h = improvements(history)
    kinds = F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("string").alias("value")) for p in params]))
    long = h.select("task", "iteration", "delta", kinds.alias("p")).select("task", "iteration", "delta", "p.*")
    return ema(long, ["task", "param", "value"], "iteration", "delta", keep).select("task", "param", "value", F.col("usage").alias("n"), F.col("ema").alias("effect"))


def unexplored(effects: DataFrame, values: dict[str, list[str]], least: int = 2) -> DataFrame:
    """task, param, value, n: of the given values those that a task has tried
    fewer than ``least`` times."""
    every = F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.lit(v).alias("value")) for p, own in values.items() for v in own]))
    grid = effects.select("task").distinct().select("task", every.alias("p")).select("task", "p.*")
    tried = grid.join(effects.select("task", "param", "value", "n"), ["task", "param", "value"], "left")
    return tried.select("task", "param", "value", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)


def parameter_stats(history: DataFrame, params: list[str]) -> DataFrame:
    kinds = F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("string").alias("value")) for p in params]))
    long = history.select("metric", kinds.alias("p")).select("metric", "p.*")
    return long.groupBy("param", "value").agg(F.count("*").alias("n"), F.avg("metric").alias("avg_metric"), F.max("metric").alias("best_metric"), F.min("metric").alias("worst_metric"))


def prune_mode(history: DataFrame) -> DataFrame:
    """Whether the last three iterations grew the context by over 20 % while the
    metric rose by 2 % at most."""
    n = F.row_number().over(by())
    first_n, first_m, top = F.lag("max_neighbors", 2).over(by()), F.lag("metric", 2).over(by()), F.max("metric").over(last(3))
    grew = F.col("max_neighbors") > first_n * 1.2
    return history.select("task", "iteration", ((n >= 3) & F.coalesce(grew & (top <= first_m * 1.02), F.lit(False))).alias("prune"))


def rollbacks(history: DataFrame, declines: int = 3, by_more: float = 0.01) -> DataFrame:
    """Consecutive declines of over 0.01; every third one rolls back, and the
    count begins anew."""
    fall = F.when(F.col("metric") < F.lag("metric").over(by()) - by_more, 1).otherwise(0)
    h = history.withColumn("fall", fall).withColumn("island", F.sum(1 - F.col("fall")).over(by().rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum("fall").over(Window.partitionBy("task", "island").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0))
    nth = F.when(run > 0, F.pmod(run - 1, F.lit(declines)) + 1).otherwise(0)
    return h.select("task", "iteration", nth.cast("long").alias("declines"), (nth == declines).alias("rollback"))


def verdicts(history: DataFrame, margin: float = 0.02) -> DataFrame:
    """Whether a hypothesis holds after its iteration, and why: the first one
    does, later ones where the metric rose by more than the margin."""
    delta = F.col("metric") - F.lag("metric").over(by())
    why = F.when(delta.isNull(), "first").when(delta > margin, "improved").when(delta < -margin, "decreased").otherwise("stagnant")
    return history.select("task", "iteration", why.alias("evidence")).withColumn("validated", F.col("evidence").isin("first", "improved"))
