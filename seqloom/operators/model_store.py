"""Tables of models: totals, consistency, validity, look-ups by name, scores and distances.

A model is a row with ``name``; its states and mixtures are arrays or rows of their own as each function says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_VARIANCE = 1e-6


def totals(models: DataFrame, states: str = "states", mixtures: str = "mixtures") -> DataFrame:
    """One row: models, states and mixtures; ``states`` is an array of structs with an array ``mixtures``. Null arrays hold none."""
    n = F.aggregate(F.coalesce(F.transform(states, lambda s: F.greatest(F.size(s[mixtures]), F.lit(0))), F.array().cast("array<int>")), F.lit(0), lambda a, x: a + x)
    return models.agg(F.count("*").alias("models"), F.coalesce(F.sum(F.greatest(F.size(states), F.lit(0))), F.lit(0)).alias("states"), F.coalesce(F.sum(n), F.lit(0)).alias("mixtures"))


def names(models: DataFrame, name: str = "name") -> DataFrame:
    """The sorted distinct names; null is none."""
    return models.where(F.col(name).isNotNull()).select(name).distinct().orderBy(name)


def without(models: DataFrame, removed: DataFrame, name: str = "name") -> DataFrame:
    """The models whose name is not among the removed; a null name stays."""
    return models.join(removed.select(name).distinct(), name, "left_anti")


def prefix(name: Column) -> Column:
    """The phoneme of a model's name: what stands before the first underscore."""
    return F.substring_index(name, "_", 1)


def distribution(contexts: DataFrame, models: DataFrame, name: str = "name") -> DataFrame:
    """(name, n): contexts by model; contexts without a model are left out, models without a context have no row."""
    return contexts.join(models.select(name).distinct(), name).groupBy(name).agg(F.count("*").alias("n"))


def consistency(models: DataFrame, name: str, states: str, dims: str, variance: str, sigmas: float = 3.0) -> DataFrame:
    """One row: names that stand more than once, the numbers of distinct state counts and of dimensions, the ratio of the largest to the
    smallest positive variance, and the models whose variance lies further than ``sigmas`` deviations from the mean."""
    by_name = models.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("duplicates"))
    v = F.col(variance)
    spread = models.agg(
        F.countDistinct(states).alias("state_counts"), F.countDistinct(dims).alias("dimensions"), F.try_divide(F.max(F.when(v > 0, v)), F.min(F.when(v > 0, v))).alias("variance_ratio"), F.avg(v).alias("_m"), F.stddev_pop(v).alias("_d"),
    )
    far = models.crossJoin(F.broadcast(spread.select("_m", "_d"))).agg(F.count_if((F.col("_d") > 0) & (F.abs(v - F.col("_m")) > sigmas * F.col("_d"))).alias("outliers"))
    return by_name.crossJoin(F.broadcast(spread.drop("_m", "_d"))).crossJoin(F.broadcast(far))  # one row each


def weighted_score(scores: DataFrame, keys: list[str], log_likelihood: str, frames: str) -> DataFrame:
    """By key the mean log likelihood, weighted by frames; null without frames."""
    return scores.groupBy(*keys).agg(F.try_divide(F.sum(F.col(log_likelihood) * F.col(frames)), F.sum(F.when(F.col(log_likelihood).isNotNull(), F.col(frames)))).alias("score"))


def transition_distance(a: Column, b: Column) -> tuple[Column, Column]:
    """L1 and L2 distances of two flat transition arrays over their common length."""
    n = F.least(F.size(a), F.size(b))
    d = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x - y)
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + F.abs(x)), F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def variance_valid(mean: Column, variance: Column, dims: int) -> Column:
    """True if mean and variance have ``dims`` finite values and no variance is under the least."""
    whole = lambda a: F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(mean) == dims) & (F.size(variance) == dims) & whole(mean) & whole(variance) & F.forall(variance, lambda x: x >= LEAST_VARIANCE), F.lit(False))


def mixture_valid(weight: Column, variance: Column) -> Column:
    """True for a finite weight of 0 or more and positive finite variances."""
    return F.coalesce((weight >= 0) & (weight < float("inf")) & ~F.isnan(weight) & F.forall(variance, lambda x: x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))), F.lit(False))


def trajectory_inputs_valid(means: Column, variances: Column, durations: Column) -> Column:
    """True if the arrays are of one size, not empty, and all variances and durations are positive."""
    return F.coalesce((F.size(means) > 0) & (F.size(means) == F.size(variances)) & (F.size(means) == F.size(durations)) & F.forall(variances, lambda x: x > 0) & F.forall(durations, lambda x: x > 0), F.lit(False))


def merged_variance(sets: DataFrame, keys: list[str], variance: str, count: str) -> DataFrame:
    """By key the mean variance of several sets weighted by their counts, and the sum of counts: whatever order they come in."""
    return sets.groupBy(*keys).agg(F.try_divide(F.sum(F.col(variance) * F.col(count)), F.sum(count)).alias("variance"), F.sum(count).alias("count"))


def best_match(candidates: DataFrame, keys: list[str], score: str, name: str) -> DataFrame:
    """By key the name with the highest score, the first by name among equals; null scores lose."""
    low = F.coalesce(-F.col(score), F.lit(float("inf")))
    return candidates.groupBy(*keys).agg(F.min(F.struct(low.alias("s"), F.col(name).alias("n")))["n"].alias(name))


def path(low: Column, high: Column) -> Column:
    """The major versions that a migration passes, from one to the other, in either direction; their difference says how far it is."""
    return F.sequence(low, high)


def migration_safe(low: Column, high: Column) -> Column:
    """True for steps of one major version at most, and never down."""
    return (high >= low) & (high - low <= 1)


def compatibility(pairs: DataFrame, table: DataFrame, low: str, high: str, value: str) -> DataFrame:
    """pairs with ``value``: the row of the table for both versions, else ``same`` for equal versions, ``upgrade`` or ``unsupported``."""
    rule = F.when(F.col(low) == F.col(high), "same").when(F.col(low) < F.col(high), "upgrade").otherwise("unsupported")
    return pairs.join(table.select(low, high, F.col(value).alias("_v")), [low, high], "left").withColumn(value, F.coalesce("_v", rule)).drop("_v")


def fields(rules: DataFrame, version: Column) -> DataFrame:
    """rules (field, added, deprecated, removed) with ``state`` at a version: absent, current, deprecated or removed; nulls never happen."""
    state = F.when(version < F.col("added"), "absent").when(version >= F.col("removed"), "removed").when(version >= F.col("deprecated"), "deprecated").otherwise("current")
    return rules.withColumn("state", state)
