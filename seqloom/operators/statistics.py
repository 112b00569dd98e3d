"""Grouped statistics: all are sums, extremes or sorted picks that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-6


def exact_mean(value: Column) -> Column:
    """The mean, from a sum that does not depend on the order of rows: that of twelve decimals, or of doubles where a value has more than 14 digits before them."""
    fixed = value.try_cast("decimal(26,12)")
    n = F.count(value)
    return F.when(F.count(fixed) == n, F.try_divide(F.try_sum(fixed).cast("double"), n)).otherwise(F.avg(value))


def profile(df: DataFrame, keys: list[str], name: str, file: str, timed: Column) -> DataFrame:
    """Rows, distinct names and files, rows with any timing, and extra occurrences of names."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), F.countDistinct(name).alias("names"), F.countDistinct(file).alias("files"), F.count_if(timed).alias("timed"), (F.count(name) - F.countDistinct(name)).alias("extra"))


def normaliser(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, population deviation, extremes, and quartiles as picks of the sorted values at n/4, n/2 and 3n/4."""
    pick = lambda q: F.element_at("_a", (F.floor(F.size("_a") * q) + 1).cast("int"))
    x = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"), F.array_sort(F.collect_list(value)).alias("_a"))
    return x.withColumns({"q25": pick(0.25), "median": pick(0.5), "q75": pick(0.75)}).drop("_a")


def global_variance(df: DataFrame, group: str, dim: str, value: str) -> DataFrame:
    """Frames, mean and floored population variance for each (group, dim), and for each dim over all groups (group null)."""
    return df.groupingSets([(group, dim), (dim,)], group, dim).agg(F.count("*").alias("frames"), F.avg(value).alias("mean"), F.greatest(F.var_pop(value), F.lit(FLOOR)).alias("variance"))


def aligned_variance(frames: DataFrame, spans: DataFrame, keys: list[str], time: str, start: str, end: str, label: str, features: str) -> DataFrame:
    """(label, dim, frames, mean, variance): the global variance by label of the frames inside each label's spans, and over all labels (label null).

    A frame in several spans counts in each; frames without features or outside all spans count nowhere; spans without a label count in the whole only."""
    from seqloom.operators.temporal import held

    x = held(frames.where(F.col(features).isNotNull()).select(*keys, time, features), spans.select(*keys, start, end, label), keys, time, start, end)
    return global_variance(x.select(label, F.posexplode(features).alias("dim", "value")), label, "dim", "value")


def spectral_distance(df: DataFrame, keys: list[str], a: str, b: str, skip: int = 1) -> DataFrame:
    """Mean over frames of 10 / ln 10 * 2 * sqrt(sum of squared differences), from coefficient ``skip`` on."""
    d = F.aggregate(F.zip_with(F.slice(a, skip + 1, F.size(a)), F.slice(b, skip + 1, F.size(b)), lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return df.groupBy(*keys).agg((20.0 / F.ln(F.lit(10.0)) * F.avg(F.sqrt(d))).alias("distance"), F.count("*").alias("frames"))


def voiced_rmse(df: DataFrame, keys: list[str], a: str, b: str, least: float) -> DataFrame:
    """Root mean squared difference over rows where both exceed ``least``; -1 where there is none."""
    both = (F.col(a) > least) & (F.col(b) > least)
    return df.groupBy(*keys).agg(F.coalesce(F.sqrt(F.avg(F.when(both, (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))))), F.lit(-1.0)).alias("rmse"), F.count_if(both).alias("pairs"))


def correlation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pearson's r from sums; 0 where a side hardly varies."""
    x = df.groupBy(*keys).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(F.col(a) * F.col(b)).alias("mab"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"))
    den = F.sqrt(F.col("va") * F.col("vb"))
    return x.select(*keys, F.when(den < 1e-10, 0.0).otherwise((F.col("mab") - F.col("ma") * F.col("mb")) / F.greatest(den, F.lit(1e-10))).alias("r"))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Least, most, mean, median, sample deviation (0 for one row)."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def sufficient(df: DataFrame, keys: list[str], weight: str, value: str) -> DataFrame:
    """Zeroth, first and second weighted moments, which add up."""
    w, x = F.col(weight), F.col(value)
    return df.groupBy(*keys).agg(F.sum(w).alias("s0"), F.sum(w * x).alias("s1"), F.sum(w * x * x).alias("s2"))


def transitions(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Counts of each step between states, and their share of the steps from that state."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("to_state", F.lead(state).over(w)).where("to_state IS NOT NULL").groupBy(F.col(state).alias("from_state"), "to_state").agg(F.count("*").alias("steps"))
    return x.withColumn("share", F.col("steps") / F.sum("steps").over(Window.partitionBy("from_state")))


def severity_score(df: DataFrame, key: str, severity: Column) -> DataFrame:
    """Counts by severity, and 1 - (0.5 critical + 0.2 error + 0.05 warning + 0.01 info), at least 0; valid: no critical and no error."""
    kinds = {"critical": 0.5, "error": 0.2, "warning": 0.05, "info": 0.01}
    x = df.withColumn("_s", severity).groupBy(key).agg(*(F.count_if(F.col("_s") == k).alias(k) for k in kinds))
    off = sum((w * F.col(k) for k, w in kinds.items()), F.lit(0.0))
    return x.withColumns({"score": F.greatest(F.lit(0.0), 1 - off), "valid": (F.col("critical") == 0) & (F.col("error") == 0), "usable": F.col("critical") == 0})


def kmeans_step(points: DataFrame, centroids: DataFrame, point_id: str, features: str) -> DataFrame:
    """One Lloyd step: the nearest centroid of each point (smallest id wins ties), and each cluster's mean by dimension.

    centroids (cid, c array) are a model's, few by nature; they are broadcast as one array."""
    model = centroids.agg(F.array_sort(F.collect_list(F.struct("cid", "c"))).alias("cs"))
    dist = F.expr(f"transform(cs, k -> struct(aggregate(zip_with(k.c, {features}, (a, b) -> CAST(a - b AS DOUBLE) * CAST(a - b AS DOUBLE)), 0D, (s, x) -> s + x) AS d, k.cid AS cid))")
    near = points.crossJoin(F.broadcast(model)).withColumn("cid", F.array_min(dist)["cid"])  # the right side is one row
    return near.select(point_id, "cid", features)


def kmeans(points: DataFrame, point_id: str, features: str, k: int, steps: int = 20) -> list[list[float]]:
    """Centroids after at most ``steps`` rounds, from the k rows of smallest id; an empty cluster keeps its centroid.

    Rows without features are left out. Means are sums by cluster and dimension, so only k rows of centroids reach the driver."""
    held = points.where(F.col(features).isNotNull()).select(point_id, features)
    centres = [[float(v) for v in r[features]] for r in held.orderBy(point_id).limit(k).collect()]  # k rows
    for _ in range(steps if centres else 0):
        model = points.sparkSession.createDataFrame(list(enumerate(centres)), "cid int, c array<double>")
        near = kmeans_step(held, model, point_id, features).select("cid", F.posexplode(features).alias("j", "x"))
        now = [list(c) for c in centres]
        for r in near.groupBy("cid", "j").agg(F.avg("x").alias("m")).collect():  # k rows for each dimension
            now[r.cid][r.j] = r.m
        if now == centres:
            break
        centres = now
    return centres


def variance_corrected(df: DataFrame, keys: list[str], label: str, dim: str, value: str, targets: DataFrame, target: str = "variance", weight: float = 1.0) -> DataFrame:
    """df with ``corrected``: each value moved from its sequence's mean by the root of target over present variance, between 0.01 and 2.

    ``targets`` holds a variance for each (label, dim); one row a label and dimension, so its size is that of an inventory. Values without a
    target, and dimensions that hardly vary, stay; ``weight`` blends from the old value (0) to the corrected one (1)."""
    x = df.groupBy(*keys, dim).agg(F.avg(value).alias("_mean"), F.var_pop(value).alias("_var"))
    goal = targets.select(F.col(label).alias("_label"), F.col(dim).alias("_dim"), F.col(target).alias("_target"))
    y = df.join(x, [*keys, dim], "left").join(goal, (F.col(label) == F.col("_label")) & (F.col(dim) == F.col("_dim")), "left")
    factor = F.greatest(F.lit(0.01), F.least(F.lit(2.0), F.sqrt(F.col("_target") / F.col("_var"))))
    moved = F.col("_mean") + factor * (F.col(value) - F.col("_mean"))
    usable = (F.col("_var") > FLOOR) & (F.col("_target") > FLOOR)
    return y.withColumn("corrected", F.when(usable, F.col(value) + weight * (moved - F.col(value))).otherwise(F.col(value))).drop("_mean", "_var", "_label", "_dim", "_target")


def variance_weights(df: DataFrame, keys: list[str], label: str, dim: str, value: str, targets: DataFrame, target: str = "variance") -> DataFrame:
    """(keys, label, weight): 1 plus the mean over dimensions of |ln(present / target variance)|, between 0.01 and 2; 1 where no dimension counts."""
    now = df.groupBy(*keys, dim).agg(F.var_pop(value).alias("_var"))
    goal = targets.select(F.col(label).alias("_label"), F.col(dim).alias("_dim"), F.col(target).alias("_target"))
    labels = df.select(*keys, label).distinct()
    y = labels.join(now, keys).join(goal, (F.col(label) == F.col("_label")) & (F.col(dim) == F.col("_dim")), "left")
    away = F.when((F.col("_var") > FLOOR) & (F.col("_target") > FLOOR), F.abs(F.ln(F.col("_var") / F.col("_target"))))
    return y.groupBy(*keys, label).agg(F.greatest(F.lit(0.01), F.least(F.lit(2.0), F.coalesce(1 + F.avg(away), F.lit(1.0)))).alias("weight"))
