"""Roll-ups of benchmark runs, comparisons, jobs and errors, and the rules that read them.

All are partial aggregates by key; null values are left out of sums and means unless a docstring says otherwise.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regression(current: Column, baseline: Column) -> tuple[Column, Column]:
    """Change in percent of the baseline, and its severity above 50, 25 and 15 percent; null without a baseline."""
    change = F.try_divide((current - baseline) * 100.0, baseline)
    return change, F.when(change > 50, "critical").when(change > 25, "high").when(change > 15, "medium").when(change.isNotNull(), "low")


def level(distortion: Column, rmse: Column, correlation: Column) -> Column:
    """EXCELLENT, GOOD, FAIR or POOR; INVALID where a metric is missing or negative."""
    ok = (distortion >= 0) & (rmse >= 0) & correlation.isNotNull()
    steps = ((4.0, 15.0, 0.9, "EXCELLENT"), (6.0, 25.0, 0.8, "GOOD"), (8.0, 35.0, 0.7, "FAIR"))
    out = F.when(~F.coalesce(ok, F.lit(False)), "INVALID")
    for d, r, c, name in steps:
        out = out.when((distortion < d) & (rmse < r) & (correlation > c), name)
    return out.otherwise("POOR")


def composite(distortion: Column, rmse: Column, correlation: Column) -> Column:
    """0.4 (1 - distortion / 10) + 0.3 (1 - rmse / 50) + 0.3 correlation."""
    return 0.4 * (1 - distortion / 10) + 0.3 * (1 - rmse / 50) + 0.3 * correlation


def benchmark(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """By key: n, least, most, mean, median (exact), sample deviation (0 for one run) and ``score`` = 1 - deviation / mean, 0 at least.

    The median is found by rank over value counts, so no group of runs is gathered."""
    v = runs.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("m"))
    stats = runs.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("deviation"))
    upto = F.sum("m").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("m").over(Window.partitionBy(*keys))
    mid = v.select(*keys, "v", (upto - F.col("m")).alias("a"), upto.alias("b"), whole.alias("w")).where("2 * a <= w AND 2 * b >= w AND (2 * a < w OR b > a)")
    mid = mid.groupBy(*keys).agg(((F.min("v") + F.max("v")) / 2).alias("median"))
    score = F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("deviation"), F.col("mean")))
    return stats.join(mid, keys, "left").withColumn("score", score)


def thread_efficiency(runs: DataFrame, keys: list[str], threads: str, time: str) -> DataFrame:
    """By key: ``efficiency``, the largest speed-up over one thread divided by the threads, 0 without a run of one thread, and
    ``best_threads``, those of the fastest run (the fewest of equals)."""
    t = runs.groupBy(*keys, threads).agg(F.avg(time).alias("t"))
    one = F.max(F.when(F.col(threads) == 1, F.col("t")))
    got = t.groupBy(*keys).agg(one.alias("one"), F.min(F.when(F.col(threads) > 1, F.col("t") * F.col(threads))).alias("work"), F.min(F.struct("t", threads))[threads].alias("best_threads"))
    return got.select(*keys, F.coalesce(F.try_divide(F.col("one"), F.col("work")), F.lit(0.0)).alias("efficiency"), "best_threads")


def wins(pairs: DataFrame, a: str, b: str, margin: float = 0.0) -> DataFrame:
    """One row: wins of each side, ties within the margin, their percentages and both means, over the pairs that have both."""
    x, y = F.col(a), F.col(b)
    got = pairs.where(x.isNotNull() & y.isNotNull()).agg(
        F.count_if((x - y > margin)).alias("wins_a"), F.count_if((y - x > margin)).alias("wins_b"), F.count_if(F.abs(x - y) <= margin).alias("ties"), F.avg(x).alias("mean_a"), F.avg(y).alias("mean_b"), F.count("*").alias("n"),
    )
    return got.select("*", *(F.try_divide(100.0 * F.col(c), F.col("n")).alias(f"percent_{c}") for c in ("wins_a", "wins_b", "ties")))


def pass_rates(results: DataFrame, keys: list[str], passed: Column, score: str) -> DataFrame:
    """By key: n, passed, the rate, and the mean score of all and of those that passed."""
    return results.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(passed).alias("passed"), F.avg(F.coalesce(passed, F.lit(False)).cast("double")).alias("rate"), F.avg(score).alias("mean_score"), F.avg(F.when(passed, F.col(score))).alias("mean_passed"),
    )


def jobs(done: DataFrame, keys: list[str], success: Column, ms: str, size: str, total: int) -> DataFrame:
    """By key, of a batch of ``total`` jobs: completed, failed, bytes, mean ms of the completed, and the ms still to come at that mean."""
    got = done.groupBy(*keys).agg(F.count_if(success).alias("completed"), F.count_if(~F.coalesce(success, F.lit(False))).alias("failed"), F.coalesce(F.sum(F.when(success, F.col(size))), F.lit(0)).alias("bytes"), F.avg(F.when(success, F.col(ms))).alias("mean_ms"))
    left = F.greatest(F.lit(total) - F.col("completed") - F.col("failed"), F.lit(0))
    return got.withColumn("remaining_ms", F.coalesce(left * F.col("mean_ms"), F.lit(0.0)))


def history(samples: DataFrame, keys: list[str], order: list[str], value: str, last: int = 1000) -> DataFrame:
    """By key: mean and peak of the newest ``last`` samples, a bounded history."""
    newest = Window.partitionBy(*keys).orderBy(*(F.col(o).desc() for o in order))
    return samples.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= last).groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("peak"))


def error_counts(errors: DataFrame, severity: str, category: str) -> DataFrame:
    """(dimension, value, n): counts by severity and by category."""
    both = F.array(*(F.struct(F.lit(n).alias("dimension"), F.col(c).alias("value")) for n, c in (("severity", severity), ("category", category))))
    return errors.select(F.inline(both)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def baselines(runs: DataFrame, keys: list[str], day: str, value: str, until: Column, days: int = 30, least: int = 10) -> DataFrame:
    """By key over the ``days`` up to a date: n, mean, deviation, least and most, where there are ``least`` runs or more."""
    near = runs.where((F.col(day) > F.date_sub(until, days)) & (F.col(day) <= until))
    got = near.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), F.min(value).alias("least"), F.max(value).alias("most"))
    return got.where(F.col("n") >= least)


def trend(runs: DataFrame, keys: list[str], time: Column, value: str) -> DataFrame:
    """By key and day: mean, least, most and count."""
    return runs.groupBy(*keys, F.to_date(time).alias("day")).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n"))


def deviation(reference: Column, other: Column) -> Column:
    """Mean relative error of two arrays over their common length, places with a reference of 0 left out; 0 if none is left."""
    n = F.least(F.size(reference), F.size(other))
    pairs = F.filter(F.arrays_zip(F.slice(reference, 1, n).alias("a"), F.slice(other, 1, n).alias("b")), lambda p: p["a"] != 0)
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.abs((p["a"] - p["b"]) / p["a"]))
    return F.coalesce(F.try_divide(total, F.size(pairs)), F.lit(0.0))


def cpu_estimate(mean_ms: Column, period_ms: Column) -> Column:
    """Mean time of a frame over its period, 1 at most."""
    return F.least(F.lit(1.0), F.try_divide(mean_ms, period_ms))


def balanced(weights: dict[str, float], workers: int) -> list[list[str]]:
    """Items dealt to workers, the heaviest first, each to the lightest worker: a driver utility for short lists; tables are dealt by
    ``repartition`` and adaptive execution. Equal weights go by name."""
    heap = [(0.0, i) for i in range(workers)]
    out: list[list[str]] = [[] for _ in range(workers)]
    for name, weight in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        load, i = heapq.heappop(heap)
        out[i].append(name)
        heapq.heappush(heap, (load + weight, i))
    return out
