"""Joins in time: nearest or first within a tolerance, in force at a time, between two controls, inside an interval.

Range conditions are turned into equi-joins on time buckets, so that they shuffle by key and bucket instead of comparing all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(left: DataFrame, right: DataFrame, left_time: str, right_time: str, tolerance: float, keys: list[str]) -> DataFrame:
    """Pairs of rows of equal keys less than ``tolerance`` apart, with their distance."""
    bucket = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    spread = left.withColumn("_b", F.explode(F.array(bucket(left_time) - 1, bucket(left_time), bucket(left_time) + 1)))
    pairs = spread.join(right.withColumn("_b", bucket(right_time)), [*keys, "_b"]).drop("_b")
    return pairs.withColumn("distance", F.abs(F.col(left_time) - F.col(right_time))).where(F.col("distance") < tolerance)


def nearest(left: DataFrame, right: DataFrame, left_id: str, left_time: str, right_time: str, tolerance: float, keys: list[str], order: str, first: bool = False) -> DataFrame:
    """For each left row the nearest right row (or the first in order) within the tolerance; the smallest ``order`` wins ties; left rows
    without one are dropped."""
    pairs = within(left, right, left_time, right_time, tolerance, keys)
    rank = F.struct(order) if first else F.struct("distance", order)
    best = pairs.groupBy(left_id).agg(F.min_by(F.struct(*(c for c in pairs.columns if c != left_id)), rank).alias("m"))
    return best.select(left_id, "m.*")


def in_force(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, tie: str) -> DataFrame:
    """left with the value of the last right row at or before its time, null before the first; both sides pass one window, no pairs."""
    tagged = right.select(*keys, time, F.col(tie).alias("_tie"), F.struct(value).alias("_v"), F.lit(0).alias("_side"))
    both = left.withColumn("_tie", F.lit(None).cast(right.schema[tie].dataType)).withColumn("_v", F.lit(None).cast(tagged.schema["_v"].dataType)).withColumn("_side", F.lit(1)).unionByName(tagged, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(time, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_l", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").withColumn(f"{value}_in_force", F.col("_l")[value]).drop("_tie", "_v", "_side", "_l")


def interpolated(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """left with ``curve``: the right side's value at its time, linear between the two around it, held beyond the ends."""
    knots = right.select(*keys, time, F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("_k")).withColumn("_side", F.lit(0))
    both = left.withColumn("_k", F.lit(None).cast(knots.schema["_k"].dataType)).withColumn("_side", F.lit(1)).unionByName(knots, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(time, "_side")
    a, b = F.last("_k", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("_k", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    x = both.withColumns({"_a": a, "_b": b}).where("_side = 1")
    blend = F.expr(f"CASE WHEN _a IS NULL THEN _b.v WHEN _b IS NULL OR _b.t = _a.t THEN _a.v ELSE _a.v + (_b.v - _a.v) * ({time} - _a.t) / (_b.t - _a.t) END")
    return x.withColumn("curve", blend).drop("_k", "_side", "_a", "_b")


def inside(points: DataFrame, spans: DataFrame, keys: list[str], time: str, start: str, end: str, width: float) -> DataFrame:
    """Points joined with the spans [start, end) of equal keys that hold them, by buckets of ``width``; a span stands in each bucket it
    touches."""
    bucket = lambda c: F.floor(c / width).cast("long")
    covered = spans.where(F.col(end) > F.col(start)).withColumn("_b", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    held = (F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))
    return points.withColumn("_b", bucket(F.col(time))).join(covered, [*keys, "_b"]).where(held).drop("_b")


def held(points: DataFrame, spans: DataFrame, keys: list[str], time: str, start: str, end: str, least: int = 0) -> DataFrame:
    """Points joined with the spans [start, end) of equal keys that hold them, for spans of any lengths.

    A span stands in the buckets of the power of two that is at least its length (and at least 2 ** least), so in two of them at most, however long it is; a point
    looks once at each of the powers that occur, of which there are no more than 64. Spans that are empty or have a null hold nothing."""
    length = F.col(end) - F.col(start)
    level = F.greatest(F.ceil(F.log2(length)).cast("int"), F.lit(least))
    x = spans.where(length > 0).withColumn("_level", level)
    # rounding of the logarithm must not leave a bucket shorter than the span
    x = x.withColumn("_level", F.when(F.pow(F.lit(2.0), F.col("_level")) < length, F.col("_level") + 1).otherwise(F.col("_level")))
    levels = sorted(r[0] for r in x.select("_level").distinct().collect())  # at most 64 for whole numbers
    bucket = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    covered = x.withColumn("_b", F.explode(F.array_distinct(F.array(bucket(F.col(start)), bucket(F.col(end))))))
    spread = points.withColumn("_level", F.explode(F.array(*(F.lit(v) for v in levels)).cast("array<int>"))).withColumn("_b", bucket(F.col(time)))
    return spread.join(covered, [*keys, "_level", "_b"]).where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("_level", "_b")


def paired(left: DataFrame, right: DataFrame, left_key: str, right_key: str, at_once: int = 1 << 25) -> DataFrame:
    """All pairs of rows of equal keys, however few the keys: those of a key are dealt into cells, the left rows of one against the right rows of one, so that a task
    makes about ``at_once`` pairs. There are as many pairs as there are, only no task has more of them than others."""
    cell, side = max(at_once // 4, 1), 1 << 16
    n = left.groupBy(F.col(left_key).alias("_k")).agg(F.count("*").alias("_l")).join(right.groupBy(F.col(right_key).alias("_k")).agg(F.count("*").alias("_r")), "_k")
    total = n.agg(F.sum(F.expr("_l * _r"))).first()[0] or 0
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, -(-total // at_once))
    n = n.select("_k", F.ceil(F.col("_l") * F.least("_r", F.lit(side)) / cell).alias("_lefts"), F.ceil(F.col("_r") / side).alias("_rights"))
    dealt = lambda df, of: F.pmod(F.xxhash64(*df.columns), F.col(of)).cast("long")
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of).cast("long") - 1))
    x = left.withColumn("_k", F.col(left_key)).join(n, "_k").select("_k", dealt(left, "_lefts").alias("_a"), every("_rights").alias("_b"), *left.columns).repartition(tasks, "_k", "_a", "_b")
    y = right.withColumn("_k", F.col(right_key)).join(n, "_k").select("_k", every("_lefts").alias("_a"), dealt(right, "_rights").alias("_b"), *right.columns).repartition(tasks, "_k", "_a", "_b")
    return x.join(y, ["_k", "_a", "_b"]).drop("_k", "_a", "_b")


def with_default(facts: DataFrame, dimension: DataFrame, key: Column, dim_key: str, value: str, default: Column) -> DataFrame:
    """facts with a looked-up value; an exact key first, then its lower-case form, then the default. AQE broadcasts a small dimension."""
    d = dimension.select(F.col(dim_key).alias("_k1"), F.col(value).alias("_v1"))
    low = dimension.select(F.col(dim_key).alias("_k2"), F.col(value).alias("_v2"))
    x = facts.withColumn("_key", key).join(d, F.col("_key") == F.col("_k1"), "left").join(low, F.lower("_key") == F.col("_k2"), "left")
    return x.withColumn(value, F.coalesce("_v1", "_v2", default)).drop("_key", "_k1", "_v1", "_k2", "_v2")
