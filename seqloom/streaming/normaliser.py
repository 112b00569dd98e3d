"""Counts, means and deviations of keys, kept up to date batch by batch.

What is kept of a batch is mergeable: rows, mean, and the sum of squared distances from that mean. A batch is a folder under its id, written over whatever
an earlier attempt left, so redelivery changes nothing; any split into batches gives the figures of one fit over all rows. Nulls in the
value are left out (a key with nothing else has n = 0 and no mean); a null key is a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 1e-6


class Normaliser:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], value: str):
        self.spark, self.path, self.keys, self.value = spark, path, keys, value

    def _folders(self, prefix: str) -> list[str]:
        """Folders that were written to their end."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.listStatus(place) if fs.exists(place) else []
        names = sorted(s.getPath().getName() for s in found if s.getPath().getName().startswith(prefix))
        return [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]

    def update(self, batch: str | int, rows: DataFrame) -> None:
        """Takes a batch in; the same id again replaces it, so it may be delivered any number of times with the same rows."""
        n = F.count(self.value)
        part = rows.groupBy(*self.keys).agg(n.alias("n"), F.avg(self.value).alias("mean"), F.coalesce(F.var_pop(self.value) * n, F.lit(0.0)).alias("m2"))
        part.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def follow(self, stream: DataFrame, checkpoint: str):
        """A streaming query that takes in every micro-batch under its number, and ends with what there is."""
        return stream.writeStream.foreachBatch(lambda rows, number: self.update(f"{number:09d}", rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _parts(self) -> tuple[DataFrame | None, list[str]]:
        bases = self._folders("base=")
        inside = {r.batch for r in self.spark.read.parquet(f"{self.path}/{bases[-1]}/of").collect()} if bases else set()  # ids of batches merged before
        new = [b for b in self._folders("batch=") if b not in inside]
        paths = [f"{self.path}/{b}/totals" for b in bases[-1:]] + [f"{self.path}/{b}" for b in new]
        frames = [self.spark.read.parquet(p) for p in paths]
        return (reduce(DataFrame.unionByName, frames) if frames else None), sorted(inside | set(new))

    def _merged(self, parts: DataFrame) -> DataFrame:
        """Sums of parts: the distances from each part's mean, and those of the means from the common one."""
        n = F.sum("n")
        whole = parts.groupBy(*self.keys).agg(n.alias("n"), (F.sum(F.col("mean") * F.col("n")) / F.nullif(n, F.lit(0))).alias("mean"))
        a, b = parts.alias("a"), whole.alias("b")
        same = reduce(Column.__and__, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.keys), F.lit(True))
        away = F.col("a.mean") - F.col("b.mean")
        sums = a.join(b, same).groupBy(*(F.col(f"b.{k}").alias(k) for k in self.keys), F.col("b.n").alias("n"), F.col("b.mean").alias("mean"))
        return sums.agg((F.sum("a.m2") + F.coalesce(F.sum(F.col("a.n") * away * away), F.lit(0.0))).alias("m2"))

    def totals(self) -> DataFrame:
        """(keys, n, mean, variance, deviation) over all batches; the variance is of the population. Raises ValueError before the first batch."""
        parts, _ = self._parts()
        if parts is None:
            raise ValueError("no batch has been taken in")
        variance = F.col("m2") / F.nullif(F.col("n"), F.lit(0))
        return self._merged(parts).select(*self.keys, "n", "mean", variance.alias("variance"), F.sqrt(variance).alias("deviation"))

    def compact(self) -> None:
        """Merges what has been taken in so far into one table; batches in it may still come again and count no more."""
        parts, inside = self._parts()
        if parts is not None:
            number = len(self._folders("base="))
            self._merged(parts).write.mode("overwrite").parquet(f"{self.path}/base={number:09d}/totals")
            of = self.spark.createDataFrame([(b,) for b in inside], "batch string").coalesce(1)
            of.write.mode("overwrite").parquet(f"{self.path}/base={number:09d}/of")
            of.limit(0).write.mode("append").parquet(f"{self.path}/base={number:09d}")

    def scaled(self, rows: DataFrame, out: str = "scaled") -> DataFrame:
        """rows with the value's distance from its key's mean in deviations (of at least LEAST); null for unknown keys."""
        t = self.totals().select(*(F.col(k).alias(f"_{k}") for k in self.keys), F.col("mean").alias("_mean"), F.greatest("deviation", F.lit(LEAST)).alias("_deviation"))
        same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys), F.lit(True))
        return rows.join(t, same, "left").withColumn(out, (F.col(self.value) - F.col("_mean")) / F.col("_deviation")).drop(*(f"_{k}" for k in self.keys), "_mean", "_deviation")
