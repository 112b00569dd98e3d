"""A user's function over the frames of a stream, and what a run of it reports.

The function gets Arrow batches, never rows. Where it fails, the batch is halved until the failing frames stand alone; these become silence
with their error beside them and all others keep their result. So one bad frame costs a logarithm of calls and stops nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

#: Frames that the function gets at once.
AT_ONCE = 1024
#: The samples of each frame of a batch, as rows of one array or as a list of arrays.
Function = Callable[[pa.RecordBatch], "np.ndarray | list"]


def _tried(function: Function, batch: pa.RecordBatch, size: int, out: np.ndarray, errors: list[str | None], at: int) -> None:
    try:
        got = np.asarray(function(batch), np.float64)
        if got.shape != (batch.num_rows, size):
            raise ValueError(f"the function gave {got.shape} for {batch.num_rows} frames of {size} samples")
        if batch.num_rows == 1 and not np.isfinite(got).all():
            raise ValueError("samples are not finite")
    except Exception as e:
        if batch.num_rows == 1:
            errors[at] = f"{type(e).__name__}: {e}"
            return
        half = batch.num_rows // 2
        _tried(function, batch.slice(0, half), size, out, errors, at)
        _tried(function, batch.slice(half), size, out, errors, at + half)
        return
    for i in np.flatnonzero(~np.isfinite(got).all(axis=1)):
        errors[at + i], got[i] = "ValueError: samples are not finite", 0
    out[at : at + batch.num_rows] = got


def mapped(frames: DataFrame, function: Function, size: int, samples: str = "samples", error: str = "error", cost: str = "cost_ms") -> DataFrame:
    """frames (a batch or a stream) with ``size`` samples of the function each, the error (null if none) and the milliseconds it took.

    A frame whose function raises, gives another number of samples or one that is not finite, is silent: all zeros. The function must treat
    frames one by one, since they come in batches of any size; what it needs beyond them it holds itself. A batch's time is shared by its frames."""
    names = frames.columns
    schema = StructType([*frames.schema, StructField(samples, ArrayType(DoubleType())), StructField(error, StringType()), StructField(cost, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(i, AT_ONCE)
                n, began = batch.num_rows, time.perf_counter()
                out, errors = np.zeros((n, size)), [None] * n
                _tried(function, batch, size, out, errors, 0)
                took = (time.perf_counter() - began) * 1000 / n
                rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, rows, pa.array(errors, pa.string()), pa.array(np.full(n, took))], names=[*names, samples, error, cost])

    return frames.mapInArrow(run, schema)


class Session:
    """A stream of mapped frames into a folder: start, flush, stop, and what it did.

    Each micro-batch is written under its number, over what an attempt before may have left, so a batch that is delivered again counts once.
    With ``stop_on_error`` the stream ends at the first batch with a failed frame: no later one is taken and, once the function is
    mended, a new session over the same folders begins with it, writing over what was there. Figures of a batch (frames, failures, mean and longest milliseconds a frame, seconds of the batch)
    are a row of the folder ``stats``."""

    def __init__(self, frames: DataFrame, path: str, error: str = "error", cost: str = "cost_ms", stop_on_error: bool = False):
        self.frames, self.path, self.error, self.cost, self.stop_on_error = frames, path, error, cost, stop_on_error
        self.spark: SparkSession = frames.sparkSession
        self.query: StreamingQuery | None = None
        self.ends = False

    def _write(self, batch: DataFrame, number: int) -> None:
        began, place = time.time(), f"{self.path}/frames/batch={number:09d}"
        batch.write.mode("overwrite").parquet(place)
        done = self.spark.read.schema(batch.schema).parquet(place)
        stats = done.agg(
            F.count("*").alias("frames"), F.count(self.error).alias("failed"), F.avg(self.cost).alias("mean_ms"), F.max(self.cost).alias("peak_ms"),
        ).withColumn("seconds", F.lit(time.time() - began))
        stats.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats/batch={number:09d}")
        if self.stop_on_error and (bad := done.where(F.col(self.error).isNotNull()).select(self.error).first()):
            raise RuntimeError(f"batch {number}: {bad[0]}")

    def start(self, all_at_once: bool = True) -> Session:
        """Runs what there is and ends (``all_at_once``), or goes on until it is stopped. A started session can't be started again before it has stopped."""
        if self.active:
            raise RuntimeError("the session is running")
        writer = self.frames.writeStream.foreachBatch(self._write).option("checkpointLocation", f"{self.path}/checkpoint")
        self.ends = all_at_once
        self.query = (writer.trigger(availableNow=True) if all_at_once else writer).start()
        return self

    @property
    def active(self) -> bool:
        return self.query is not None and self.query.isActive

    def flush(self) -> Session:
        """Waits for all that has arrived so far; an error of the stream is raised here."""
        if self.query is not None:
            self.query.awaitTermination() if self.ends or not self.query.isActive else self.query.processAllAvailable()
        return self

    def stop(self) -> None:
        if self.active:
            self.query.stop()

    def output(self) -> DataFrame:
        """All frames written so far."""
        return self.spark.read.schema(self.frames.schema).parquet(f"{self.path}/frames/*")

    def stats(self) -> DataFrame:
        """A row for each batch, and ``batch`` beside it."""
        return self.spark.read.parquet(f"{self.path}/stats")


def latency(stats: DataFrame) -> DataFrame:
    """One row: frames and failures of all batches, the mean milliseconds a frame, the longest, and frames a second."""
    n = F.sum("frames")
    return stats.agg(
        n.alias("frames"), F.sum("failed").alias("failed"), (F.sum(F.col("mean_ms") * F.col("frames")) / n).alias("mean_ms"), F.max("peak_ms").alias("peak_ms"), (n / F.sum("seconds")).alias("frames_a_second"),
    )
