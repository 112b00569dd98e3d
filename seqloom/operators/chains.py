"""Many hidden Markov chains at once: models are rows, and one job a step moves all that have not converged.

A step joins sequences with their models by name, adds up expected counts in each task and once more by (model, number), and moves every model
by its own sums; neither models nor counts pass the driver. Which sequences only validate follows from a hash of their keys, so a model trained among
others comes out as it does alone. A sequence meets in one task; its own length bounds that.

A model is (name, weights [n][m], means [n][m][d], variances [n][m][d], transition [n][n]): n states from the first to the last, m Gaussians each.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.kernels import FLOOR, chain_counts
from seqloom.streaming.places import kept

PARTS = ("weights", "means", "variances", "transition")
_TYPES = {"weights": "array<array<double>>", "means": "array<array<array<double>>>", "variances": "array<array<array<double>>>", "transition": "array<array<double>>"}
_TRACE = "array<struct<train:double,held:double>>"
#: Models whose sums, or whose numbers, a task holds at once.
AT_ONCE = 128


def _matrix(depth: int) -> pa.DataType:
    out = pa.float64()
    for _ in range(depth):
        out = pa.list_(out)
    return out


_ARROW = {"weights": _matrix(2), "means": _matrix(3), "variances": _matrix(3), "transition": _matrix(2)}


def sequences(frames: DataFrame, model: str, keys: list[str], order: str, features: str) -> DataFrame:
    """(model, keys, x): each sequence's features by order (equal orders by the features themselves); frames without features, or of no model, are left out."""
    held = frames.where(F.col(features).isNotNull() & F.col(model).isNotNull())
    x = held.groupBy(F.col(model).alias("model"), *keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(features).alias("x")))).alias("f"))
    return x.select("model", *keys, F.col("f.x").alias("x"))


def flat_start(frames: DataFrame, model: str, features: str, states: int = 3, components: int = 1, stay: float = 0.6) -> DataFrame:
    """A model for each name to begin training with: every state has the variances of all its frames and their means, which components
    beyond the first leave by up to half a deviation; a state stays with probability ``stay`` and else moves to the next."""
    x = frames.where(F.col(features).isNotNull() & F.col(model).isNotNull()).select(F.col(model).alias("model"), F.posexplode(features).alias("j", "v"))
    by = x.groupBy("model", "j").agg(F.avg("v").alias("m"), F.greatest(F.var_pop("v"), F.lit(FLOOR)).alias("s"))
    by = by.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("j", "m", "s"))).alias("r"))
    step = lambda c: 0.0 if components == 1 else c / (components - 1) - 0.5
    one = F.array(*(F.transform("r", lambda r, c=c: r["m"] + step(c) * F.sqrt(r["s"])) for c in range(components)))
    spread = F.array(*(F.col("r.s") for _ in range(components)))
    moves = [[stay if j == i and i < states - 1 else 1.0 - stay if j == i + 1 else 1.0 if j == i else 0.0 for j in range(states)] for i in range(states)]
    table = lambda rows: F.array(*(F.array(*(F.lit(float(v)) for v in r)) for r in rows))
    return by.select(
        "model", table([[1 / components] * components] * states).alias("weights"), F.array(*(one for _ in range(states))).alias("means"),
        F.array(*(spread for _ in range(states))).alias("variances"), table(moves).alias("transition"),
    )


def _rows(column: pa.Array, i: int) -> np.ndarray:
    """One sequence as a matrix."""
    row = column.slice(i, 1).flatten()
    return row.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(row), -1)


class _Held(OrderedDict):
    """The models that a task has met last, as arrays."""

    def of(self, batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
        name = batch.column("model")[i].as_py()
        if name not in self:
            found = [np.array(batch.column(p)[i].as_py(), np.float64) for p in PARTS]
            with np.errstate(divide="ignore"):
                self[name] = (*found[:3], np.log(found[3]))
            if len(self) > AT_ONCE:
                self.popitem(last=False)
        return self[name]


def _expected(pairs: DataFrame) -> DataFrame:
    """(model, sums): the numbers s0, s1, s2, moves, log likelihood and held-out log likelihood of all sequences of each model, in one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = _Held(), {}

        def sent() -> pa.RecordBatch:
            names = np.repeat(np.array(list(sums), object), [len(s) for s in sums.values()])
            at = np.concatenate([np.arange(len(s)) for s in sums.values()])
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(at, pa.int32()), pa.array(np.concatenate(list(sums.values())))], names=["model", "i", "s"])

        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column("model")[i].as_py()
                s0, s1, s2, moves, ll = chain_counts(_rows(batch.column("x"), i), *held.of(batch, i))
                found = np.concatenate([s0.ravel(), s1.ravel(), s2.ravel(), moves.ravel(), [ll, 0]])
                if batch.column("held")[i].as_py():
                    found = np.zeros(len(found))
                    found[-1] = ll
                if name not in sums and len(sums) >= AT_ONCE:
                    yield sent()
                    sums.clear()
                if np.isfinite(ll):
                    sums[name] = sums[name] + found if name in sums else found
                elif name not in sums:
                    sums[name] = np.zeros(len(found))
        if sums:
            yield sent()

    parts = pairs.select("model", "held", "x", *PARTS).mapInArrow(run, "model string, i int, s double")
    whole = parts.groupBy("model", "i").agg(F.sum("s").alias("s"))
    return whole.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("r")).select("model", F.col("r.s").alias("sums"))


_STATE = ", ".join(["model string", *(f"{p} {_TYPES[p]}" for p in PARTS), *(f"best_{p} {_TYPES[p]}" for p in PARTS), "value double", "stale int", "done boolean", f"trace {_TRACE}"])


def _moved(state: DataFrame, validates: bool, tolerance: float, patience: int) -> DataFrame:
    """Each model after its sums; one without any is done."""
    names = [f.split()[0] for f in _STATE.split(", ")]
    trace_type = pa.list_(pa.struct([("train", pa.float64()), ("held", pa.float64())]))

    def one(r: dict) -> dict:
        sums = r.pop("sums")
        if sums is None:
            return {**r, "done": True}
        weights, means, variances, transition = (np.array(r[p], np.float64) for p in PARTS)
        n, m, d = means.shape
        s0, s1, s2, moves, ll = np.split(np.array(sums), np.cumsum([n * m, n * m * d, n * m * d, n * n]))
        value, first = float(ll[1 if validates else 0]), not r["trace"]
        gain = np.inf if first else (value - r["value"]) / max(abs(r["value"]), 1e-12)
        r["trace"] = [*r["trace"], {"train": float(ll[0]), "held": float(ll[1])}]
        if first or value > r["value"]:
            r.update({f"best_{p}": r[p] for p in PARTS}, value=value)
        r["stale"] = r["stale"] + 1 if gain < tolerance else 0
        r["done"] = r["stale"] >= patience or not s0.any()
        if not r["done"]:
            s0, s1, s2, moves = s0.reshape(n, m), s1.reshape(n, m, d), s2.reshape(n, m, d), moves.reshape(n, n)
            used, state, left = (s0 > 1e-10)[:, :, None], s0.sum(axis=1, keepdims=True), moves.sum(axis=1, keepdims=True)
            safe = np.where(used, s0[:, :, None], 1)
            mean = s1 / safe
            r["means"], r["variances"] = np.where(used, mean, means).tolist(), np.where(used, np.maximum(s2 / safe - mean**2, FLOOR), variances).tolist()
            r["weights"] = np.where(state > 1e-10, s0 / np.where(state > 1e-10, state, 1), weights).tolist()
            r["transition"] = np.where(left > 1e-10, moves / np.where(left > 1e-10, left, 1), transition).tolist()
        return r

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                rows = [one(r) for r in batch.slice(k, AT_ONCE).to_pylist()]
                kinds = {"model": pa.string(), "value": pa.float64(), "stale": pa.int32(), "done": pa.bool_(), "trace": trace_type}
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c) or _ARROW[c.removeprefix("best_")]) for c in names], names=names)

    return state.select(*names, "sums").mapInArrow(run, _STATE)


def train(
    frames: DataFrame, models: DataFrame, model: str, keys: list[str], order: str, features: str, steps: int = 20, tolerance: float = 1e-4, patience: int = 2, held_out: int = 0,
) -> DataFrame:
    """(model, weights, means, variances, transition, log_likelihood, held_log_likelihood, steps, converged, trace) of each of ``models``, by Baum-Welch.

    ``model`` names the frames' column with the name of their model, by which they are joined. With ``held_out`` = k, a k-th of a model's sequences, by
    hash of their keys, only validates. Of each model the step of the best validation (else likelihood) is returned; it is done once ``patience`` steps
    improve it by less than ``tolerance`` of its size, and takes no further part. What counts nothing changes nothing: frames without features, sequences that
    no path fits, components without weight, states without moves. A model without sequences comes back as it was, without likelihoods."""
    held = F.pmod(F.xxhash64(*keys), F.lit(held_out)) == 0 if held_out else F.lit(False)
    x = kept(sequences(frames, model, keys, order, features).select(F.col("model").cast("string").alias("model"), held.alias("held"), "x"), "sequences")
    state = models.select(
        F.col("model").cast("string").alias("model"), *(F.col(p).cast(_TYPES[p]).alias(p) for p in PARTS), *(F.col(p).cast(_TYPES[p]).alias(f"best_{p}") for p in PARTS),
        F.lit(None).cast("double").alias("value"), F.lit(0).alias("stale"), F.lit(False).alias("done"), F.array().cast(_TRACE).alias("trace"),
    )
    state = kept(state, "models")
    for _ in range(steps):
        active = state.where("NOT done")
        sums = _expected(x.join(active.select("model", *PARTS), "model"))
        state = kept(_moved(active.join(sums, "model", "left"), bool(held_out), tolerance, patience).unionByName(state.where("done")), "models")
        if state.where("NOT done").isEmpty():
            break
    best = F.array_position(F.transform("trace", lambda t: t["held" if held_out else "train"]), F.col("value")).cast("int")
    at = F.when(best > 0, F.element_at("trace", F.greatest(best, F.lit(1))))
    return state.select(
        "model", *(F.col(f"best_{p}").alias(p) for p in PARTS), at["train"].alias("log_likelihood"), F.when(F.lit(bool(held_out)), at["held"]).alias("held_log_likelihood"),
        F.size("trace").alias("steps"), F.col("done").alias("converged"), "trace",
    )


def scored(frames: DataFrame, models: DataFrame, model: str, keys: list[str], order: str, features: str) -> DataFrame:
    """(model, keys, frames, log_likelihood) of each sequence under the model of its name; null where no path fits. Sequences without a model are left out."""
    x = sequences(frames, model, keys, order, features)
    kinds = dict(x.dtypes)
    pairs = x.withColumn("model", F.col("model").cast("string")).join(models.select(F.col("model").cast("string").alias("model"), *PARTS), "model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            found = [chain_counts(_rows(batch.column("x"), i), *held.of(batch, i))[4] for i in range(batch.num_rows)]
            lengths = pa.array([len(v) for v in batch.column("x")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("model"), *(batch.column(k) for k in keys), lengths, pa.array([float(v) if np.isfinite(v) else None for v in found], pa.float64())], names=["model", *keys, "frames", "log_likelihood"])

    return pairs.mapInArrow(run, ", ".join(["model string", *(f"{k} {kinds[k]}" for k in keys), "frames long", "log_likelihood double"]))


def evaluation(scores: DataFrame) -> DataFrame:
    """(model, sequences, impossible, frames, log_likelihood, per_frame) of each model that has scores."""
    fits = F.col("log_likelihood").isNotNull()
    x = scores.groupBy("model").agg(F.count("*").alias("sequences"), F.count_if(~fits).alias("impossible"), F.sum(F.when(fits, F.col("frames"))).alias("frames"), F.sum("log_likelihood").alias("log_likelihood"))
    return x.withColumn("per_frame", F.col("log_likelihood") / F.col("frames"))
