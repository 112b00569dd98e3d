"""Gaussian mixtures with full covariances: fitting, moments, weak components, validity, sampling.

Components are rows (mixture, component, weight, mean [d], covariance [d * d], by rows). Sums over points are added up in tasks, so what is shuffled is a
model's worth of numbers for each task; draws follow from a hash of seed and id, so no partitioning changes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from seqloom.operators.kernels import LOG_2PI

#: The least eigenvalue that a covariance keeps, and the least weight of a component that stays.
FLOOR, WEAK = 1e-6, 1e-3


def floored(covariance: np.ndarray, floor: float = FLOOR) -> np.ndarray:
    """The nearest symmetric matrix whose eigenvalues are at least ``floor``."""
    symmetric = (covariance + covariance.T) / 2
    values, vectors = np.linalg.eigh(symmetric)
    return symmetric if values[0] >= floor else (vectors * np.maximum(values, floor)) @ vectors.T


def log_density(x: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> np.ndarray:
    """Log density of rows (n, d) under each Gaussian (k, d) and (k, d, d), by Cholesky factors."""
    out = np.empty((len(x), len(means)))
    for k, (mean, covariance) in enumerate(zip(means, covariances, strict=True)):
        lower = np.linalg.cholesky(covariance)
        z = np.linalg.solve(lower, (x - mean).T)
        out[:, k] = -0.5 * ((z * z).sum(axis=0) + len(mean) * LOG_2PI) - np.log(np.diag(lower)).sum()
    return out


def posterior(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(component) of each row, and its log likelihood."""
    with np.errstate(divide="ignore"):
        joint = log_density(x, means, covariances) + np.log(weights)
    top = joint.max(axis=1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(joint - top).sum(axis=1))
    return np.exp(joint - total[:, None]), total


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _sums(points: DataFrame, features: str, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """For each component: the sum of its shares r, of r x, of r x x', and a k-th of the log likelihood."""
    k, d = model[1].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k, 1 + d + d * d + 1))
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                x = _matrix(batch.column(0).slice(i, 4096))
                r, ll = posterior(x, *model)
                out[:, 0] += r.sum(axis=0)
                out[:, 1 : d + 1] += r.T @ x
                for c in range(k):
                    out[c, d + 1 : -1] += ((x * r[:, c : c + 1]).T @ x).ravel()
                out[:, -1] += ll.sum() / k
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size), pa.int32()), pa.array(out.ravel())], names=["i", "s"])

    found = np.zeros(k * (d * d + d + 2))
    for r in points.where(F.col(features).isNotNull()).select(features).mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # one row for each number of the model
        found[r.i] = r.s
    return found.reshape(k, -1)


def strong(weights: np.ndarray, *parts: np.ndarray, least: float = WEAK) -> tuple[np.ndarray, ...]:
    """The components of at least that weight (at least the heaviest one), their weights adding up to 1."""
    stay = weights >= least
    stay[weights.argmax()] = True
    return (weights[stay] / weights[stay].sum(), *(p[stay] for p in parts))


def fit(points: DataFrame, point_id: str, features: str, k: int, steps: int = 10, tolerance: float = 1e-6, floor: float = FLOOR, least: float = WEAK) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """(weights, means, covariances, log likelihood before each step) by EM from the k points of smallest id and unit covariances.

    Eigenvalues are kept at ``floor`` or more; components that fall below the weight ``least`` go, and the others share theirs. Points without features are
    left out; without points there are no components."""
    first = points.where(F.col(features).isNotNull()).orderBy(point_id).limit(k).collect()  # k rows
    if not first:
        return np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0, 0)), []
    means = np.array([r[features] for r in first], np.float64)
    k, d = means.shape
    weights, covariances, trace = np.full(k, 1 / k), np.stack([np.eye(d)] * k), []
    for _ in range(steps):
        sums = _sums(points, features, (weights, means, covariances))
        trace.append(float(sums[:, -1].sum()))
        s0 = sums[:, 0]
        weights, sums = strong(s0 / s0.sum(), sums, least=least)
        means = sums[:, 1 : d + 1] / sums[:, :1]
        second = sums[:, d + 1 : -1].reshape(-1, d, d) / sums[:, 0, None, None]
        covariances = np.stack([floored(c - np.outer(m, m), floor) for c, m in zip(second, means, strict=True)])
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) <= tolerance * abs(trace[-2]):
            break
    return weights, means, covariances, trace


def components(points: DataFrame, mixture: str, component: str, features: str) -> DataFrame:
    """(mixture, component, weight, mean, covariance): one Gaussian for each component's points, weighted by their share of the mixture's.

    Points without features or of no mixture are left out; null is a component like others. A task adds up the points of each component that it meets (sorted by it, so it holds one at a time) and sends its sums once."""
    held = points.where(F.col(features).isNotNull() & F.col(mixture).isNotNull()).select(F.col(mixture).alias("mixture"), F.col(component).alias("component"), F.transform(features, lambda v: v.cast("double")).alias("x"))
    kinds = dict(held.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(key, s: np.ndarray) -> pa.RecordBatch:
            names = [pa.array([v] * len(s), t) for v, t in zip(key, kind, strict=True)]
            return pa.RecordBatch.from_arrays([*names, pa.array(np.arange(len(s)), pa.int32()), pa.array(s)], names=["mixture", "component", "i", "s"])

        now, total = None, None
        for batch in batches:
            kind = [batch.schema.field(0).type, batch.schema.field(1).type]
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at] and end - at < 4096:
                    end += 1
                x = _matrix(batch.column(2).slice(at, end - at))
                found = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                if now is not None and now == keys[at]:
                    total = total + found
                else:
                    if now is not None:
                        yield sent(now, total)
                    now, total = keys[at], found
                at = end
        if now is not None:
            yield sent(now, total)

    sums = held.sortWithinPartitions("mixture", "component").mapInArrow(run, f"mixture {kinds['mixture']}, component {kinds['component']}, i int, s double")
    whole = sums.groupBy("mixture", "component", "i").agg(F.sum("s").alias("s")).groupBy("mixture", "component").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("r"))
    # 1 + d + d * d numbers
    x = whole.select("mixture", "component", F.col("r.s").alias("s")).withColumn("d", F.floor((F.sqrt(F.lit(4.0) * F.size("s") - 3) - 1) / 2 + 0.25).cast("int"))
    x = x.withColumn("n", F.col("s")[0]).withColumn("mean", F.transform(F.slice("s", F.lit(2), F.col("d")), lambda v: v / F.col("n")))
    product = lambda i: F.col("mean")[F.floor(i / F.col("d")).cast("int")] * F.col("mean")[i % F.col("d")]
    x = x.withColumn("covariance", F.transform(F.slice("s", F.col("d") + 2, F.col("d") * F.col("d")), lambda v, i: v / F.col("n") - product(i)))
    totals = x.groupBy("mixture").agg(F.sum("n").alias("_all"))
    return x.join(totals, "mixture").select("mixture", "component", (F.col("n") / F.col("_all")).alias("weight"), "mean", "covariance")


def moments(parts: DataFrame) -> DataFrame:
    """(mixture, i, j, mean_i, mean_j, covariance) of whole mixtures, by sums over their components; weights need not add up to 1.

    A mixture's covariance is the mean of its components' and that of their means' products, less the product of its means."""
    d = F.size("mean")
    cells = parts.select("mixture", "weight", "mean", F.posexplode("covariance").alias("at", "c"))
    cells = cells.select("mixture", "weight", F.floor(F.col("at") / d).cast("int").alias("i"), (F.col("at") % d).alias("j"), "mean", "c")
    a, b, w = F.col("mean")[F.col("i")], F.col("mean")[F.col("j")], F.col("weight")
    x = cells.groupBy("mixture", "i", "j").agg(F.sum(w).alias("w"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * (F.col("c") + a * b)).alias("ab"))
    mean_i, mean_j = F.col("a") / F.col("w"), F.col("b") / F.col("w")
    return x.select("mixture", "i", "j", mean_i.alias("mean_i"), mean_j.alias("mean_j"), (F.col("ab") / F.col("w") - mean_i * mean_j).alias("covariance"))


def factored(parts: DataFrame, floor: float | None = None) -> DataFrame:
    """parts with ``factor`` (the lower Cholesky factor, by rows) and ``issue``: what is wrong with a component, or null.

    Issues are a weight that is missing, negative or not finite, numbers that are not, a covariance of another size, not symmetric, or not positive definite; a factor is there
    where the covariance allows it. With ``floor`` eigenvalues are raised to it first, so that symmetric covariances always have one."""
    names = parts.columns
    schema = StructType([*parts.schema, StructField("factor", ArrayType(DoubleType())), StructField("issue", StringType())])

    def one(weight, mean, covariance) -> tuple[list | None, str | None]:
        if weight is None or not np.isfinite(weight) or weight < 0:
            return None, "weight"
        if mean is None or covariance is None or len(covariance) != len(mean) ** 2:
            return None, "size"
        m, c = np.array(mean, np.float64), np.array(covariance, np.float64).reshape(len(mean), -1)
        if not (np.isfinite(m).all() and np.isfinite(c).all()):
            return None, "not finite"
        if not np.allclose(c, c.T, rtol=1e-9, atol=1e-12):
            return None, "not symmetric"
        try:
            return np.linalg.cholesky(c if floor is None else floored(c, floor)).ravel().tolist(), None
        except np.linalg.LinAlgError:
            return None, "not positive definite"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(*(batch.column(c)[i].as_py() for c in ("weight", "mean", "covariance"))) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f for f, _ in found], pa.list_(pa.float64())), pa.array([e for _, e in found], pa.string())], names=[*names, "factor", "issue"])

    return parts.mapInArrow(run, schema)


def validity(parts: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(mixture, components, broken, weight, valid): valid mixtures have components, none of them broken, and weights that add up to 1."""
    x = factored(parts).groupBy("mixture").agg(F.count("*").alias("components"), F.count("issue").alias("broken"), F.sum("weight").alias("weight"))
    return x.withColumn("valid", (F.col("broken") == 0) & F.coalesce(F.abs(F.col("weight") - 1) <= tolerance, F.lit(False)))


def pruned(parts: DataFrame, least: float = WEAK) -> DataFrame:
    """parts without the components under that share of their mixture's weight; the rest share it."""
    total = parts.groupBy("mixture").agg(F.sum("weight").alias("_all"))
    x = parts.join(total, "mixture").where(F.col("weight") >= least * F.col("_all")).drop("_all")
    rest = x.groupBy("mixture").agg(F.sum("weight").alias("_left"))
    return x.join(rest, "mixture").withColumn("weight", F.col("weight") / F.col("_left")).drop("_left").select(*parts.columns)


def uniform(seed: int, key: Column, k: Column) -> Column:
    """A number between 0 and 1 that depends on nothing but seed, key and k: 52 bits of a SHA-256."""
    bits = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string"), k.cast("string")), 256), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def normal(seed: int, key: Column, k: Column) -> Column:
    """A standard normal number, by the Box-Muller transform; even and odd k make a pair."""
    pair = F.floor(k / 2) * 2
    radius, angle = F.sqrt(-2 * F.ln(uniform(seed, key, pair + 1))), 2 * F.pi() * uniform(seed, key, pair + 2)
    return radius * F.when(k % 2 == 0, F.cos(angle)).otherwise(F.sin(angle))


def sampled(draws: DataFrame, parts: DataFrame, seed: int = 0, floor: float | None = None) -> DataFrame:
    """(id, mixture, component, x) for each row (id, mixture) of draws whose mixture has components with a factor.

    A component is taken by its share of the weight, in the order of components; then x = mean + factor z with standard normal z. A mixture's components travel with
    its draws as one array, so they should be as few as a model's are. Equal ids of a mixture are drawn alike."""
    ok = factored(parts, floor).where("issue IS NULL AND weight > 0").groupBy("mixture").agg(F.array_sort(F.collect_list(F.struct("component", "weight", "mean", "factor"))).alias("c"))
    total = F.aggregate("c.weight", F.lit(0.0), lambda s, w: s + w)
    x = draws.select("id", "mixture").join(ok, "mixture").withColumn("u", uniform(seed, F.col("id"), F.lit(0)) * total)
    upto = F.transform("c", lambda c, i: F.struct(F.aggregate(F.slice("c.weight", F.lit(1), i + 1), F.lit(0.0), lambda s, w: s + w).alias("upto"), c.alias("c")))
    x = x.withColumn("t", F.coalesce(F.filter(upto, lambda t: t["upto"] > F.col("u"))[0]["c"], F.element_at("c", -1)))
    x = x.select("id", "mixture", "t.component", "t.mean", "t.factor", F.size("t.mean").alias("d"))
    x = x.withColumn("z", F.transform(F.sequence(F.lit(0), F.col("d") - 1), lambda k: normal(seed, F.col("id"), k)))
    row = lambda i: F.aggregate(F.zip_with(F.slice("factor", i * F.col("d") + 1, i + 1), F.slice("z", F.lit(1), i + 1), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return x.select("id", "mixture", "component", F.transform("mean", lambda m, i: m + row(i)).alias("x"))
