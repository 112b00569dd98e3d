"""Models over sequences: Gaussian mixtures, hidden Markov chains, trajectories.

Mixtures are fitted by distributed sums: a pass adds up moments for each component, so nothing is gathered but the model. Chains need
a whole sequence; one utterance, bounded by its own length, meets in one task. Trajectories are solved in stretches of frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

FLOOR = 1e-6
LOG_2PI = float(np.log(2 * np.pi))


def log_sum_exp(values: str) -> str:
    """SQL for ln(sum(exp(x))) of an array without overflow; -infinity for an empty one."""
    top = f"array_max({values})"
    return f"CASE WHEN size({values}) = 0 OR {top} = double('-infinity') THEN double('-infinity') ELSE {top} + ln(aggregate({values}, 0D, (total_, each_) -> total_ + exp(each_ - {top}))) END"


def log_density(x: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """Log density of rows (n, d) under each diagonal Gaussian (k, d)."""
    variances = np.maximum(variances, FLOOR)
    away = ((x[:, None, :] - means[None]) ** 2 / variances[None]).sum(axis=2)
    return -0.5 * (away + np.log(variances).sum(axis=1) + x.shape[1] * LOG_2PI)


def responsibilities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each component, and each row's log likelihood."""
    with np.errstate(divide="ignore"):
        joint = log_density(x, means, variances) + np.log(weights)
    top = joint.max(axis=1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(joint - top).sum(axis=1))
    return np.exp(joint - total[:, None]), total


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _moments(points: DataFrame, features: str, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Sums over all rows of r, r x and r x^2 by component, and the log likelihood; each task sends one row a component."""
    k, d = means.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s0, s1, s2, total = np.zeros(k), np.zeros((k, d)), np.zeros((k, d)), 0.0
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                x = _matrix(batch.column(0).slice(i, 4096))
                r, ll = responsibilities(x, weights, means, variances)
                s0, s1, s2, total = s0 + r.sum(axis=0), s1 + r.T @ x, s2 + r.T @ (x * x), total + float(ll.sum())
        flat = np.concatenate([s0[:, None], s1, s2, np.full((k, 1), total / k)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), flat.shape[1]), pa.int32()), pa.array(np.tile(np.arange(flat.shape[1]), k), pa.int32()), pa.array(flat.ravel())], names=["k", "j", "s"])

    rows = points.where(F.col(features).isNotNull()).select(features).mapInArrow(run, "k int, j int, s double").groupBy("k", "j").agg(F.sum("s").alias("s")).collect()  # k * (2 d + 2)
    out = np.zeros((k, 2 * d + 2))
    for r in rows:
        out[r.k, r.j] = r.s
    return out[:, 0], out[:, 1 : d + 1], out[:, d + 1 : -1], float(out[:, -1].sum())


def fit_mixture(points: DataFrame, point_id: str, features: str, k: int, steps: int = 10, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """(weights, means, variances, log likelihood before each step) of a diagonal mixture by EM, from the k rows of smallest id.

    An empty component keeps its mean and variance and gets the weight 0. With fewer than k rows there are as many components as rows."""
    first = points.where(F.col(features).isNotNull()).orderBy(point_id).limit(k).collect()  # k rows
    if not first:
        return np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0)), []
    means = np.array([r[features] for r in first], np.float64)
    k = len(means)
    weights, variances = np.full(k, 1 / k), np.ones_like(means)
    trace: list[float] = []
    for _ in range(steps):
        s0, s1, s2, ll = _moments(points, features, weights, means, variances)
        trace.append(ll)
        held = s0 > 1e-10
        safe = np.where(held, s0, 1)[:, None]
        mean = s1 / safe
        means, variances = np.where(held[:, None], mean, means), np.where(held[:, None], np.maximum(s2 / safe - mean**2, FLOOR), variances)
        weights = np.where(held, s0, 0) / s0.sum()
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) <= tolerance * abs(trace[-2]):
            break
    return weights, means, variances, trace


def mixture_scores(points: DataFrame, point_id: str, features: str, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> DataFrame:
    """(id, component, log_likelihood): the likeliest component (the first of equals); null features give nulls."""
    schema = points.select(F.col(point_id).alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            best, ll = np.zeros(len(held), np.int32), np.zeros(len(held))
            if held.any():
                r, ll[held] = responsibilities(_matrix(batch.column(1).drop_null()), weights, means, variances)
                best[held] = r.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, mask=~held), pa.array(ll, mask=~held)], names=["id", "component", "log_likelihood"])

    return points.select(F.col(point_id).alias("id"), features).mapInArrow(run, f"id {schema.dtypes[0][1]}, component int, log_likelihood double")


def posteriors(points: DataFrame, point_id: str, features: str, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> DataFrame:
    """(point_id, posterior, log_likelihood): P(component) of each point; null features give nulls."""
    kind = dict(points.dtypes)[point_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            out, ll = np.zeros((len(held), len(weights))), np.zeros(len(held))
            if held.any():
                out[held], ll[held] = responsibilities(_matrix(batch.column(1).drop_null()), weights, means, variances)
            rows = [r if h else None for r, h in zip(out, held.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64())), pa.array(ll, mask=~held)], names=[point_id, "posterior", "log_likelihood"])

    return points.select(point_id, features).mapInArrow(run, f"{point_id} {kind}, posterior array<double>, log_likelihood double")


def information(log_likelihood: float, rows: int, components: int, dims: int) -> tuple[float, float]:
    """AIC and BIC of a diagonal mixture."""
    free = components - 1 + 2 * components * dims
    return 2 * free - 2 * log_likelihood, free * float(np.log(max(rows, 1))) - 2 * log_likelihood


def choose_order(points: DataFrame, point_id: str, features: str, orders: range = range(1, 9), steps: int = 10) -> list[tuple[int, float, float]]:
    """(k, aic, bic) for each number of components; the best is the row of the smallest bic."""
    n = points.where(F.col(features).isNotNull()).count()
    out = []
    for k in orders:
        _, means, _, trace = fit_mixture(points, point_id, features, k, steps)
        if trace:
            out.append((k, *information(trace[-1], n, len(means), means.shape[1])))
    return out


def viterbi(emission: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, float]:
    """The likeliest path from the first state to the last and its log score; emission (t, n) and transition (n, n) are logarithms.

    A sequence too short to reach the last state ends in the best state that it reaches; ties go to the smaller state."""
    t, n = emission.shape
    score, back = np.full((t, n), -np.inf), np.zeros((t, n), np.int64)
    score[0, 0] = emission[0, 0]
    for i in range(1, t):
        step = score[i - 1][:, None] + transition
        back[i] = step.argmax(axis=0)
        score[i] = step[back[i], np.arange(n)] + emission[i]
    end = n - 1 if np.isfinite(score[-1, n - 1]) else int(score[-1].argmax())
    path = np.empty(t, np.int64)
    path[-1] = end
    for i in range(t - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path, float(score[-1, end])


def forward_backward(emission: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, float]:
    """State posteriors of each frame and the log likelihood, over paths from the first state to the last."""
    t, n = emission.shape
    a, b = np.full((t, n), -np.inf), np.full((t, n), -np.inf)
    a[0, 0], b[-1, n - 1] = emission[0, 0], 0.0
    for i in range(1, t):
        a[i] = np.logaddexp.reduce(a[i - 1][:, None] + transition, axis=0) + emission[i]
    for i in range(t - 2, -1, -1):
        b[i] = np.logaddexp.reduce(transition + (emission[i + 1] + b[i + 1])[None], axis=1)
    total = float(a[-1, n - 1])
    return (np.exp(a + b - total) if np.isfinite(total) else np.zeros((t, n))), total


def align(frames: DataFrame, keys: list[str], order: str, features: str, means: np.ndarray, variances: np.ndarray, transition: np.ndarray) -> DataFrame:
    """(keys, order, state, posterior) of each frame by forced alignment with a chain of diagonal Gaussian states.

    A sequence meets in one task, which its own length bounds; frames without features are left out."""
    schema = frames.select(*keys, order).schema.add("state", IntegerType()).add("posterior", DoubleType())
    with np.errstate(divide="ignore"):
        steps = np.log(transition)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        emission = log_density(_matrix(table.column(features).combine_chunks()), means, variances)
        path, _ = viterbi(emission, steps)
        gamma, _ = forward_backward(emission, steps)
        out = table.select([*keys, order]).append_column("state", pa.array(path, pa.int32()))
        return out.append_column("posterior", pa.array(gamma[np.arange(len(path)), path]))

    return frames.where(F.col(features).isNotNull()).select(*keys, order, features).groupBy(*keys).applyInArrow(run, schema)


def align_within(frames: DataFrame, keys: list[str], order: str, features: str, windows: str, means: np.ndarray, variances: np.ndarray, transition: np.ndarray) -> DataFrame:
    """(keys, order, state): the likeliest path whose states stay inside their windows.

    ``windows`` is an array of (state, first, last), the same in all rows of a sequence; positions count from 0 and a state without a window
    may stand anywhere. Where no path from the first state to the last fits, all states are null."""
    schema = frames.select(*keys, order).schema.add("state", IntegerType())
    with np.errstate(divide="ignore"):
        steps = np.log(transition)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        emission = log_density(_matrix(table.column(features).combine_chunks()), means, variances)
        at = np.arange(len(emission))
        for w in table.column(windows)[0].as_py() or []:
            emission[(at < w["first"]) | (at > w["last"]), w["state"]] = -np.inf
        path, score = viterbi(emission, steps)
        fits = np.isfinite(score) and path[-1] == len(means) - 1
        return table.select([*keys, order]).append_column("state", pa.array(path, pa.int32(), mask=np.full(len(path), not fits)))

    return frames.where(F.col(features).isNotNull()).select(*keys, order, features, windows).groupBy(*keys).applyInArrow(run, schema)


def chain_counts(x: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of one sequence (t, d) under a chain of n states with m Gaussians each: s0 (n, m), s1 and s2 (n, m, d), moves (n, n),
    and the log likelihood. A sequence that no path fits counts nothing and has the log likelihood -infinity."""
    n, m, d = means.shape
    with np.errstate(divide="ignore"):
        joint = log_density(x, means.reshape(n * m, d), variances.reshape(n * m, d)).reshape(len(x), n, m) + np.log(weights)
    emission = np.logaddexp.reduce(joint, axis=2)
    t = len(x)
    a, b = np.full((t, n), -np.inf), np.full((t, n), -np.inf)
    a[0, 0], b[-1, n - 1] = emission[0, 0], 0.0
    for i in range(1, t):
        a[i] = np.logaddexp.reduce(a[i - 1][:, None] + steps, axis=0) + emission[i]
    for i in range(t - 2, -1, -1):
        b[i] = np.logaddexp.reduce(steps + (emission[i + 1] + b[i + 1])[None], axis=1)
    total = float(a[-1, n - 1])
    if not np.isfinite(total):
        return np.zeros((n, m)), np.zeros((n, m, d)), np.zeros((n, m, d)), np.zeros((n, n)), -np.inf
    shares = np.exp(joint - emission[:, :, None] + (a + b - total)[:, :, None])
    moves = np.exp(a[:-1, :, None] + steps[None] + (emission[1:] + b[1:])[:, None, :] - total).sum(axis=0) if t > 1 else np.zeros((n, n))
    return shares.sum(axis=0), np.einsum("tnm,td->nmd", shares, x), np.einsum("tnm,td->nmd", shares, x * x), moves, total


def train_chain(
    frames: DataFrame, keys: list[str], order: str, features: str, weights: np.ndarray, means: np.ndarray, variances: np.ndarray, transition: np.ndarray,
    steps: int = 20, tolerance: float = 1e-4, patience: int = 2, held_out: int = 0,
) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[tuple[float, float]]]:
    """Baum-Welch over all sequences: ((weights, means, variances, transition), [(log likelihood, held-out log likelihood) of each step]).

    Each step is one pass; a task adds up the counts of its sequences and sends one row a number, so only a model's worth of sums comes
    back. With ``held_out`` = k, a k-th of the sequences, by hash of their keys, only validates; the model of the best validation is
    returned (else of the best likelihood), and training ends once ``patience`` steps improve it by less than ``tolerance`` of its size.
    Frames without features are left out; sequences too short to reach the last state count nothing. A component that nothing uses keeps
    its values; a state without moves keeps its transitions. Without any sequence the model comes back as it was."""
    n, m, d = means.shape
    size = n * m * (2 * d + 1) + n * n + 2
    rows = frames.where(F.col(features).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(features).alias("x")))).alias("f"))
    held = F.pmod(F.xxhash64(*keys), F.lit(held_out)) == 0 if held_out else F.lit(False)
    sequences = rows.select(held.alias("held"), F.col("f.x").alias("x")).persist()
    best, best_value, stale, trace = (weights, means, variances, transition), -np.inf, 0, []
    try:
        for _ in range(steps):
            model = (weights, means, variances, transition)

            def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
                w, mu, var, move = model
                with np.errstate(divide="ignore"):
                    logs = np.log(move)
                sums = np.zeros(size)
                for batch in batches:
                    for is_held, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                        s0, s1, s2, moves, ll = chain_counts(np.array(x.as_py(), np.float64), w, mu, var, logs)
                        if np.isfinite(ll):
                            sums += np.concatenate([np.zeros(size - 2), [0, ll]]) if is_held else np.concatenate([s0.ravel(), s1.ravel(), s2.ravel(), moves.ravel(), [ll, 0]])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(sums)], names=["i", "s"])

            sums = np.zeros(size)
            for r in sequences.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # one row for each number of the model
                sums[r.i] = r.s
            s0, s1, s2, moves = np.split(sums[:-2], np.cumsum([n * m, n * m * d, n * m * d]))
            trace.append((float(sums[-2]), float(sums[-1])))
            value = trace[-1][1 if held_out else 0]
            gain = np.inf if len(trace) == 1 else (value - best_value) / max(abs(best_value), 1e-12)
            if value > best_value:
                best, best_value = model, value
            stale = stale + 1 if gain < tolerance else 0
            if stale >= patience or not s0.any():
                break
            s0, s1, s2, moves = s0.reshape(n, m), s1.reshape(n, m, d), s2.reshape(n, m, d), moves.reshape(n, n)
            used = (s0 > 1e-10)[:, :, None]
            safe = np.where(used, s0[:, :, None], 1)
            mean = s1 / safe
            means, variances = np.where(used, mean, means), np.where(used, np.maximum(s2 / safe - mean**2, FLOOR), variances)
            state = s0.sum(axis=1, keepdims=True)
            weights = np.where(state > 1e-10, s0 / np.where(state > 1e-10, state, 1), weights)
            left = moves.sum(axis=1, keepdims=True)
            transition = np.where(left > 1e-10, moves / np.where(left > 1e-10, left, 1), transition)
    finally:
        sequences.unpersist()
    return best, trace


def boundaries(states: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, state, first, last, frames) of the states that a path visits; a left-to-right path visits each once."""
    return states.groupBy(*keys, "state").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("frames"))


#: Frames of a stretch of a trajectory.
STRETCH = 2048
#: What frames before, at and after each frame are to its value, difference and second difference.
_TAPS = np.array([[0.0, 1.0, 0.0], [-0.5, 0.0, 0.5], [1.0, -2.0, 1.0]])


def _banded(diagonal: np.ndarray, next1: np.ndarray, next2: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions (n, d, m) of d symmetric systems with two bands, (n, d) each, for m right sides."""
    n = len(diagonal)
    e, l1, l2, x = diagonal.copy(), next1.copy(), next2.copy(), right.copy()
    for i in range(n):
        if i > 0:
            e[i] -= e[i - 1] * l1[i - 1] ** 2
            l1[i] -= l2[i - 1] * e[i - 1] * l1[i - 1]
            x[i] -= l1[i - 1, :, None] * x[i - 1]
        if i > 1:
            e[i] -= e[i - 2] * l2[i - 2] ** 2
            x[i] -= l2[i - 2, :, None] * x[i - 2]
        l1[i] /= e[i]
        l2[i] /= e[i]
    x /= e[:, :, None]
    for i in range(n - 2, -1, -1):
        x[i] -= l1[i, :, None] * x[i + 1]
        if i + 2 < n:
            x[i] -= l2[i, :, None] * x[i + 2]
    return x


class _Stretch:
    """Equations of frames [first, first + len) of ``total``: their observations and the nodes (frames) that these touch.

    Its last two nodes, unless it ends the utterance, and the last two of the stretch before are shared; the others are its own."""

    def __init__(self, means: np.ndarray, variances: np.ndarray, first: int, low: int, high: int, total: int, left: bool, right: bool, ridge: float):
        u, d = len(means), means.shape[1] // 3
        shape = (u, 3, d)
        mean, p = means[:, : 3 * d].reshape(shape), 1 / np.maximum(variances[:, : 3 * d].reshape(shape), FLOOR)
        taps = np.repeat(_TAPS[None], u, axis=0)
        if first == 0:
            taps[0, :, 1] += taps[0, :, 0]
            taps[0, :, 0] = 0
        if first + u == total:
            taps[-1, :, 1] += taps[-1, :, 2]
            taps[-1, :, 2] = 0
        # one node more on either side, which stays empty
        n = high - low + 2
        bands, b = np.zeros((3, n, d)), np.zeros((n, d))
        at = first - low  # of the node before the first frame
        for i in range(3):
            b[at + i : at + i + u] += np.einsum("urd,ur->ud", p * mean, taps[:, :, i])
            for j in range(i, 3):
                bands[j - i, at + i : at + i + u] += np.einsum("urd,ur->ud", p, taps[:, :, i] * taps[:, :, j])
        self.bands, self.b, self.d = bands[:, 1:-1], b[1:-1], d
        self.l, self.r = 2 * left, 2 * right
        self.bands[0, self.l :] += ridge
        self.n = high - low
        self.own = slice(self.l, self.n - self.r)

    def _across(self) -> np.ndarray:
        """(own, d, shared): what own nodes have to do with shared ones."""
        n = self.n - self.l - self.r
        out = np.zeros((n, self.d, self.l + self.r))
        shared = [*range(self.l), *range(self.n - self.r, self.n)]
        for k, s in enumerate(shared):
            for gap in (1, 2):
                for i in (s - gap, s + gap):
                    if 0 <= i - self.l < n:
                        out[i - self.l, :, k] = self.bands[gap, min(i, s)]
        return out

    def reduced(self) -> tuple[np.ndarray, np.ndarray]:
        """(d, shared, shared) and (d, shared): the equations of the shared nodes once the own ones are eliminated."""
        shared = [*range(self.l), *range(self.n - self.r, self.n)]
        across = self._across()
        x = _banded(*self.bands[:, self.own], np.concatenate([self.b[self.own, :, None], across], axis=2))
        g, a = np.stack([self.b[s] for s in shared], axis=1), np.zeros((self.d, len(shared), len(shared)))
        for k, s in enumerate(shared):
            a[:, k, k] = self.bands[0, s]
            for m, v in enumerate(shared):
                if 0 < v - s <= 2:
                    a[:, k, m] = a[:, m, k] = self.bands[v - s, s]
        return a - np.einsum("nds,ndt->dst", across, x[:, :, 1:]), g - np.einsum("nds,nd->ds", across, x[:, :, 0])

    def solved(self, shared: np.ndarray) -> np.ndarray:
        """(own, d) when the shared nodes are (shared, d)."""
        b = self.b[self.own] - np.einsum("nds,sd->nd", self._across(), shared)
        return _banded(*self.bands[:, self.own], b[:, :, None])[:, :, 0]


def trajectory(means: np.ndarray, variances: np.ndarray, durations: np.ndarray, ridge: float = 1e-8) -> np.ndarray:
    """The static path (t, d) that is likeliest under Gaussians over statics, differences and second differences.

    means and variances are (states, 3 d); differences are 0.5 (x[t+1] - x[t-1]), second ones x[t-1] - 2 x[t] + x[t+1], edges repeated."""
    at = np.repeat(np.arange(len(durations)), durations)
    t, d = len(at), means.shape[1] // 3
    return _Stretch(means[at], variances[at], 0, 0, t, t, False, False, ridge).solved(np.zeros((0, d))) if t else np.empty((0, d))


def _bound(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """(k, 2, d): the nodes that each stretch k shares with the next, from the reduced equations of all stretches in order."""
    n, d = len(parts) - 1, len(parts[0][1])
    diagonal, after, right = np.zeros((n, d, 2, 2)), np.zeros((n, d, 2, 2)), np.zeros((n, d, 2))
    for k, (_, a, g) in enumerate(parts):
        left = 2 if k else 0
        if k:
            diagonal[k - 1] += a[:, :2, :2]
            right[k - 1] += g[:, :2]
        if k < n:
            diagonal[k] += a[:, left:, left:]
            right[k] += g[:, left:]
            if k:
                after[k - 1] = a[:, :2, 2:]
    for k in range(1, n):
        f = np.linalg.solve(diagonal[k - 1], after[k - 1]).transpose(0, 2, 1)
        diagonal[k] -= f @ after[k - 1]
        right[k] -= (f @ right[k - 1][:, :, None])[:, :, 0]
    x = np.zeros((n, d, 2))
    for k in range(n - 1, -1, -1):
        b = right[k] - ((after[k] @ x[k + 1][:, :, None])[:, :, 0] if k + 1 < n else 0)
        x[k] = np.linalg.solve(diagonal[k], b[:, :, None])[:, :, 0]
    return x.transpose(0, 2, 1)


def trajectories(states: DataFrame, key: str, order: str, mean: str = "mean", variance: str = "var", duration: str = "duration", stretch: int = STRETCH, ridge: float = 1e-8) -> DataFrame:
    """(key, frame, c) for each utterance's states; durations below 1 are left out.

    Frames are solved in stretches of ``stretch``, each in a task of its own: first what a stretch says of the two frames that it shares with either
    neighbour, then those frames for the whole utterance (a few numbers a stretch meet in one task), then the frames between. It is the exact solution."""
    whole = Window.partitionBy("k")
    x = states.where(F.col(duration) >= 1).select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(mean).alias("m"), F.col(variance).alias("v"), F.col(duration).cast("long").alias("n"))
    x = x.select("k", "m", "v", F.sum("n").over(whole.orderBy("o").rowsBetween(Window.unboundedPreceding, 0)).alias("to"), "n", F.sum("n").over(whole).alias("total"))
    x = x.withColumn("from", F.col("to") - F.col("n"))
    last = F.expr(f"(total - 1) div {stretch}")
    of = lambda frame: F.least((F.expr(f"({frame}) div {stretch}")), last)
    x = x.withColumn("s", F.explode(F.sequence(of("from + 1"), of("to")))).select("k", "s", "from", "to", "total", "m", "v")

    def read(table: pa.Table) -> tuple[_Stretch, int, int]:
        table = table.sort_by("from")
        s, total = table.column("s")[0].as_py(), table.column("total")[0].as_py()
        ends = (total - 1) // stretch == s
        first, until = max(s * stretch - 1, 0), total if ends else (s + 1) * stretch - 1
        begin, end = (np.clip(table.column(c).to_numpy(), first, until) for c in ("from", "to"))
        at = np.repeat(np.arange(table.num_rows), end - begin)
        m, v = (_matrix(table.column(c).combine_chunks())[at] for c in ("m", "v"))
        low, high = max(s * stretch - 2, 0), total if ends else (s + 1) * stretch
        return _Stretch(m, v, first, low, high, total, s > 0, not ends, ridge), s, low

    kind = states.schema[key].dataType
    lists = ArrayType(DoubleType())
    same = lambda table, n: pa.array([table.column("k")[0].as_py()] * n, table.schema.field("k").type)

    def reduce(table: pa.Table) -> pa.Table:
        one, s, _ = read(table)
        a, g = one.reduced()
        return pa.table({"k": same(table, 1), "s": pa.array([s], pa.int64()), "a": pa.array([a.ravel().tolist()], pa.list_(pa.float64())), "g": pa.array([g.ravel().tolist()], pa.list_(pa.float64()))})

    def bind(table: pa.Table) -> pa.Table:
        table = table.sort_by("s")
        parts = []
        for i, (a, g) in enumerate(zip(table.column("a").to_pylist(), table.column("g").to_pylist(), strict=True)):
            n = 2 if i in (0, table.num_rows - 1) else 4
            parts.append((i, np.array(a).reshape(-1, n, n), np.array(g).reshape(-1, n)))
        x = _bound(parts)
        near = [np.concatenate(x[max(i - 1, 0) : i + 1]).ravel().tolist() for i in range(len(parts))]
        return pa.table({"k": same(table, len(parts)), "s": table.column("s"), "x": pa.array(near, pa.list_(pa.float64()))})

    def solve(table: pa.Table, bounds: pa.Table) -> pa.Table:
        one, _, low = read(table)
        shared = np.array(bounds.column("x")[0].as_py()).reshape(-1, one.d) if bounds.num_rows else np.zeros((0, one.d))
        path = np.concatenate([one.solved(shared), shared[one.l :]])
        frames = np.arange(low + one.l, low + one.l + len(path))
        c = pa.ListArray.from_arrays(pa.array(np.arange(len(path) + 1) * one.d, pa.int32()), pa.array(path.ravel()))
        return pa.table({key: same(table, len(path)), "frame": pa.array(frames, pa.int32()), "c": c})

    row = StructType([StructField("k", kind), StructField("s", LongType())])
    several = x.where(F.col("total") > stretch).groupBy("k", "s").applyInArrow(reduce, StructType([*row, StructField("a", lists), StructField("g", lists)]))
    bounds = several.groupBy("k").applyInArrow(bind, StructType([*row, StructField("x", lists)]))
    out = StructType([StructField(key, kind), StructField("frame", IntegerType()), StructField("c", lists)])
    return x.groupBy("k", "s").cogroup(bounds.groupBy("k", "s")).applyInArrow(solve, out)
