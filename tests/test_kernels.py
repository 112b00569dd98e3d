"""Kernels against enumeration and closed forms."""

import itertools

import numpy as np
import pytest

from seqloom.functions import signal
from seqloom.operators import kernels, statistics


def chain(seed, t, n):
    r = np.random.default_rng(seed)
    steps = np.triu(r.random((n, n)) + 0.1)
    return r.normal(size=(t, n)), np.log(steps / steps.sum(axis=1, keepdims=True), where=steps > 0, out=np.full((n, n), -np.inf))


def paths(emission, steps):
    t, n = emission.shape
    for path in itertools.product(range(n), repeat=t):
        if path[0] == 0 and path[-1] == n - 1:
            yield path, sum(emission[i, s] for i, s in enumerate(path)) + sum(steps[a, b] for a, b in itertools.pairwise(path))


@pytest.mark.parametrize("seed,t,n", [(1, 4, 2), (2, 5, 3), (3, 3, 3), (4, 1, 1)])
def test_chain_equals_enumeration(seed, t, n):
    emission, steps = chain(seed, t, n)
    every = list(paths(emission, steps))
    best, score = kernels.viterbi(emission, steps)
    want = max(every, key=lambda x: x[1])
    assert tuple(best) == want[0] and score == pytest.approx(want[1])
    gamma, total = kernels.forward_backward(emission, steps)
    assert total == pytest.approx(np.logaddexp.reduce([s for _, s in every]))
    for i in range(t):
        for k in range(n):
            assert gamma[i, k] == pytest.approx(sum(np.exp(s - total) for p, s in every if p[i] == k), abs=1e-9)


def test_short_sequence_ends_where_it_can():
    emission, steps = chain(5, 2, 4)
    steps[0, 2:] = -np.inf
    path, score = kernels.viterbi(emission, steps)
    assert path[-1] in (0, 1) and np.isfinite(score)


def test_mixture_follows_direct_em(spark):
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(-3, 1, (60, 2)), r.normal(3, 0.5, (40, 2))])
    order = r.permutation(100)
    rows = [(i, [float(v) for v in x[j]]) for i, j in enumerate(order)]
    df = spark.createDataFrame([*rows, (200, None)], "id long, x array<double>").repartition(4)
    w, m, v, trace = kernels.fit_mixture(df, "id", "x", 2, steps=6, tolerance=0)
    assert all(b >= a - 1e-9 for a, b in itertools.pairwise(trace))
    data = np.array([p for _, p in rows])
    weights, means, variances = np.full(2, 0.5), data[:2].copy(), np.ones((2, 2))
    for _ in range(6):
        g, _ = kernels.responsibilities(data, weights, means, variances)
        means = g.T @ data / g.sum(axis=0)[:, None]
        variances = np.stack([(g[:, k, None] * (data - means[k]) ** 2).sum(axis=0) / g[:, k].sum() for k in range(2)])
        weights = g.mean(axis=0)
    assert np.allclose(w, weights) and np.allclose(m, means) and np.allclose(v, variances)
    got = kernels.mixture_scores(df, "id", "x", w, m, v).collect()
    assert len(got) == 101 and [r for r in got if r.id == 200][0].component is None


def test_mixture_of_nothing(spark):
    df = spark.createDataFrame([], "id long, x array<double>")
    assert kernels.fit_mixture(df, "id", "x", 2)[3] == []
    assert kernels.choose_order(df, "id", "x", range(1, 3)) == []


def test_trajectory_is_the_likeliest():
    r = np.random.default_rng(9)
    means, variances, durations = r.normal(size=(3, 6)), r.random((3, 6)) + 0.1, np.array([3, 1, 4])
    best = kernels.trajectory(means, variances, durations)
    at = np.repeat(np.arange(3), durations)

    def cost(c):
        after, before = np.concatenate([c[1:], c[-1:]]), np.concatenate([c[:1], c[:-1]])
        obs = np.concatenate([c, 0.5 * (after - before), before - 2 * c + after], axis=1)
        return ((obs - means[at]) ** 2 / variances[at]).sum()

    assert best.shape == (8, 2)
    assert all(cost(best) <= cost(best + 0.05 * r.normal(size=best.shape)) for _ in range(200))
    assert np.allclose(kernels.trajectory(means[:1], variances[:1], np.array([1])), means[:1, :2])


def test_alignment_and_trajectories_run(spark):
    rows = [(u, i, [float(i // 2)]) for u in (1, 2) for i in range(6)]
    df = spark.createDataFrame([*rows, (1, 99, None)], "utt long, i int, x array<double>")
    steps = np.array([[0.5, 0.5, 0], [0, 0.5, 0.5], [0, 0, 1.0]])
    got = kernels.align(df, ["utt"], "i", "x", np.array([[0.0], [1.0], [2.0]]), np.full((3, 1), 0.05), steps)
    assert sorted((r.utt, r.i, r.state) for r in got.collect()) == [(u, i, i // 2) for u in (1, 2) for i in range(6)]
    found = kernels.boundaries(got, ["utt"], "i").where("utt = 1").collect()
    assert sorted((r.state, r["first"], r["last"], r.frames) for r in found) == [(0, 0, 1, 2), (1, 2, 3, 2), (2, 4, 5, 2)]
    states = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.0], [1.0, 1.0, 1.0], 3), (1, 1, [2.0, 0.0, 0.0], [1.0, 1.0, 1.0], 0)], "utt long, s int, mean array<double>, var array<double>, duration int")
    assert [round(r.c[0], 5) for r in kernels.trajectories(states, "utt", "s").orderBy("frame").collect()] == [1.0, 1.0, 1.0]


def dense_trajectory(means, variances, durations, ridge=1e-8):
    at = np.repeat(np.arange(len(durations)), durations)
    t, d = len(at), means.shape[1] // 3
    eye = np.eye(t)
    after, before = eye[np.minimum(np.arange(t) + 1, t - 1)], eye[np.maximum(np.arange(t) - 1, 0)]
    w = np.concatenate([eye, 0.5 * (after - before), before - 2 * eye + after])
    out = np.empty((t, d))
    for j in range(d):
        p, m = 1 / variances[at][:, j : 3 * d : d].T.ravel(), means[at][:, j : 3 * d : d].T.ravel()
        out[:, j] = np.linalg.solve((w.T * p) @ w + ridge * eye, (w.T * p) @ m)
    return out


def test_trajectories_by_stretches(spark):
    r = np.random.default_rng(4)
    utterances = {k: (r.normal(size=(n, 7)), r.uniform(0.05, 2, size=(n, 7)), r.integers(0, 5, size=n)) for k, n in (("a", 40), ("b", 1), ("c", 3), (None, 20))}
    utterances["d"] = (r.normal(size=(2, 7)), r.uniform(0.05, 2, size=(2, 7)), np.array([30, 2]))
    utterances["b"][2][:] = 1
    rows = [(k, i, [*map(float, m[i])], [*map(float, v[i])], int(n[i])) for k, (m, v, n) in utterances.items() for i in range(len(n))]
    states = spark.createDataFrame(rows, "utt string, s int, mean array<double>, var array<double>, duration int").repartition(3)
    for stretch in (4, 8, 31, 2048):
        got = {}
        for x in kernels.trajectories(states, "utt", "s", stretch=stretch).orderBy("frame").collect():
            got.setdefault(x.utt, []).append(x.c)
        for k, (m, v, n) in utterances.items():
            assert np.allclose(got.get(k, np.empty((0, 2))), dense_trajectory(m, v, n), atol=1e-9), (k, stretch)


def test_long_trajectory_fits():
    """A square matrix of its frames would take 80 GB."""
    n = 100_000
    path = kernels.trajectory(np.tile([2.0, 0.0, 0.0], (n, 1)), np.ones((n, 3)), np.ones(n, int))
    assert path.shape == (n, 1) and np.allclose(path, 2, atol=1e-6)


def test_kaiser_window(spark):
    got = spark.range(1).select(signal.window("kaiser", 32).alias("w")).first().w
    assert np.allclose(got, np.kaiser(32, 8.6), atol=1e-9)


def test_kmeans_follows_direct_rounds(spark):
    x = np.random.default_rng(3).normal(size=(60, 3)) + np.repeat([[0.0], [4.0], [8.0]], 20, axis=0)
    df = spark.createDataFrame([*((i, [float(v) for v in p]) for i, p in enumerate(x)), (99, None)], "id long, x array<double>").repartition(3)
    want = x[:3].copy()
    for _ in range(6):
        near = ((x[:, None] - want) ** 2).sum(axis=2).argmin(axis=1)
        want = np.array([x[near == k].mean(axis=0) if (near == k).any() else want[k] for k in range(3)])
    assert np.allclose(statistics.kmeans(df, "id", "x", 3, steps=6), want)
    assert statistics.kmeans(df.where("false"), "id", "x", 3) == []
