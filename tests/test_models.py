"""Chains trained together, full mixtures, spans of any length: against one at a time, numpy and all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import chains, kernels, mixtures, statistics, temporal

FRAMES = "model string, take int, i int, x array<double>"


def speech(spark, seed=1):
    """Three models of sequences whose level rises, at their own rates."""
    r = np.random.default_rng(seed)
    rows = [(m, t, i, [float(k * (i // 3) + r.normal(0, 0.3)), float(r.normal())]) for k, m in enumerate("abc") for t in range(6 + k) for i in range(9)]
    return spark.createDataFrame([*rows, ("a", 0, 99, None), (None, 1, 1, [0.0, 0.0]), ("b", 77, 0, [1.0, 1.0])], FRAMES).repartition(5)


@pytest.mark.parametrize("held_out", [0, 3])
def test_chains_together_equal_each_alone(spark, held_out):
    x = speech(spark)
    start = chains.flat_start(x, "model", "x", 3, 2)
    given = {r.model: r for r in start.collect()}
    got = {r.model: r for r in chains.train(x, start, "model", ["take"], "i", "x", steps=5, held_out=held_out).collect()}
    assert set(got) == {"a", "b", "c"}
    for name, r in got.items():
        first = [np.array(given[name][p]) for p in chains.PARTS]
        best, trace = kernels.train_chain(x.where(F.col("model") == name), ["take"], "i", "x", *first, steps=5, held_out=held_out)
        assert r.steps == len(trace) and np.allclose([tuple(t) for t in r.trace], trace)
        assert all(np.allclose(r[p], b) for p, b in zip(chains.PARTS, best, strict=True))
        top = max(range(len(trace)), key=lambda i: trace[i][1 if held_out else 0])
        assert np.isclose(r.log_likelihood, trace[top][0]) and (r.held_log_likelihood is None) == (not held_out)
    alone = chains.train(x.where("model = 'b'"), start.where("model = 'b'"), "model", ["take"], "i", "x", steps=5, held_out=held_out).first()
    assert np.allclose(alone.means, got["b"].means) and alone.steps == got["b"].steps


def test_models_converge_one_by_one(spark):
    x = speech(spark)
    start = chains.flat_start(x, "model", "x", 1)
    got = {r.model: r for r in chains.train(x, start, "model", ["take"], "i", "x", steps=9).collect()}
    assert all(r.converged and r.steps == 3 for r in got.values())  # exact after one step, then twice no gain
    none = chains.train(x.where("model = 'a'"), start, "model", ["take"], "i", "x", steps=2).where("model = 'c'").first()
    assert none.converged and none.steps == 0 and none.log_likelihood is None and np.allclose(none.means, start.where("model = 'c'").first().means)
    assert chains.train(x.limit(0), start.limit(0), "model", ["take"], "i", "x", steps=2).count() == 0


def test_scores_of_sequences(spark):
    x = speech(spark)
    models = chains.flat_start(x, "model", "x", 3).where("model <> 'c'")
    rows = chains.scored(x, models, "model", ["take"], "i", "x").collect()
    assert len(rows) == 6 + 7 + 1 and {r.model for r in rows} == {"a", "b"}
    short = next(r for r in rows if r.take == 77)
    assert short.frames == 1 and short.log_likelihood is None
    m = models.where("model = 'a'").first()
    data = np.array([r.x for r in x.where("model = 'a' AND take = 2").orderBy("i").collect()])
    with np.errstate(divide="ignore"):
        want = kernels.chain_counts(data, np.array(m.weights), np.array(m.means), np.array(m.variances), np.log(m.transition))[4]
    assert np.isclose(next(r for r in rows if r.model == "a" and r.take == 2).log_likelihood, want)
    total = {r.model: r for r in chains.evaluation(spark.createDataFrame(rows)).collect()}
    assert total["b"].sequences == 8 and total["b"].impossible == 1 and total["b"].frames == 63


def cloud(seed=3, n=400):
    r = np.random.default_rng(seed)
    a, b = np.array([[1.0, 0.8, 0], [0.8, 1.0, 0.2], [0, 0.2, 0.5]]), np.diag([0.2, 2.0, 1.0])
    return np.concatenate([r.multivariate_normal([0, 0, 0], a, n // 2), r.multivariate_normal([6, 0, 1], b, n // 2)])


def points(spark, x, **more):
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    return spark.createDataFrame([*rows, (10**6, None)], "id long, x array<double>").repartition(4)


def test_full_mixture_follows_direct_em(spark):
    x = cloud()[np.random.default_rng(0).permutation(400)]
    weights, means, covariances, trace = mixtures.fit(points(spark, x), "id", "x", 2, steps=5, tolerance=0)
    w, m, c = np.full(2, 0.5), x[:2].copy(), np.stack([np.eye(3)] * 2)
    for _ in range(5):
        dense = np.stack([w[k] * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m[k], np.linalg.inv(c[k]), x - m[k])) / np.sqrt(np.linalg.det(2 * np.pi * c[k])) for k in range(2)], axis=1)
        g = dense / dense.sum(axis=1, keepdims=True)
        w, m = g.mean(axis=0), g.T @ x / g.sum(axis=0)[:, None]
        c = np.stack([(g[:, k, None] * (x - m[k])).T @ (x - m[k]) / g[:, k].sum() for k in range(2)])
    assert np.allclose(weights, w) and np.allclose(means, m) and np.allclose(covariances, c)
    assert all(b >= a - 1e-9 for a, b in zip(trace, trace[1:], strict=False))


def test_floor_and_weak_components(spark):
    flat = np.array([[i % 5, 2.0 * (i % 5), 1.0] for i in range(60)])  # of rank one
    _, _, covariances, _ = mixtures.fit(points(spark, flat), "id", "x", 1, steps=2)
    assert np.linalg.eigvalsh(covariances[0])[0] >= 0.99e-6
    x = np.concatenate([[[50.0, 0, 0]], cloud()])
    weights, means, _, _ = mixtures.fit(points(spark, x), "id", "x", 2, steps=2, least=0.01)
    assert len(weights) == 1 and weights[0] == 1 and abs(means[0][0]) < 4
    assert mixtures.fit(points(spark, x).where("x IS NULL"), "id", "x", 2)[3] == []
    parts = spark.createDataFrame([("m", 0, 0.999, [0.0], [1.0]), ("m", 1, 0.0005, [0.0], [1.0]), ("n", 0, 2.0, [0.0], [1.0])], "mixture string, component int, weight double, mean array<double>, covariance array<double>")
    assert [(r.mixture, r.component, round(r.weight, 6)) for r in mixtures.pruned(parts).orderBy("mixture").collect()] == [("m", 0, 1.0), ("n", 0, 1.0)]


def test_components_and_moments_equal_numpy(spark):
    x = cloud()
    df = points(spark, x).withColumn("c", F.when(F.col("id") % 3 == 0, "a").otherwise("b")).withColumn("m", F.lit("m"))
    df = df.unionByName(df.withColumn("m", F.lit(None).cast("string")).limit(9))  # points of no mixture
    parts = mixtures.components(df, "m", "c", "x")
    got = {r.component: r for r in parts.collect()}
    for name, at in (("a", np.arange(400) % 3 == 0), ("b", np.arange(400) % 3 != 0)):
        assert len(got) == 2 and np.isclose(got[name].weight, at.mean())
        assert np.allclose(got[name]["mean"], x[at].mean(axis=0)) and np.allclose(np.reshape(got[name].covariance, (3, 3)), np.cov(x[at].T, bias=True))


def test_moments_of_a_whole_mixture(spark):
    x = cloud()
    df = points(spark, x).withColumn("c", F.col("id") % 3).withColumn("m", F.lit("m"))
    cells = mixtures.moments(mixtures.components(df.where("id < 1000"), "m", "c", "x")).collect()
    assert np.allclose([r.covariance for r in sorted(cells, key=lambda r: (r.i, r.j))], np.cov(x.T, bias=True).ravel())
    assert np.allclose([r.mean_j for r in sorted(cells, key=lambda r: r.j) if r.i == 0], x.mean(axis=0))


PART = "mixture int, component int, weight double, mean array<double>, covariance array<double>"


def test_samples_have_the_mixtures_moments(spark):
    rows = [(1, 0, 0.3, [0.0, 0.0], [1.0, 0.9, 0.9, 1.0]), (1, 1, 0.7, [5.0, -5.0], [0.5, 0.0, 0.0, 2.0]), (2, 0, 1.0, [1.0, 2.0], [4.0, 0.0, 0.0, 1e-4])]
    parts = spark.createDataFrame(rows, PART)
    ids = spark.range(20_000).select("id", F.when(F.col("id") % 4 == 0, 2).otherwise(1).alias("mixture"))
    got = mixtures.sampled(ids, parts, seed=9)
    rows = got.collect()
    again = {(r.id, tuple(r.x)) for r in mixtures.sampled(ids.repartition(13), parts, seed=9).collect()}
    assert again == {(r.id, tuple(r.x)) for r in rows} and len(again) == 20_000
    one = np.array([r.x for r in rows if r.mixture == 1])
    share = np.mean([r.component for r in rows if r.mixture == 1])
    assert abs(share - 0.7) < 0.02 and np.allclose(one.mean(axis=0), [3.5, -3.5], atol=0.1)
    a = np.array([r.x for r in rows if r.mixture == 1 and r.component == 0])
    assert np.allclose(np.cov(a.T, bias=True), [[1, 0.9], [0.9, 1]], atol=0.08)
    assert np.allclose(np.std([r.x for r in rows if r.mixture == 2], axis=0), [2, 0.01], rtol=0.05)
    assert mixtures.sampled(ids.withColumn("mixture", F.lit(8)), parts).count() == 0


def test_issues_of_components(spark):
    nan = float("nan")
    rows = [
        (1, 0, 0.5, [0.0, 0.0], [1.0, 0.0, 0.0, 1.0]), (1, 1, 0.5, [0.0, 0.0], [1.0, 0.5, 0.5, 1.0]), (2, 0, -0.5, [0.0], [1.0]), (2, 1, 1.0, [0.0], [1.0, 2.0]), (3, 0, 1.0, [nan], [1.0]),
        (4, 0, 1.0, [0.0, 0.0], [1.0, 0.3, 0.4, 1.0]), (5, 0, 1.0, [0.0, 0.0], [1.0, 2.0, 2.0, 1.0]), (6, 0, None, [0.0], [1.0]), (7, 0, 0.9, [0.0], [1.0]), (8, 0, 1.0, None, [1.0]),
    ]
    df = spark.createDataFrame(rows, PART)
    assert {(r.mixture, r.component): r.issue for r in mixtures.factored(df).collect()} == {
        (1, 0): None, (1, 1): None, (2, 0): "weight", (2, 1): "size", (3, 0): "not finite", (4, 0): "not symmetric", (5, 0): "not positive definite", (6, 0): "weight", (7, 0): None, (8, 0): "size",
    }
    assert {r.mixture: r.valid for r in mixtures.validity(df).collect()} == {1: True, **dict.fromkeys(range(2, 9), False)}
    assert mixtures.factored(df.where("mixture = 5"), floor=1e-6).first().issue is None


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_of_any_length(spark, seed):
    rng = random.Random(seed)
    spans = [(rng.choice("ab"), i, s := rng.randrange(-5000, 5000), s + rng.choice([0, -3, 1, 2, 7, 64, 100, 3000, 9000])) for i in range(150)] + [("a", 900, None, 5), ("a", 901, 5, None)]
    marks = [(rng.choice("abc"), i, rng.randrange(-6000, 9000)) for i in range(300)] + [("a", 999, None)]
    got = temporal.held(spark.createDataFrame(marks, "k string, p int, t long"), spark.createDataFrame(spans, "k string, s int, a long, b long"), ["k"], "t", "a", "b").collect()
    want = {(p, s) for k, p, t in marks for q, s, a, b in spans if k == q and None not in (t, a, b) and a <= t < b}
    assert len(got) == len(want) and {(r.p, r.s) for r in got} == want


def test_spans_of_fractions_and_none(spark):
    marks = spark.createDataFrame([("a", 0.3), ("a", 0.5)], "k string, t double")
    spans = spark.createDataFrame([("a", 0.1, 0.5)], "k string, a double, b double")
    assert [r.t for r in temporal.held(marks, spans, ["k"], "t", "a", "b").collect()] == [0.3]
    assert temporal.held(marks, spans.limit(0), ["k"], "t", "a", "b").count() == 0


def test_variance_through_alignments(spark):
    frames = spark.createDataFrame([("u", t, [float(t), 1.0]) for t in range(10)] + [("u", 3, None)], "k string, t int, x array<double>")
    spans = spark.createDataFrame([("u", 0, 4, "p"), ("u", 2, 6, "q"), ("u", 8, 9, None), ("u", 20, 30, "r")], "k string, a int, b int, label string")
    got = {(r.label, r.dim): (r.frames, r["mean"], round(r.variance, 9)) for r in statistics.aligned_variance(frames, spans, ["k"], "t", "a", "b", "label", "x").where("label IS NOT NULL").collect()}
    assert got == {("p", 0): (4, 1.5, 1.25), ("p", 1): (4, 1.0, 1e-6), ("q", 0): (4, 3.5, 1.25), ("q", 1): (4, 1.0, 1e-6)}
