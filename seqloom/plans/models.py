"""Queries of the modelling kernels. Iterations are beyond SQL; tests hold them against enumeration and closed forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seqloom.operators import chains, kernels, mixtures, statistics
from seqloom.plans.catalogue import EV, ev, query, rnd, tb


def _points(spark, sf):
    return tb(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


@query("ml01_log_density", """WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT vec_id, round(-0.5 * sum(x * x + ln(2 * pi())), 5) AS log_density FROM e GROUP BY 1""")
def _(spark, sf):
    d = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v + float(np.log(2 * np.pi)))
    return _points(spark, sf).select("vec_id", F.round(-0.5 * d, 5).alias("log_density"))


@query("fn_m09_log_sum_exp", """WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT vec_id, round(ln(sum(exp(x))), 5) AS total FROM e GROUP BY 1""")
def _(spark, sf):
    x = tb(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return x.select("vec_id", F.round(F.expr(kernels.log_sum_exp("x")), 5).alias("total"))


@query("ml04_mixture", None)
def _(spark, sf):
    x = _points(spark, sf)
    w, m, v, _ = kernels.fit_mixture(x, "vec_id", "x", 3)
    return rnd(kernels.mixture_scores(x, "vec_id", "x", w, m, v), "log_likelihood")


@query("ml05_order", None)
def _(spark, sf):
    rows = kernels.choose_order(_points(spark, sf), "vec_id", "x")
    return spark.createDataFrame(rows, "k int, aic double, bic double")


@query("ml10_alignment", None)
def _(spark, sf):
    x = _points(spark, sf)
    means = np.linspace(-1, 1, 3)[:, None] * np.ones(64)
    steps = np.array([[0.6, 0.4, 0], [0, 0.6, 0.4], [0, 0, 1.0]])
    return rnd(kernels.align(x, ["label"], "vec_id", "x", means, np.ones_like(means), steps), "posterior")


@query("ml15_trajectories", None)
def _(spark, sf):
    x = tb(spark, sf, "embeddings").select("label", "vec_id", F.transform(F.slice("embedding", 1, 32), lambda v: v.cast("double")).alias("mean"), F.transform(F.slice("embedding", 33, 32), lambda v: 0.1 + v * v.cast("double")).alias("var"))
    x = x.withColumn("duration", (F.col("vec_id") % 3).cast("int"))
    return kernels.trajectories(x, "label", "vec_id").select("label", "frame", F.posexplode("c").alias("dim", "c")).withColumn("c", F.round("c", 6))


@query("ag30_aligned_variance", f"""WITH {EV}, f AS (SELECT user_id, t, unnest([0, 1]) AS dim, unnest([value, ln(1 + value)]) AS x FROM ev), s AS (SELECT user_id, event_type AS label, t AS a, t + (1 + event_id % 97) * 1800000000 AS b FROM ev WHERE event_type IN ('signup', 'purchase', 'view'))
SELECT label, dim, count(*) AS frames, round(avg(x), 6) AS mean, round(greatest(var_pop(x), 1e-6), 5) AS variance FROM f JOIN s ON f.user_id = s.user_id AND f.t >= s.a AND f.t < s.b GROUP BY GROUPING SETS ((label, dim), (dim))""")
def _(spark, sf):
    e = ev(spark, sf)
    frames = e.select("user_id", "t", F.array("value", F.ln(1 + F.col("value"))).alias("x"))
    spans = e.where("event_type IN ('signup', 'purchase', 'view')").select("user_id", F.col("t").alias("a"), (F.col("t") + (1 + F.col("event_id") % 97) * 1_800_000_000).alias("b"), F.col("event_type").alias("label"))
    x = statistics.aligned_variance(frames, spans, ["user_id"], "t", "a", "b", "label", "x")
    return x.select("label", "dim", "frames", F.round("mean", 6).alias("mean"), F.round("variance", 5).alias("variance"))


def _sequences(spark, sf):
    return _points(spark, sf).select(F.col("label").alias("model"), (F.col("vec_id") % 7).alias("take"), "vec_id", "x")


@query("ml18_chains", None)
def _(spark, sf):
    """Three states of two Gaussians for each label, all labels at once, a fifth of the sequences held out."""
    x = _sequences(spark, sf)
    trained = chains.train(x, chains.flat_start(x, "model", "x", 3, 2), "model", ["take"], "vec_id", "x", steps=4, held_out=5)
    return trained.select("model", F.round("log_likelihood", 3).alias("log_likelihood"), F.round("held_log_likelihood", 3).alias("held_log_likelihood"), "steps", "converged", "means")


@query("ml18_one_state", """WITH e AS (SELECT label, vec_id, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT CAST(label AS VARCHAR) AS model, CAST(dim AS INT) AS dim, round(avg(x), 6) AS mean, round(var_pop(x), 5) AS variance FROM e GROUP BY ALL""")
def _(spark, sf):
    """Chains of one state and one Gaussian come to mean and variance of their frames, whatever they begin with."""
    x = _sequences(spark, sf)
    start = chains.flat_start(x, "model", "x", 1).withColumn("means", F.transform("means", lambda s: F.transform(s, lambda m: F.transform(m, lambda v: v + 1))))
    trained = chains.train(x, start, "model", ["take"], "vec_id", "x", steps=3)
    x = trained.select("model", F.posexplode(F.arrays_zip(F.col("means")[0][0].alias("m"), F.col("variances")[0][0].alias("v"))).alias("dim", "z"))
    return x.select("model", "dim", F.round("z.m", 6).alias("mean"), F.round("z.v", 5).alias("variance"))


@query("jn13_evaluation", """WITH e AS (SELECT label, vec_id, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT label, dim, avg(x) AS mean, greatest(var_pop(x), 1e-6) AS v FROM e GROUP BY ALL),
f AS (SELECT e.label, vec_id, sum(-0.5 * ((x - mean) * (x - mean) / v + ln(v) + ln(2 * pi()))) AS l FROM e JOIN m USING (label, dim) WHERE label % 3 <> 0 GROUP BY ALL) SELECT CAST(label AS VARCHAR) AS model, count(DISTINCT vec_id % 7) AS sequences, 0 AS impossible, count(*) AS frames, round(sum(l), 3) AS log_likelihood, round(avg(l), 5) AS per_frame FROM f GROUP BY label""")
def _(spark, sf):
    """Sequences under the models of their names; there are none for every third label."""
    x = _sequences(spark, sf)
    models = chains.flat_start(x.where("model % 3 <> 0"), "model", "x", 1)
    found = chains.evaluation(chains.scored(x, models, "model", ["take"], "vec_id", "x"))
    return found.select("model", "sequences", F.col("impossible").cast("int").alias("impossible"), "frames", F.round("log_likelihood", 3).alias("log_likelihood"), F.round("per_frame", 5).alias("per_frame"))


@query("ml06_moments", """WITH e AS (SELECT vec_id, label % 2 AS mixture, embedding AS e FROM embeddings), c AS (SELECT mixture, vec_id, generate_subscripts(e, 1) - 1 AS i, CAST(unnest(e) AS DOUBLE) AS x FROM e)
SELECT a.mixture, CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(avg(a.x), 6) AS mean, round(covar_pop(a.x, b.x), 5) AS covariance FROM c a JOIN c b USING (vec_id) GROUP BY a.mixture, a.i, b.i""")
def _(spark, sf):
    """A mixture of one Gaussian a label has the moments of all its points."""
    parts = mixtures.components(_points(spark, sf).withColumn("mixture", F.col("label") % 2), "mixture", "label", "x")
    return mixtures.moments(parts).select("mixture", "i", "j", F.round("mean_i", 6).alias("mean"), F.round("covariance", 5).alias("covariance"))


@query("ml06_full_mixture", None)
def _(spark, sf):
    weights, means, covariances, trace = mixtures.fit(_points(spark, sf), "vec_id", "x", 3, steps=4)
    rows = [(k, float(w), m.tolist(), float(np.linalg.slogdet(c)[1])) for k, (w, m, c) in enumerate(zip(weights, means, covariances, strict=True))]
    return spark.createDataFrame(rows, "component int, weight double, mean array<double>, log_determinant double")


_PLANE = "p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), g AS (SELECT label % 2 AS mixture, label, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM p GROUP BY ALL)"


def _plane(spark, sf):
    x = _points(spark, sf).select("vec_id", "label", (F.col("label") % 2).alias("mixture"), F.slice("x", 1, 2).alias("x"))
    return x, mixtures.components(x, "mixture", "label", "x")


def _draw(k):
    return f"((CAST(concat('0x', substr(sha256('5:' || vec_id || ':{k}'), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)"


@query("srt10_samples", f"""WITH {_PLANE}, w AS (SELECT *, sum(n) OVER (PARTITION BY mixture ORDER BY label) * 1.0 / sum(n) OVER (PARTITION BY mixture) AS upto, sqrt(a) AS l FROM g), u AS (SELECT vec_id, label % 2 AS mixture, {_draw(0)} AS u, sqrt(-2 * ln({_draw(1)})) AS r, 2 * pi() * {_draw(2)} AS t FROM p),
s AS (SELECT u.vec_id, u.mixture, arg_min(w, upto) AS w, any_value(r) AS r, any_value(t) AS t FROM u JOIN w ON w.mixture = u.mixture AND w.upto > u.u GROUP BY ALL)
SELECT vec_id AS id, mixture, w.label AS component, round(w.mx + w.l * r * cos(t), 5) AS x, round(w.my + w.b / w.l * r * cos(t) + sqrt(w.c - w.b * w.b / w.a) * r * sin(t), 5) AS y FROM s""")
def _(spark, sf):
    """A point for each row from its label's mixture, over the first two dimensions."""
    points, parts = _plane(spark, sf)
    drawn = mixtures.sampled(points.select(F.col("vec_id").alias("id"), "mixture"), parts, seed=5)
    return drawn.select("id", "mixture", "component", F.round(F.col("x")[0], 5).alias("x"), F.round(F.col("x")[1], 5).alias("y"))


@query("flt18_components", f"""WITH {_PLANE}, h AS (SELECT mixture, label, CASE WHEN label = 4 THEN -0.1 ELSE n * 1.0 / sum(n) OVER (PARTITION BY mixture) END AS weight, a, b + label * 0.2 AS b, c FROM g)
SELECT mixture, label AS component, CASE WHEN weight < 0 THEN 'weight' WHEN a * c - b * b <= 0 THEN 'not positive definite' END AS issue FROM h""")
def _(spark, sf):
    """Components of which some got a negative weight or too much covariance."""
    _, parts = _plane(spark, sf)
    c = F.col("covariance")
    off = F.array(c[0], c[1] + F.col("component") * 0.2, c[2] + F.col("component") * 0.2, c[3])
    x = parts.withColumn("covariance", off).withColumn("weight", F.when(F.col("component") == 4, -0.1).otherwise(F.col("weight")))
    return mixtures.factored(x).select("mixture", "component", "issue")
