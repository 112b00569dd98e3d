"""Queries of p-values, adaptive windows and energies of frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqloom.functions import context_labels as labels
from seqloom.functions import significance
from seqloom.operators import adaptive, analysis
from seqloom.operators import sequence as seq
from seqloom.operators import voice
from seqloom.plans.catalogue import EV, WD, K, O, ev, query, rnd, tb
from seqloom.sources import arguments

#: Student's two-sided p by Simpson's rule over the angle whose tangent is t over the root of the degrees of freedom.
_P = """2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(pi()) * (pi() / 2 - atan(abs(t) / sqrt(df))) / 600 / 3
* list_sum([(CASE WHEN i IN (0, 600) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(greatest(cos(atan(abs(t) / sqrt(df)) + (pi() / 2 - atan(abs(t) / sqrt(df))) * i / 600), 0), df - 1) FOR i IN range(0, 601)])"""


@query("ag57_one_sample", f"""WITH g AS (SELECT user_id, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY 1 HAVING count(value) > 1 AND stddev_samp(value) > 0), x AS (SELECT *, n - 1 AS df, (mean - 50) / (sd / sqrt(n)) AS t FROM g)
SELECT user_id, n, round(t, 6) AS t, round((mean - 50) / sd, 6) AS d, round({_P}, 6) AS p, round(mean, 6) AS middle, CAST(0.05 AS DOUBLE) AS beyond FROM x""")
def _(spark, sf):
    """``beyond`` is the p that the distance from mean to either end of the interval would have."""
    x = significance.one_sample(tb(spark, sf, "events"), ["user_id"], "value", 50.0).where("t IS NOT NULL")
    end = (F.col("high") - F.col("mean")) / (F.col("sd") / F.sqrt("n"))
    x = x.withColumn("beyond", significance.two_sided(end, F.col("n") - 1)).withColumn("middle", (F.col("low") + F.col("high")) / 2)
    return rnd(x, "t", "d", "p", "middle", "beyond").select("user_id", "n", "t", "d", "p", "middle", "beyond")


@query("ag57_two_samples", f"""WITH g AS (SELECT user_id, count(value) FILTER (event_type = 'click') AS n2, count(value) FILTER (event_type <> 'click') AS n1, avg(value) FILTER (event_type = 'click') AS m2, avg(value) FILTER (event_type <> 'click') AS m1, var_samp(value) FILTER (event_type = 'click') AS v2, var_samp(value) FILTER (event_type <> 'click') AS v1 FROM events GROUP BY 1),
h AS (SELECT *, n1 + n2 - 2 AS df, sqrt((coalesce(v1, 0) * (n1 - 1) + coalesce(v2, 0) * (n2 - 1)) / (n1 + n2 - 2)) AS s FROM g WHERE n1 > 0 AND n2 > 0 AND n1 + n2 > 2), x AS (SELECT *, (m1 - m2) / (s * sqrt(1 / n1 + 1 / n2)) AS t FROM h WHERE s > 0)
SELECT user_id, n1, n2, round(m1 - m2, 6) AS difference, round(s, 6) AS pooled, round(t, 6) AS t, round((m1 - m2) / s, 6) AS d, round({_P}, 6) AS p FROM x""")
def _(spark, sf):
    x = significance.two_samples(tb(spark, sf, "events"), ["user_id"], "value", F.col("event_type") == "click").where("t IS NOT NULL")
    return rnd(x, "difference", "pooled", "t", "d", "p").select("user_id", "n1", "n2", "difference", "pooled", "t", "d", "p")


#: Embeddings as log spectra of 64 bins at 16 kHz, scaled by label so that contents differ; the squares of the first eight are aperiodicities.
_SPECTRA = """s AS (SELECT vec_id, 100 + vec_id % 300 AS f0, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + label * 4)) AS e, CASE WHEN label % 3 = 0 THEN [CAST(embedding[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE) FOR i IN range(1, 9)] WHEN label % 3 = 1 THEN [0.1] END AS a FROM embeddings)"""


@query("arr12_window_choice", f"""WITH {_SPECTRA}, c AS (SELECT vec_id, f0, list_sum([exp(e[i + 1]) * (i * 16000.0 / 128) FOR i IN range(0, 64)]) / list_sum([exp(e[i]) FOR i IN range(1, 65)]) AS centroid, CASE WHEN a IS NULL THEN 0.7 ELSE 1 - least(1, list_avg(a)) END AS ratio, list_max(e) - list_min(e) AS span,
len([i FOR i IN range(2, 62) IF e[i + 1] > e[i] AND e[i + 1] > e[i + 2] AND e[i + 1] > e[i - 1] AND e[i + 1] > e[i + 3] AND i * 16000.0 / 128 > 200 AND i * 16000.0 / 128 < 4000]) AS formants FROM s)
SELECT vec_id, round(centroid, 4) AS centroid, round(ratio, 6) AS harmonic_ratio, round(span, 5) AS dynamic_range, CAST(formants AS INT) AS formants,
CASE WHEN ratio > 0.8 AND f0 < 200 THEN 'blackman_harris' WHEN ratio > 0.8 THEN 'blackman' WHEN least(0.8, centroid / 4000) > 0.6 THEN 'tukey' WHEN formants >= 2 THEN 'kaiser' WHEN span > 40 THEN 'blackman_harris' ELSE 'hann' END AS kind FROM c""")
def _(spark, sf):
    x = tb(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    noise = F.when(F.col("label") % 3 == 0, F.transform(F.slice("e", 1, 8), lambda v: v * v)).when(F.col("label") % 3 == 1, F.array(F.lit(0.1)))
    x = x.select("vec_id", (100 + F.col("vec_id") % 300).cast("double").alias("f0"), F.transform("e", lambda v: v * (1 + F.col("label") * 4)).alias("s"), noise.alias("a"))
    x = x.select("vec_id", adaptive.content(F.col("f0"), F.col("s"), F.col("a"), 16_000.0).alias("c"))
    x = x.select("vec_id", "c.centroid", "c.harmonic_ratio", "c.dynamic_range", F.size("c.formants").alias("formants"), adaptive.choice(F.col("c")).alias("kind"))
    return x.withColumns({"centroid": F.round("centroid", 4), "harmonic_ratio": F.round("harmonic_ratio", 6), "dynamic_range": F.round("dynamic_range", 5)})


_SERIES = f"{EV}, y AS (SELECT user_id, row_number() OVER {WD} - 1 AS i, value FROM ev)"


def _series(spark, sf):
    return ev(spark, sf).select("user_id", (F.row_number().over(seq.over(K, O)) - 1).alias("i"), "value")


@query("sup16_overlap_add", f"""WITH {_SERIES}, n AS (SELECT user_id, (count(*) - 32) // 8 AS last FROM y GROUP BY 1 HAVING count(*) >= 32) SELECT user_id, i AS "at", round(value, 5) AS value FROM y JOIN n USING (user_id) WHERE i >= 24 AND i < last * 8 + 8""")
def _(spark, sf):
    """Frames of 32 samples every 8, each user's with another window: where four of them meet, the series comes back."""
    frames = adaptive.cut(_series(spark, sf), ["user_id"], "i", "value", 32, 8)
    kind = F.element_at(F.array(*map(F.lit, adaptive.KINDS)), (F.col("user_id") % len(adaptive.KINDS) + 1).cast("int"))
    x = adaptive.overlapped(frames.withColumn("kind", kind), ["user_id"], adaptive.windows(spark, 32, 8), 8)
    return x.where("frames = 4").select("user_id", "at", F.round("value", 5).alias("value"))


@query("ag47_energies", f"""WITH {_SERIES}, f AS (SELECT a.user_id, a.i // 8 AS frame, list(b.value - 50 ORDER BY b.i) AS x FROM y a JOIN y b ON b.user_id = a.user_id AND b.i >= a.i AND b.i < a.i + 16 WHERE a.i % 8 = 0 GROUP BY ALL HAVING count(*) = 16),
p AS (SELECT user_id, frame, x, [(CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END) * (pow(list_sum([x[j + 1] * cos(2 * pi() * k * j / 16) FOR j IN range(0, 16)]), 2) + pow(list_sum([x[j + 1] * sin(2 * pi() * k * j / 16) FOR j IN range(0, 16)]), 2)) / 16 FOR k IN range(0, 9)] AS q FROM f)
SELECT user_id, frame, round(q[1] + q[2], 4) AS b0, round(q[3] + q[4], 4) AS b1, round(q[5] + q[6], 4) AS b2, round(q[7] + q[8] + q[9], 4) AS b3, round(len([j FOR j IN range(1, 16) IF (x[j] >= 0) <> (x[j + 1] >= 0)]) / 15, 6) AS crossings,
round(list_max([v * v FOR v IN x[1:5]]), 5) AS p0, round(list_max([v * v FOR v IN x[6:10]]), 5) AS p1, round(list_max([v * v FOR v IN x[11:16]]), 5) AS p2 FROM p""")
def _(spark, sf):
    frames = adaptive.cut(_series(spark, sf).withColumn("value", F.col("value") - 50), ["user_id"], "i", "value", 16, 8)
    x = adaptive.spectral_bands(frames).withColumn("peaks", adaptive.peaks(F.col("samples")))
    return x.select("user_id", "frame", *(F.round(F.col("bands")[k], 4).alias(f"b{k}") for k in range(4)), F.round(adaptive.crossings(F.col("samples")), 6).alias("crossings"), *(F.round(F.col("peaks")[k], 5).alias(f"p{k}") for k in range(3)))


#: A user is a phrase, a day a word, three events a syllable.
_CONTEXT = f"""{EV}, a AS (SELECT *, t // 86400000000 AS day, row_number() OVER {WD} - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, lag(event_type, 2, 'sil') OVER {WD} AS l2, lag(event_type, 1, 'sil') OVER {WD} AS l1, lead(event_type, 1, 'sil') OVER {WD} AS r1, lead(event_type, 2, 'sil') OVER {WD} AS r2 FROM ev),
b AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY day) - 1 AS w, row_number() OVER (PARTITION BY user_id, day ORDER BY t, event_id) AS wp, count(*) OVER (PARTITION BY user_id, day) AS wl FROM a),
c AS (SELECT *, max(w) OVER (PARTITION BY user_id) + 1 AS words, least(3, n - i // 3 * 3) AS sl FROM b)"""
_LABEL_SQL = """concat('/A:', i // 3, '_', (n - 1) // 3 - i // 3, '/B:', i % 3 + 1, '_', sl, '/C:', l2, '-', l1, '+', event_type, '++', r1, '+', r2, '/D:', wp, '_', wl, '/E:', w, '_', words - 1 - w, '/F:', (n - 1) // 3 + 1, '_', words,
'/G:', CAST(trunc(value * 10 - 1000.7) AS BIGINT), '_', CAST(trunc(value * 3.3) AS BIGINT), '/H:', CAST(trunc(60 + value / 4) AS BIGINT), '_', i % 4, '/I:', CAST(event_id % 2 = 0 AS INT), '_', CAST(event_id % 5 = 0 AS INT), '_', event_id % 3)"""


def _context(spark, sf):
    """Events with their fields, by name."""
    x = seq.context(ev(spark, sf), K, O, "event_type").withColumn("day", F.floor(F.col("t") / 86_400_000_000))
    phrase, word = Window.partitionBy(*K), Window.partitionBy(*K, "day")
    x = x.withColumns({"i": F.row_number().over(phrase.orderBy(*O)) - 1, "n": F.count("*").over(phrase), "w": F.dense_rank().over(phrase.orderBy("day")) - 1, "wp": F.row_number().over(word.orderBy(*O)), "wl": F.count("*").over(word)})
    x = x.withColumn("words", F.max("w").over(phrase) + 1)
    third = lambda c: F.floor(c / 3)
    i, n, e, v = (F.col(c) for c in ("i", "n", "event_id", "value"))
    fields = {
        "syllables_from_start": third(i), "syllables_to_end": third(n - 1) - third(i), "syllable_position": i % 3 + 1, "syllable_length": F.least(F.lit(3), n - third(i) * 3), "word_position": F.col("wp"), "word_length": F.col("wl"),
        "words_from_start": F.col("w"), "words_to_end": F.col("words") - 1 - F.col("w"), "phrase_syllables": third(n - 1) + 1, "phrase_words": F.col("words"), "pitch_cents": v * 10 - 1000.7, "duration_ms": v * 3.3,
        "tempo": 60 + v / 4, "beat": i % 4, "stressed": e % 2 == 0, "accented": e % 5 == 0, "stress_level": e % 3, "c": F.col("event_type"), **{k: F.col(k) for k in ("l2", "l1", "r1", "r2")},
    }
    return x, fields


@query("prj16_context_labels", f"WITH {_CONTEXT} SELECT event_id, {_LABEL_SQL} AS label FROM c")
def _(spark, sf):
    x, fields = _context(spark, sf)
    return x.select("event_id", labels.context_label(fields).alias("label"))


@query("prj17_context_text", f"""WITH {_CONTEXT} SELECT event_id, concat('Context[', l2, '-', l1, '-', event_type, '+', r1, '+', r2, ' | syl:', i % 3 + 1, '/', sl, ' | word:', wp, '/', wl, ' | pitch:', event_id % 50 * 20 - 500, 'c | dur:', event_id % 90 * 7, 'ms]') AS label FROM c""")
def _(spark, sf):
    x, fields = _context(spark, sf)
    whole = {"pitch_cents": F.col("event_id") % 50 * 20 - 500, "duration_ms": F.col("event_id") % 90 * 7}
    return x.select("event_id", labels.context_text(fields | whole).alias("label"))


@query("srt01_label_files", f"""WITH {_CONTEXT}, l AS (SELECT user_id, t // 1000 AS s, event_id, concat_ws(' ', t // 1000 * 10000, (t // 1000 + CAST(trunc(value * 3.3) AS BIGINT)) * 10000, {_LABEL_SQL}) AS line FROM c)
SELECT user_id, count(*) AS lines, concat(string_agg(line, chr(10) ORDER BY s, event_id), chr(10)) AS content FROM l GROUP BY 1""")
def _(spark, sf):
    x, fields = _context(spark, sf)
    start = F.floor(F.col("t") / 1000)
    rows = x.select("user_id", "event_id", start.alias("s"), (start + (F.col("value") * 3.3).cast("long")).alias("e"), labels.context_label(fields).alias("label"))
    return labels.label_files(rows, ["user_id"], "s", "e", "label", "event_id")


@query("arr20_analysis", """SELECT vec_id, 100 + vec_id % 200 AS hertz, true AS voiced, 513 AS bins, 5 AS bands FROM embeddings""")
def _(spark, sf):
    """A tone of eight harmonics for each row, their strengths from its embedding: its pitch to the nearest Hz, and little noise in the band of its first harmonics."""
    x = tb(spark, sf, "embeddings").select("vec_id", (100 + F.col("vec_id") % 200).alias("f"), F.slice("embedding", 1, 8).alias("e"))
    sample = "aggregate(transform(e, (v, k) -> (abs(v) * 0.3 + 1.0 / (k + 1)) * sin(2 * pi() * f * (k + 1) * t / 16000)), 0D, (s, v) -> s + v)"
    x = analysis.analysed(x.select("vec_id", F.expr(f"transform(sequence(0, 799), t -> {sample})").alias("samples")), 16_000.0)
    quiet = (F.col("f0") > 0) & (F.col("aperiodicity")[0] < 0.2)
    return x.select("vec_id", F.round("f0").cast("long").alias("hertz"), quiet.alias("voiced"), F.size("envelope").alias("bins"), F.size("aperiodicity").alias("bands"))


#: Calls with pitches and velocities in and out of range, words for numbers, and too few arguments.
_CALL = """CASE WHEN event_id % 13 = 0 THEN array('x', 'in.wav', 'out.wav') ELSE array('x', concat('in', event_id, '.wav'), 'out.wav', CASE WHEN event_id % 7 = 0 THEN 'C4' ELSE CAST(event_id % 10000 - 5000 AS STRING) END, CASE WHEN event_id % 11 = 0 THEN '' ELSE CAST(event_id % 1100 AS STRING) END,
CASE WHEN event_id % 5 = 0 THEN 'g-5B20' ELSE '' END, CAST(event_id % 300 - 20 AS STRING), '12.5', concat('+', event_id % 90), CAST(0 - event_id % 400 AS STRING), CAST(event_id % 150 - 70 AS STRING), CAST(event_id % 120 AS STRING)) END"""


@query("prj26_arguments", """WITH a AS (SELECT event_id, event_id % 13 <> 0 AS whole, event_id % 10000 - 5000 AS p, event_id % 1100 AS v FROM events), b AS (SELECT event_id, whole, CASE WHEN whole AND event_id % 7 <> 0 AND p BETWEEN -4800 AND 4800 THEN p END AS pitch, CASE WHEN whole AND event_id % 11 <> 0 AND v BETWEEN 1 AND 1000 THEN v END AS velocity, p, v FROM a)
SELECT event_id, CAST(pitch AS INT) AS pitch, CAST(velocity AS INT) AS velocity, CASE WHEN whole AND event_id % 5 = 0 THEN 'g-5B20' ELSE '' END AS flags, CAST(CASE WHEN whole THEN greatest(0, event_id % 300 - 20) ELSE 0 END AS INT) AS "offset", 0 AS "length", CAST(CASE WHEN whole THEN event_id % 90 ELSE 0 END AS INT) AS consonant,
CAST(CASE WHEN whole THEN 0 - event_id % 400 ELSE 0 END AS INT) AS cutoff, CAST(CASE WHEN whole AND event_id % 150 - 70 BETWEEN -60 AND 60 THEN event_id % 150 - 70 ELSE 0 END AS INT) AS volume, CAST(CASE WHEN whole AND event_id % 120 <= 100 THEN event_id % 120 ELSE 0 END AS INT) AS "start", 100 AS "end",
CASE WHEN NOT whole THEN 'too few arguments: 3' WHEN pitch IS NULL THEN 'no valid pitch: ' || CASE WHEN event_id % 7 = 0 THEN 'C4' ELSE CAST(p AS VARCHAR) END WHEN velocity IS NULL THEN 'no valid velocity: ' || CASE WHEN event_id % 11 = 0 THEN '' ELSE CAST(v AS VARCHAR) END END AS error FROM b""")
def _(spark, sf):
    return tb(spark, sf, "events").select("event_id", arguments.resampler(F.expr(_CALL)).alias("a")).select("event_id", "a.*").drop("input", "output", "is_valid")


@query("prj28_pulse", """WITH e AS (SELECT vec_id, label, [abs(CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings) SELECT vec_id, CAST(i AS INT) AS i, round(e[i + 1] * pow(10, (label - 4) * 1.5 * i / 64 / 20), 6) AS spectrum, round(least(1, e[i + 1] + label / 10.0 * 0.5), 6) AS aperiodicity, 1 + label / 20.0 AS formant FROM (SELECT *, unnest(range(0, 64)) AS i FROM e)""")
def _(spark, sf):
    x = tb(spark, sf, "embeddings").select("vec_id", F.col("label").alias("l"), F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("e"))
    p = voice.pulse(F.col("e"), F.col("e"), F.col("l") / 10.0, F.lit(0.5), (F.col("l") - 4) * 1.5, 1 + F.col("l") / 20.0, F.lit(None).cast("double"))
    x = x.select("vec_id", p.alias("p")).select("vec_id", F.col("p.formant_shift").alias("formant"), F.posexplode(F.arrays_zip("p.spectrum", "p.aperiodicity")).alias("i", "z"))
    return x.select("vec_id", "i", F.round("z.spectrum", 6).alias("spectrum"), F.round("z.aperiodicity", 6).alias("aperiodicity"), "formant")


@query("prj28_engine", """WITH x AS (SELECT event_id, value / 100 AS e, event_id % 10 / 10.0 AS b, event_id % 7 / 7.0 AS t FROM events) SELECT event_id, CAST(CASE WHEN e > 0.1 THEN floor(50 * (1 + e)) ELSE 50 END AS INT) AS harmonics, round(CASE WHEN e > 0.1 THEN 0.01 * (1 - e * 0.5) ELSE 0.01 END, 8) AS threshold,
CASE WHEN b > 0.3 THEN 'gaussian' END AS "window", CASE WHEN t > 0.5 THEN CAST(-70 AS DOUBLE) END AS side_lobe_db, b > 0.1 AS random_phase FROM x""")
def _(spark, sf):
    e, b, t = F.col("value") / 100, F.col("event_id") % 10 / 10.0, F.col("event_id") % 7 / 7.0
    made = voice.engine(F.lit(50), F.lit(0.01), F.lit(-60.0), F.lit(True), b, e, b, t)
    x = tb(spark, sf, "events").select("event_id", made.alias("m")).select("event_id", "m.*")
    return x.select("event_id", "harmonics", F.round("threshold", 8).alias("threshold"), "window", "side_lobe_db", "random_phase")
