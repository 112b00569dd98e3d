"""Queries of phoneme encodings, flag conversion, synthesis, settings, containers and buffer policies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqloom.functions import phonemes as ph
from seqloom.operators import kernels, synthesis, voice
from seqloom.operators import statistics as st
from seqloom.plans.catalogue import _DIMS, EV, WD, ev, query, rnd, tb
from seqloom.sinks import container
from seqloom.sources import settings
from seqloom.streaming import policies

# Labels for events: letters by number, some in upper case, some of two letters.
_LABEL = "CASE WHEN event_id % 7 = 0 THEN 'sh' WHEN event_id % 11 = 0 THEN 'aa' WHEN event_id % 5 = 0 THEN upper(chr(CAST(97 + event_id % 26 AS INT))) ELSE chr(CAST(97 + event_id % 26 AS INT)) END"
_MASKS = "masks(p, mask) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in ph.MASKS.items()) + ")"
_LABELLED = f"{_MASKS}, l AS (SELECT event_id, {_LABEL} AS p FROM events), m AS (SELECT event_id, l.p, coalesce(a.mask, b.mask, {ph.SILENCE}) AS mask FROM l LEFT JOIN masks a ON a.p = l.p LEFT JOIN masks b ON b.p = lower(l.p))"


def _labelled(spark, sf):
    return tb(spark, sf, "events").select("event_id", F.expr(_LABEL).alias("p"))


@query("prj10_phoneme_bits", f"""WITH {_LABELLED} SELECT event_id, CAST(i AS INT) AS i, CAST((mask // CAST(pow(2, i) AS BIGINT)) % 2 AS DOUBLE) AS bit FROM m, (SELECT unnest(range(0, 32)) AS i)""")
def _(spark, sf):
    return _labelled(spark, sf).select("event_id", F.posexplode(ph.bits(ph.mask(F.col("p")))).alias("i", "bit"))


_HAS = {n: f"(mask // {1 << ph.BITS.index(n)}) % 2 = 1" for n in ("silence", "vowel", "long", "nasal", "plosive", "fricative", "semivowel")}


@query("prj11_category", f"""WITH {_LABELLED} SELECT event_id, CASE WHEN {_HAS['silence']} THEN 'silence' WHEN {_HAS['vowel']} AND {_HAS['long']} THEN 'long_vowel' WHEN {_HAS['vowel']} THEN 'vowel'
WHEN {_HAS['nasal']} THEN 'nasal' WHEN {_HAS['plosive']} THEN 'plosive' WHEN {_HAS['fricative']} THEN 'fricative' WHEN {_HAS['semivowel']} THEN 'semivowel' ELSE 'consonant' END AS category FROM m""")
def _(spark, sf):
    return _labelled(spark, sf).select("event_id", ph.category(ph.mask(F.col("p"))).alias("category"))


def _positions():
    r = F.col("event_id")
    return ph.position_vector([(r % k / k) for k in (2, 3, 4, 5, 8)], [r % k == 0 for k in (2, 3, 4, 5, 6, 7)], r % 10 / 10, F.when(r % 3 > 0, r % 3), [r % 8 == 0, r % 9 == 0])


_POSITIONS = "[" + ", ".join([f"event_id % {k} / {k}" for k in (2, 3, 4, 5, 8)] + [f"CAST(event_id % {k} = 0 AS INT)" for k in range(2, 8)]) + """, event_id % 10 / 10, CAST(event_id % 3 > 0 AS INT),
CASE WHEN event_id % 3 > 0 THEN event_id % 3 / 10 ELSE -0.1 END, CAST(event_id % 8 = 0 AS INT), CAST(event_id % 9 = 0 AS INT)]"""


@query("prj12_position_vector", f"""SELECT event_id, CAST(i AS INT) AS i, round(v[i + 1], 5) AS x FROM (SELECT event_id, {_POSITIONS} AS v FROM events), (SELECT unnest(range(0, 16)) AS i)""")
def _(spark, sf):
    x = tb(spark, sf, "events").select("event_id", F.posexplode(_positions()).alias("i", "x"))
    return x.withColumn("x", F.round(F.col("x").cast("double"), 5))


@query("prj13_context_vector", f"""WITH {_LABELLED}, b AS (SELECT event_id, [CAST((mask // CAST(pow(2, i) AS BIGINT)) % 2 AS DOUBLE) FOR i IN range(0, 32)] AS bits FROM m), v AS (SELECT event_id, flatten([bits, bits, bits, bits, bits, bits, bits, p, p, p, p, p, p, p,
[value, 1.0, 1.0], CASE WHEN event_id % 3 > 0 THEN [60 / 127.0, 100 / 127.0, 0.25] ELSE [0.0, 0.0, 0.0] END, CASE WHEN event_id % 2 = 0 THEN [0.5, 1.0, 0.0, 1.0] ELSE [0.0, 0.0, 0.0, 0.0] END]) AS x
FROM b JOIN (SELECT event_id, value, {_POSITIONS} AS p FROM events) USING (event_id)) SELECT event_id, len(x) AS n, round(list_sum([CAST(CAST(x[i] AS FLOAT) AS DOUBLE) * i FOR i IN range(1, 347)]), 1) AS checksum FROM v""")
def _(spark, sf):
    x = tb(spark, sf, "events").select("event_id", "value", F.expr(_LABEL).alias("p"))
    note = F.when(F.col("event_id") % 3 > 0, F.lit(60)).otherwise(0)
    vector = ph.context_vector([F.col("p")] * 7, [_positions()] * 7, [F.col("value"), F.lit(1.0), F.lit(True).cast("int")], [note, F.lit(100), F.lit(250.0)], [F.col("event_id") % 2 == 0, F.lit(0.5), F.lit("a"), F.lit(""), F.lit("i")])
    x = x.select("event_id", vector.alias("x"))
    return x.select("event_id", F.size("x").cast("long").alias("n"), F.round(F.expr("aggregate(zip_with(x, sequence(1, 346), (v, i) -> v * i), 0D, (a, v) -> a + v)"), 1).alias("checksum"))


@query("prj14_quinphone_vector", f"""WITH codes(p, code) AS (VALUES {', '.join(f"('{p}', {i})" for p, i in ph.CODES.items())}), l AS (SELECT event_id, {_LABEL} AS p FROM events)
SELECT event_id, CAST(coalesce(code, 1) AS INT) AS hot, CAST({len(ph.INVENTORY)} * 5 + 11 AS BIGINT) AS n, CAST(coalesce(code, 1) AS DOUBLE) AS categorical,
concat_ws(' ', coalesce(code, 1) || ':1', {", ".join(f"'{len(ph.INVENTORY) * k + ph.CODES[p]}:1'" for k, p in ((1, "a"), (2, "i"), (3, "u")))}, (coalesce(code, 1) + {len(ph.INVENTORY) * 4}) || ':1', {", ".join(f"'{len(ph.INVENTORY) * 5 + i}:{i}'" for i in range(1, 11))}) AS vector FROM l LEFT JOIN codes USING (p)""")
def _(spark, sf):
    """``vector``: place and value of each number of the vector that is not zero."""
    numbers = [F.lit(float(i)) for i in range(11)]
    labels = [F.col("p"), F.lit("a"), F.lit("i"), F.lit("u"), F.col("p")]
    x = _labelled(spark, sf).select("event_id", ph.quinphone_vector(labels, numbers).alias("h"), ph.quinphone_vector(labels, numbers, one_hot=False).alias("c"))
    places = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.get("h", i) != 0)
    vector = F.array_join(F.transform(places, lambda i: F.concat_ws(":", i.cast("string"), F.get("h", i).cast("int").cast("string"))), " ")
    return x.select("event_id", (F.array_position("h", F.lit(1.0)) - 1).cast("int").alias("hot"), F.size("h").cast("long").alias("n"), F.get("c", F.lit(0)).alias("categorical"), vector.alias("vector"))


_PAIRS = "kana(k, r) AS (VALUES " + ", ".join(f"('{k}', '{r}')" for k, r in ph.ROMAJI.items()) + ")"


@query("fn_s05_romaji", f"""WITH {_PAIRS}, n AS (SELECT k, r, row_number() OVER (ORDER BY r, k) - 1 AS i, count(*) OVER () AS n FROM kana)
SELECT o_orderkey, a.r || b.r || '-' AS letters FROM orders JOIN n a ON a.i = o_orderkey % a.n JOIN n b ON b.i = o_orderkey * 7 % b.n""")
def _(spark, sf):
    kana = F.array(*(F.lit(k) for k, _ in sorted(ph.ROMAJI.items(), key=lambda x: (x[1], x[0]))))
    n = len(ph.ROMAJI)
    pick = lambda i: F.get(kana, (i % n).cast("int"))
    word = F.concat(pick(F.col("o_orderkey")), pick(F.col("o_orderkey") * 7), F.lit("-"))
    return tb(spark, sf, "orders").select("o_orderkey", ph.romaji(word).alias("letters"))


@query("fn_s06_hiragana", f"""WITH back(r, k) AS (VALUES {', '.join(f"('{r}', '{k}')" for r, k in ph.HIRAGANA.items())}), l AS (SELECT event_id, {_LABEL} AS p FROM events) SELECT event_id, coalesce(k, p) AS kana, regexp_full_match(p, '[a-z]+') AS letters FROM l LEFT JOIN back ON r = p""")
def _(spark, sf):
    return _labelled(spark, sf).select("event_id", ph.hiragana(F.col("p")).alias("kana"), ph.is_romaji(F.col("p")).alias("letters"))


_KINDS = [*voice.SENSITIVITY, "unknown"]
_FLAGS = "CAST(event_id % 201 - 100 AS INT) AS g, CAST(event_id * 3 % 201 - 100 AS INT) AS t, CAST(event_id * 7 % 101 AS INT) AS bre, CAST(event_id * 11 % 201 - 100 AS INT) AS bri"
_VOICES = "voices AS (SELECT * FROM (VALUES " + ", ".join(
    str((k, *voice.SENSITIVITY.get(k, dict.fromkeys(("g", "t", "bre", "bri"), 1.0)).values(), *(voice.ADJUSTMENT.get(k, {}).get(n, d) for n, d in (("formant", 1.0), ("tension", 1.0), ("brightness", 1.0), ("breath", 1.0), ("least_breath", 0.0), ("emphasis", 1.0), ("tilt", 0.0), ("roughness", 0.0), ("phase", 0.0), ("aperiodicity", 1.0)))))
    for k in _KINDS
) + ") v(kind, sg, st, sbre, sbri, f_formant, f_tension, f_brightness, f_breath, least_breath, f_emphasis, a_tilt, roughness, phase, aperiodicity))"


@query("prj27_flag_conversion", f"""WITH {_VOICES}, k AS (SELECT event_id, {_FLAGS}, 100 + event_id % 300 AS f0, list_extract({_KINDS}, CAST(event_id % 7 + 1 AS INT)) AS kind FROM events),
a AS (SELECT *, bre > 50 AND t > 40 AS strained, g > 30 AND t > 30 AS joint,
  1 + g / 100 * 0.5 * sg * (1 + ln(f0 / 110) / ln(2) * 0.2) * 0.8 + CASE WHEN abs(bri) > 30 AND abs(g) > 20 THEN bri / 100 * (g / 100) * 0.15 ELSE 0 END AS x,
  1 + bri / 100 * 0.6 * sbri AS y FROM k JOIN voices USING (kind)),
b AS (SELECT *, greatest(0.5, least(2, 1 + (x - 1) * f_formant)) AS formant,
  greatest(-1, least(1, (1 - 2 / (exp(2 * t / 100 * st * 1.5) + 1)) * CASE WHEN strained THEN 0.8 ELSE 1 END * f_tension)) AS tension,
  greatest(0, least(1, greatest(least_breath, least(1, bre / 100 * 0.8 * sbre) * CASE WHEN strained THEN 0.7 ELSE 1 END * f_breath))) AS breath,
  greatest(1 / 3, least(3, 1 + (y * CASE WHEN bre > 30 AND bri <> 0 THEN 1 - bre / 100 * 0.2 ELSE 1 END - 1) * f_brightness)) AS z, CASE WHEN joint THEN 0.2 ELSE 0 END * f_emphasis AS e FROM a)
SELECT event_id, round(formant, 5) AS formant, round(tension, 5) AS tension, round(breath, 5) AS breath, round(z * CASE WHEN abs(formant - 1) > 0.5 THEN 1 - abs(formant - 1) * 0.3 ELSE 1 END, 5) AS brightness,
round(CASE WHEN breath > 0.7 AND e > 0.5 THEN e / 2 ELSE e END, 5) AS emphasis, CAST(CASE WHEN joint THEN 1 ELSE 0 END + a_tilt AS DOUBLE) AS tilt, CAST(roughness AS DOUBLE) AS roughness, CAST(phase AS DOUBLE) AS phase, CAST(aperiodicity AS DOUBLE) AS aperiodicity FROM b""")
def _(spark, sf):
    kinds = F.array(*map(F.lit, _KINDS))
    x = tb(spark, sf, "events").selectExpr("event_id", *_FLAGS.split(", ")).withColumns({"f0": 100 + F.col("event_id") % 300, "voice": F.get(kinds, (F.col("event_id") % 7).cast("int"))})
    x = voice.convert(x).select("event_id", *voice.OUT)
    return x.withColumns({c: F.round(c, 5) for c in ("formant", "tension", "breath", "brightness", "emphasis")})


@query("fn_m13_voice_kind", """SELECT event_id, CASE WHEN value < 120 THEN 'male_adult' WHEN value > 350 AND event_id % 5000 > 3000 THEN 'child' WHEN value > 250 THEN 'female_adult' WHEN event_id % 10 < 3 THEN 'whisper'
WHEN event_id % 10 / 10 > 0.85 AND event_id % 5000 < 1500 THEN 'growl' ELSE 'unknown' END AS kind FROM events""")
def _(spark, sf):
    r = F.col("event_id")
    richness = F.when(r % 10 == 9, 0.95).otherwise(r % 10 / 10)
    return tb(spark, sf, "events").select("event_id", voice.kind(F.col("value"), r % 5000, richness).alias("kind"))


_SPECTRA = "SELECT vec_id, 100.0 + vec_id % 50 AS f0, [abs(CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings"


def _spectra(spark, sf):
    return tb(spark, sf, "embeddings").select("vec_id", "label", (100.0 + F.col("vec_id") % 50).alias("f0"), F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("e"))


@query("arr17_harmonics", f"""WITH s AS ({_SPECTRA}), h AS (SELECT vec_id, f0, e, unnest(range(1, 41)) AS h FROM s), b AS (SELECT *, CAST(floor(f0 * h * 128 / 8000) AS INT) AS bin FROM h WHERE f0 * h < 4000)
SELECT vec_id, CAST(h AS INT) AS harmonic, bin, round(e[bin + 1] * (1 - e[bin + 1]), 5) AS amplitude FROM b WHERE bin < 64 AND e[bin + 1] >= 0.1""")
def _(spark, sf):
    x = _spectra(spark, sf).select("vec_id", F.explode(synthesis.harmonics("f0", "e", "e", rate=8000, fft=128, most=40, least=0.1)).alias("h"))
    return x.select("vec_id", "h.harmonic", "h.bin", F.round("h.amplitude", 5).alias("amplitude"))


@query("arr18_overlap_add", f"""WITH {_DIMS} SELECT label, "at", round(sum(x), 4) AS x FROM (SELECT e.label, e.vec_id * 16 % 4096 + dim AS "at", x FROM dims JOIN embeddings e USING (vec_id)) GROUP BY 1, 2""")
def _(spark, sf):
    e = tb(spark, sf, "embeddings").select("label", (F.col("vec_id") * 16 % 4096).alias("p"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return synthesis.overlap_added(e, ["label"], "p", "x").withColumn("x", F.round("x", 4))


@query("arr19_synthesis", None)
def _(spark, sf):
    x = _spectra(spark, sf).select("label", "vec_id", F.when(F.col("vec_id") % 4 > 0, F.col("f0")).alias("f0"), "e", F.transform("e", lambda v: F.least(v, F.lit(1.0))).alias("air"))
    found = synthesis.synthesised(x, "label", "vec_id", "f0", "e", "air", rate=8000, fft=128)
    return found.select("label", F.size("samples").alias("n"), F.round(F.expr("sqrt(aggregate(samples, 0D, (a, v) -> a + v * v) / size(samples))"), 5).alias("level"))


@query("arr20_pitch", None)
def _(spark, sf):
    x = _spectra(spark, sf).select("vec_id", F.expr("transform(sequence(0, 799), i -> sin(2 * pi() * f0 * i / 8000) + 0.5 * sin(4 * pi() * f0 * i / 8000))").alias("samples"))
    return synthesis.pitch(x, "vec_id", "samples", 8000).select("vec_id", F.round("f0", 1).alias("f0"), F.round("strength", 4).alias("strength"))


@query("ml16_variance_corrected", f"""WITH {_DIMS}, v AS (SELECT e.vec_id, e.label, dim, x, avg(x) OVER w AS m, var_pop(x) OVER w AS v FROM dims JOIN embeddings e USING (vec_id) WINDOW w AS (PARTITION BY e.vec_id % 3, dim)),
g AS (SELECT label, dim, var_pop(x) AS goal FROM v GROUP BY 1, 2) SELECT vec_id, CAST(dim AS INT) AS dim, round(CASE WHEN v > 1e-6 AND goal > 1e-6 THEN m + greatest(0.01, least(2, sqrt(goal / v))) * (x - m) ELSE x END, 5) AS corrected FROM v JOIN g USING (label, dim)""")
def _(spark, sf):
    x = tb(spark, sf, "embeddings").select("vec_id", "label", (F.col("vec_id") % 3).alias("s"), F.posexplode(F.transform("embedding", lambda v: v.cast("double"))).alias("dim", "x"))
    goal = x.groupBy("label", "dim").agg(F.var_pop("x").alias("variance"))
    return st.variance_corrected(x, ["s"], "label", "dim", "x", goal).select("vec_id", "dim", F.round("corrected", 5).alias("corrected"))


@query("ml17_variance_weights", f"""WITH {_DIMS}, x AS (SELECT e.vec_id % 3 AS s, e.label, dim, x FROM dims JOIN embeddings e USING (vec_id)), v AS (SELECT s, dim, var_pop(x) AS v FROM x GROUP BY 1, 2), g AS (SELECT label, dim, var_pop(x) AS goal FROM x GROUP BY 1, 2)
SELECT s, label, round(greatest(0.01, least(2, 1 + avg(abs(ln(v / goal))))), 5) AS weight FROM (SELECT DISTINCT s, label FROM x) JOIN v USING (s) JOIN g USING (label, dim) WHERE v > 1e-6 AND goal > 1e-6 GROUP BY 1, 2""")
def _(spark, sf):
    x = tb(spark, sf, "embeddings").select("label", (F.col("vec_id") % 3).alias("s"), F.posexplode(F.transform("embedding", lambda v: v.cast("double"))).alias("dim", "x"))
    goal = x.groupBy("label", "dim").agg(F.var_pop("x").alias("variance"))
    return st.variance_weights(x, ["s"], "label", "dim", "x", goal).withColumn("weight", F.round("weight", 5))


_CHAIN = np.array([[0.6, 0.4, 0], [0, 0.6, 0.4], [0, 0, 1.0]])


def _frames(spark, sf):
    return tb(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


@query("ml11_alignment_within", None)
def _(spark, sf):
    means = np.linspace(-1, 1, 3)[:, None] * np.ones(64)
    x = _frames(spark, sf).withColumn("windows", F.expr("array(named_struct('state', 0, 'first', 0, 'last', 0), named_struct('state', 2, 'first', 3, 'last', 1000000000))"))
    return kernels.align_within(x, ["label"], "vec_id", "x", "windows", means, np.ones_like(means), _CHAIN)


@query("ml13_chain_training", None)
def _(spark, sf):
    means = np.linspace(-1, 1, 3)[:, None, None] * np.ones((3, 1, 64))
    (w, m, v, a), trace = kernels.train_chain(_frames(spark, sf), ["label"], "vec_id", "x", np.ones((3, 1)), means, np.ones_like(means), _CHAIN)
    rows = [(i, float(m[i, 0, 0]), float(v[i, 0, 0]), float(a[i, i]), float(trace[-1][0])) for i in range(3)]
    return rnd(spark.createDataFrame(rows, "state int, mean double, variance double, stay double, log_likelihood double"), "mean", "variance", "stay", "log_likelihood")


@query("src17_settings", """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 5) AS k, 71.0::DOUBLE AS f0_floor, 'default' AS name FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{}' WHEN event_id % 3 = 1 THEN '{"k": ' || event_id || '.5}' ELSE 'broken' END AS props FROM events) WHERE json_valid(props)
UNION ALL SELECT event_id, 5, 71, 'default' FROM events WHERE event_id % 3 = 2""")
def _(spark, sf):
    r = F.col("event_id")
    text = F.when(r % 3 == 0, "{}").when(r % 3 == 1, F.concat(F.lit('{"world_config": {"frame_period": '), r, F.lit(".5}}"))).otherwise("broken")
    x = tb(spark, sf, "events").select("event_id", settings.with_defaults(text, settings.DEFAULTS).alias("c"))
    return x.select("event_id", F.col("c.world_config.frame_period").alias("k"), F.col("c.world_config.f0_floor").alias("f0_floor"), F.col("c.config_name").alias("name"))


@query("src16_parameters", f"""WITH {EV} SELECT user_id, CAST(row_number() OVER {WD} - 1 AS INT) AS frame, round((row_number() OVER {WD} - 1) * 0.005::DOUBLE, 6) AS time, value AS f0 FROM ev""")
def _(spark, sf):
    frames = F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id", "value"))), lambda e: e["value"])
    x = ev(spark, sf).groupBy("user_id").agg(F.to_json(F.struct(F.lit(44100).alias("sample_rate"), F.lit(5.0).alias("frame_period"), frames.alias("f0"))).alias("text"))
    return settings.parameters(x, ["user_id"], "text").select("user_id", "frame", F.round("time", 6).alias("time"), "f0")


@query("src15_manifest", """SELECT event_id, event_type AS kind, round(value, 3) AS semitones, CAST(NULL AS DOUBLE) AS tilt_db FROM events WHERE event_id % 5 > 0""")
def _(spark, sf):
    r = F.col("event_id")
    line = F.when(r % 5 == 0, F.concat(F.lit("# "), r)).otherwise(F.concat_ws(",", "event_type", F.lit("a"), F.lit("b"), F.col("value").cast("string"), F.lit("1.0")))
    x = tb(spark, sf, "events").select("event_id", line.alias("line"))
    return settings.manifest(x, ["event_id"], "line").select("event_id", "kind", F.round("semitones", 3).alias("semitones"), "tilt_db")


def _models(spark, sf):
    d = F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double"))
    cov = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: (i == j).cast("int").cast("double")))
    state = F.struct(F.lit(0).alias("state_id"), F.lit(0.6).alias("self_loop"), F.lit(0.4).alias("next_state"), F.lit(0.0).alias("exit"), F.array(F.struct(F.lit(1.0).alias("weight"), d.alias("mean"), cov.alias("cov"))).alias("mixture"))
    x = tb(spark, sf, "embeddings").select("label", F.concat(F.lit("m"), "vec_id").alias("name"), F.col("vec_id").alias("model_id"), F.array(state).alias("states"))
    fixed = {n: F.lit({"s": "a", "i": 1, "d": 2.5}[k]) for n, k in container.MODEL[2:]}
    return x.withColumns(fixed)


@query("snk11_container_round_trip", """SELECT label, 'm' || vec_id AS name, vec_id AS model_id, 'a' AS current, round(CAST(embedding[1] AS DOUBLE) + embedding[2] + embedding[3], 4) AS total FROM embeddings""")
def _(spark, sf):
    files = container.write_rows(_models(spark, sf), "label")
    x = container.read_rows(files, "label")
    mean = F.col("states")[0]["mixture"][0]["mean"]
    return x.select("label", "name", "model_id", "current", F.round(F.aggregate(mean, F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("snk12_model_size", """SELECT vec_id AS model_id, CAST(length('m' || vec_id) + 212 + 36 + 16 + 24 + 72 AS BIGINT) AS bytes FROM embeddings""")
def _(spark, sf):
    return _models(spark, sf).select("model_id", container.estimated_size().cast("long").alias("bytes"))


@query("str10_release", f"""WITH {EV}, n AS (SELECT max(t) // 2000 + min(t) // 2000 AS now FROM ev) SELECT event_id, CASE WHEN t // 1000 + value < now - 1000 THEN 'late' WHEN now >= t // 1000 - 100 THEN 'ready' ELSE 'waiting' END AS status FROM ev, n""")
def _(spark, sf):
    x = ev(spark, sf)
    n = x.agg(F.expr("max(t) div 2000 + min(t) div 2000").alias("now"))  # one row
    start = F.expr("t div 1000")
    return x.crossJoin(F.broadcast(n)).select("event_id", policies.status(start, start + F.col("value"), F.col("now")).alias("status"))


@query("str04_silence", """WITH x AS (SELECT user_id, event_id, value, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS later FROM events) SELECT user_id, event_id + i AS "at", CASE WHEN i = 0 THEN value ELSE 0 END AS value, i > 0 AS padded
FROM (SELECT *, unnest(range(0, coalesce(later - event_id, 1))) AS i FROM x)""")
def _(spark, sf):
    return policies.filled(tb(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")


@query("str05_dropouts", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1 HAVING count(*) < 64""")
def _(spark, sf):
    return policies.dropouts(tb(spark, sf, "events").select("ts"), "ts", "1 hour")


@query("str07_buffer_sizes", f"""WITH {EV}, m AS (SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS latency, event_id % 10 / 10 AS cpu FROM ev)
SELECT event_id, CAST(CASE WHEN latency > 10 OR cpu > 0.8 THEN 1280 WHEN latency < 5 AND cpu < 0.5 THEN 921 ELSE 1024 END AS INT) AS size FROM m""")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(-9, 0)
    x = ev(spark, sf).select("event_id", F.avg("value").over(w).alias("latency"), (F.col("event_id") % 10 / 10).alias("cpu"))
    return x.select("event_id", policies.next_size(F.lit(1024), F.col("latency"), F.col("cpu")).alias("size"))


@query("str15_advice", f"""WITH {EV}, p AS (SELECT event_id, lag(value) OVER {WD} AS a, value AS b FROM ev) SELECT event_id, CASE WHEN r > 1.1 AND q >= -0.05 THEN 'upgrade' WHEN q > 0.1 THEN 'quality' WHEN r < 0.9 THEN 'regression' ELSE 'mixed' END AS advice
FROM (SELECT event_id, CASE WHEN a > 0 THEN b / a ELSE 1 END AS r, (event_id % 5 - 2) / 8 AS q FROM p)""")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    x = ev(spark, sf).select("event_id", F.lag("value").over(w).alias("a"), F.col("value").alias("b"))
    return x.select("event_id", policies.advice(F.col("a"), F.col("b"), F.lit(0.0), (F.col("event_id") % 5 - 2) / 8).alias("advice"))


@query("str17_sizes", """SELECT event_id, CAST(floor(l / 1000.0 * 44100 * 1.5) AS INT) AS output, CAST(floor(l / 5.0) + 2 AS INT) AS input, CAST(floor(l / 1000.0 * 44100 * 1.5) AS INT) * 2 AS ring, l * 2 AS most_latency_ms FROM (SELECT event_id, event_id % 40 + 1 AS l FROM events)""")
def _(spark, sf):
    x = tb(spark, sf, "events").select("event_id", policies.sizes(F.lit(44100), F.lit(5.0), F.col("event_id") % 40 + 1).alias("s"))
    return x.select("event_id", "s.*")
