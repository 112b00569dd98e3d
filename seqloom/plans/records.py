"""Queries of readers and writers, transforms, augmentation and model tables, with their SQL counterparts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seqloom.functions import signal, text
from seqloom.operators import augment, kernels, spectra
from seqloom.operators import model_store as ms
from seqloom.plans.catalogue import _DIMS, query, rnd, tb
from seqloom.sinks import forms
from seqloom.sources import binary, text_entries
from seqloom.streaming import telemetry


def _vectors(spark, sf):
    return tb(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("e"))


def _wavs(spark, sf):
    """A file of 16 bits for each vector, its values from -1 to 1 in steps of 1 / 32767."""
    x = _vectors(spark, sf).select("vec_id", F.transform("e", lambda v: F.round(v * 8000) / 32767).alias("samples"), (8000 + F.col("vec_id") % 5).cast("int").alias("rate"), F.lit(1).alias("channels"))
    return forms.wav(x, "vec_id")


@query("src07_wav_headers", """SELECT vec_id, CAST(8000 + vec_id % 5 AS BIGINT) AS rate, CAST(1 AS BIGINT) AS channels, CAST(16 AS BIGINT) AS bits, round(64 * 1000.0 / (8000 + vec_id % 5), 5) AS duration_ms FROM embeddings""")
def _(spark, sf):
    x = text_entries.wav_header(_wavs(spark, sf))
    return x.select("vec_id", *(F.col(c).cast("long").alias(c) for c in ("rate", "channels", "bits")), F.round("duration_ms", 5).alias("duration_ms"))


@query("src09_wav_samples", f"""WITH {_DIMS} SELECT vec_id, CAST(dim AS INT) AS i, round(greatest(-32767, least(32767, round(x * 8000))) / 32768, 6) AS x FROM dims""")
def _(spark, sf):
    return rnd(binary.read_wav(_wavs(spark, sf), "vec_id").select("vec_id", F.posexplode("samples").alias("i", "x")), "x")


@query("arr01_mono", f"""WITH {_DIMS} SELECT vec_id, CAST(dim // 2 AS INT) AS i, round(avg(greatest(-32767, least(32767, round(x * 8000))) / 32768), 6) AS x FROM dims GROUP BY 1, 2""")
def _(spark, sf):
    x = _vectors(spark, sf).select("vec_id", F.transform("e", lambda v: F.round(v * 8000) / 32767).alias("samples"), F.lit(8000).alias("rate"), F.lit(2).alias("channels"))
    return rnd(binary.read_wav(forms.wav(x, "vec_id"), "vec_id", mono=True).select("vec_id", F.posexplode("samples").alias("i", "x")), "x")


def _midi(tracks: int) -> bytes:
    """A format 1 file: a tempo, then on each track notes that overlap, one of them left open."""
    def chunk(kind: bytes, body: bytes) -> bytes:
        return kind + len(body).to_bytes(4, "big") + body

    def track(t: int) -> bytes:
        body = b"\x00\xff\x51\x03\x07\xa1\x20" if t == 0 else b""
        for k in range(4):
            body += bytes([0, 0x90, 60 + k, 100, 96, 0x80, 60 + k, 0])
        return chunk(b"MTrk", body + b"\x00\x90\x30\x40\x00\xff\x2f\x00")

    return chunk(b"MThd", (1).to_bytes(2, "big") + tracks.to_bytes(2, "big") + (480).to_bytes(2, "big")) + b"".join(track(t) for t in range(tracks))


def _midis(spark, sf):
    """A file of one to three tracks for each supplier."""
    files = F.create_map(*(F.lit(x) for n in (1, 2, 3) for x in (n, _midi(n))))
    return tb(spark, sf, "supplier").select("s_suppkey", files[(F.col("s_suppkey") % 3 + 1).cast("int")].alias("content"))


@query("src11_midi_events", """SELECT s_suppkey, 1 + 9 * (s_suppkey % 3 + 1) AS events FROM supplier""")
def _(spark, sf):
    x = binary.read_midi(_midis(spark, sf), "s_suppkey").where("kind IN ('on', 'off', 'tempo')")
    return x.groupBy("s_suppkey").agg(F.count("*").alias("events"))


@query("src12_midi_notes", """SELECT s_suppkey, CAST(t AS INT) AS track, 60 + k AS note, CAST(k * 96 AS BIGINT) AS start, CAST((k + 1) * 96 AS BIGINT) AS stop FROM supplier, range(3) a(t), range(4) b(k) WHERE t <= s_suppkey % 3
UNION ALL SELECT s_suppkey, CAST(t AS INT), 48, 384, NULL FROM supplier, range(3) a(t) WHERE t <= s_suppkey % 3""")
def _(spark, sf):
    x = binary.notes(binary.read_midi(_midis(spark, sf), "s_suppkey"), "s_suppkey")
    return x.select("s_suppkey", F.col("track").cast("int"), F.col("note").cast("int"), F.col("start").cast("long"), F.col("stop").cast("long"))


@query("src13_labels", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id * 10 END AS start, CASE WHEN event_id % 3 = 0 THEN event_id * 10 + 5 END AS "end", CASE WHEN event_id % 3 = 0 THEN event_type || ' x' WHEN event_id % 3 = 1 THEN event_type END AS label FROM events WHERE event_id % 3 < 2""")
def _(spark, sf):
    i = F.col("event_id")
    line = F.when(i % 3 == 0, F.format_string("%d %d  %s x", i * 10, i * 10 + 5, "event_type")).when(i % 3 == 1, F.concat(F.lit("  "), "event_type")).otherwise("# none")
    lines = tb(spark, sf, "events").select("event_id", F.lit(0).alias("n"), line.alias("line"))
    return text_entries.labels(lines, ["event_id"], "n", "line").select("event_id", "start", "end", "label")


@query("snk02_label_lines", """SELECT event_id, CAST(event_id * 10000 AS VARCHAR) || ' ' || CAST((event_id + 7) * 10000 AS VARCHAR) || ' ' || event_type AS line FROM events""")
def _(spark, sf):
    i = F.col("event_id")
    return tb(spark, sf, "events").select("event_id", forms.label_line(i, i + 7, F.col("event_type")).alias("line"))


@query("fn_s02_decoded", """SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents""")
def _(spark, sf):
    raw = F.coalesce("text", F.lit("")).cast("binary")
    marked = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(b"\xef\xbb\xbf"), raw)).otherwise(raw)
    return tb(spark, sf, "documents").select("doc_id", F.sha2(text.decoded(marked).cast("binary"), 256).alias("digest"))


@query("fn_s03_path", """SELECT event_id, 'a/' || event_type || '/b' AS path FROM events""")
def _(spark, sf):
    return tb(spark, sf, "events").select("event_id", text.path(F.concat(F.lit("a\\"), "event_type", F.lit("\\b"))).alias("path"))


@query("fn_s10_flags", """SELECT event_id, CAST(event_id % 90 AS INT) AS g, CAST(-(event_id % 7) AS INT) AS bre, CAST(NULL AS INT) AS t FROM events""")
def _(spark, sf):
    i = F.col("event_id")
    x = tb(spark, sf, "events").select("event_id", F.concat(F.lit("G-5Bre-"), (i % 7).cast("string"), F.lit("g"), (i % 90).cast("string")).alias("f"))
    return x.select("event_id", signal.flags("f").alias("m")).select("event_id", F.col("m")["g"].alias("g"), F.col("m")["bre"].alias("bre"), F.col("m")["t"].alias("t"))


@query("arr05_pitch_shift", f"""WITH {_DIMS} SELECT vec_id, CAST(dim AS INT) AS i, round(CASE WHEN x > 0 THEN greatest(50, least(1000, x * 400 * pow(2, 2.5 / 12))) ELSE x * 400 END, 4) AS x FROM dims""")
def _(spark, sf):
    x = _vectors(spark, sf).select("vec_id", F.transform("e", lambda v: v * 400).alias("e"))
    return x.select("vec_id", F.posexplode(signal.pitch_shift("e", 2.5)).alias("i", "x")).withColumn("x", F.round("x", 4))


@query("arr04_stretched", f"""WITH i AS (SELECT vec_id, embedding AS e, unnest(range(0, 51)) AS i FROM embeddings) SELECT vec_id, CAST(i AS INT) AS i, round(e[k + 1] + (coalesce(e[k + 2], e[k + 1]) - CAST(e[k + 1] AS DOUBLE)) * (i * 1.25 - k), 5) AS x FROM (SELECT *, CAST(floor(i * 1.25) AS INT) AS k FROM i)""")
def _(spark, sf):
    x = _vectors(spark, sf).select("vec_id", F.posexplode(augment.stretched_by(F.col("e"), F.lit(1.25))).alias("i", "x"))
    return x.withColumn("x", F.round("x", 5))


def _unit(seed, *keys):
    """SQL for the number that augment.unit draws."""
    return f"(CAST(concat('0x', substr(sha256(concat_ws(':', {', '.join(keys)}, {seed})), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def _normal(seed, *keys):
    return f"(sqrt(-2 * ln(1 - {_unit(seed, *keys)})) * cos(2 * pi() * {_unit(seed + 1, *keys)}))"


def _between(r, seed):
    return f"({r[0]} + {_unit(seed, 'vec_id')} * {r[1] - r[0]})"


_MADE = f"""s AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e, {_between(augment.PITCH, 43)} AS pitch, {_between(augment.STRETCH, 44)} AS stretch, {_between(augment.TILT, 45)} AS tilt,
{augment.NOISE_DB[0]} + greatest(-{augment.NOISE_DB[2]}, least({augment.NOISE_DB[2]}, {augment.NOISE_DB[1]} * {_normal(51, 'vec_id')})) AS noise FROM embeddings),
m AS (SELECT vec_id, 'original' AS kind, 0.0 AS amount, e AS x FROM s
UNION ALL SELECT vec_id, 'pitch', pitch, [CASE WHEN v > 0 THEN greatest(50, least(1000, v * pow(2, pitch / 12))) ELSE v END FOR v IN e] FROM s
UNION ALL SELECT vec_id, 'time', stretch, list_transform(range(0, CAST(floor(64 / stretch) AS INT)), lambda i: e[CAST(floor(i * stretch) AS INT) + 1] + (coalesce(e[CAST(floor(i * stretch) AS INT) + 2], e[CAST(floor(i * stretch) AS INT) + 1]) - e[CAST(floor(i * stretch) AS INT) + 1]) * (i * stretch - floor(i * stretch))) FROM s
UNION ALL SELECT vec_id, 'noise', noise, [e[i + 1] * (1 + pow(10, noise / 20) * {_normal(62, 'vec_id', 'i')}) FOR i IN range(0, 64)] FROM s
UNION ALL SELECT vec_id, 'tilt', tilt, [e[i + 1] + ln(pow(10, tilt * i / 63 / 20)) FOR i IN range(0, 64)] FROM s)"""


@query("arr08_augmented", f"""WITH {_MADE} SELECT vec_id, kind, round(amount, 6) AS amount, len(x) AS n, round(list_sum([x[i] * i FOR i IN range(1, len(x) + 1)]), 2) AS checksum FROM m""")
def _(spark, sf):
    """``checksum``: the values, each times its place from 1."""
    x = augment.augmented(_vectors(spark, sf), "vec_id", "e")
    sums = F.aggregate(F.transform("values", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return x.select("vec_id", "kind", F.round("amount", 6).alias("amount"), F.size("values").cast("long").alias("n"), F.round(sums, 2).alias("checksum"))


@query("arr06_noise_level", f"""SELECT vec_id, CAST(i AS INT) AS i, round(CAST(embedding[i + 1] AS DOUBLE) * (1 + 0.01 * {_normal(7, 'vec_id', 'i')}), 6) AS x FROM (SELECT *, unnest(range(0, 64)) AS i FROM embeddings)""")
def _(spark, sf):
    noise = augment.noisy(F.col("e"), F.lit(-40.0), 7, F.col("vec_id"))
    return _vectors(spark, sf).select("vec_id", F.posexplode(noise).alias("i", "x")).withColumn("x", F.round("x", 6))


@query("arr14_transform_and_back", f"""WITH {_DIMS} SELECT vec_id, CAST(dim AS INT) AS i, round(x, 5) AS x FROM dims""")
def _(spark, sf):
    x = spectra.inverse(spectra.forward(_vectors(spark, sf), "vec_id", "e"), "vec_id")
    return x.select("vec_id", F.posexplode("values").alias("i", "x")).withColumn("x", F.round("x", 5))


@query("arr14_terms", f"""WITH {_DIMS}, k AS (SELECT unnest(range(0, 33)) AS k) SELECT vec_id, CAST(k AS INT) AS k, round(sum(x * cos(2 * pi() * k * dim / 64)), 4) AS re, round(-sum(x * sin(2 * pi() * k * dim / 64)), 4) AS im FROM dims, k GROUP BY ALL""")
def _(spark, sf):
    x = spectra.forward(_vectors(spark, sf), "vec_id", "e").select("vec_id", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    return x.select("vec_id", "k", F.round("z.re", 4).alias("re"), F.round("z.im", 4).alias("im"))


@query("arr13_window_figures", """WITH w AS (SELECT vec_id, abs(x) * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS x FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)) SELECT vec_id, round(avg(x), 5) AS gain, round(64 * sum(x * x) / (sum(x) * sum(x)), 5) AS bandwidth FROM w GROUP BY 1""")
def _(spark, sf):
    """A Hann window weighted by the sizes of each row's values."""
    x = _vectors(spark, sf).select("vec_id", F.zip_with("e", signal.window("hann", 64), lambda v, w: F.abs(v) * w).alias("w"))
    return spectra.window_figures(x, "vec_id", "w").select("vec_id", F.round(F.col("figures")[0], 5).alias("gain"), F.round(F.col("figures")[1], 5).alias("bandwidth"))


# Models: a model for each supplier, its states by nation.
def _models(spark, sf):
    n = (F.col("s_nationkey") % 4 + 1).cast("int")
    state = F.struct(F.array_repeat(F.lit(1.0), 3).alias("mixtures"))
    return tb(spark, sf, "supplier").select(F.concat(F.lit("m"), (F.col("s_suppkey") % 90).cast("string"), F.lit("_x")).alias("name"), F.array_repeat(state, n).alias("states"), n.alias("n_states"), (F.col("s_nationkey") % 2).alias("dims"), F.abs("s_acctbal").alias("variance"))


@query("ag12_model_totals", """SELECT count(*) AS models, CAST(sum(s_nationkey % 4 + 1) AS BIGINT) AS states, CAST(sum((s_nationkey % 4 + 1) * 3) AS BIGINT) AS mixtures FROM supplier""")
def _(spark, sf):
    return ms.totals(_models(spark, sf))


@query("ag11_consistency", """WITH m AS (SELECT s_suppkey % 90 AS n, s_nationkey % 4 + 1 AS st, s_nationkey % 2 AS d, abs(s_acctbal) AS v FROM supplier), s AS (SELECT count(DISTINCT st) AS state_counts, count(DISTINCT d) AS dimensions, max(v) FILTER (WHERE v > 0) / min(v) FILTER (WHERE v > 0) AS r, avg(v) AS mu, stddev_pop(v) AS sd FROM m)
SELECT (SELECT count(*) FROM (SELECT n FROM m GROUP BY 1 HAVING count(*) > 1)) AS duplicates, state_counts, dimensions, round(r, 4) AS variance_ratio, (SELECT count(*) FROM m, s WHERE sd > 0 AND abs(v - mu) > 1.5 * sd) AS outliers FROM s""")
def _(spark, sf):
    return ms.consistency(_models(spark, sf), "name", "n_states", "dims", "variance", 1.5).withColumn("variance_ratio", F.round("variance_ratio", 4))


@query("ag13_distribution", """WITH m AS (SELECT DISTINCT 'm' || (s_suppkey % 90) || '_x' AS name FROM supplier) SELECT name, count(*) AS n FROM m JOIN (SELECT 'm' || (l_suppkey % 120) || '_x' AS name FROM lineitem) USING (name) GROUP BY 1""")
def _(spark, sf):
    c = tb(spark, sf, "lineitem").select(F.concat(F.lit("m"), (F.col("l_suppkey") % 120).cast("string"), F.lit("_x")).alias("name"))
    return ms.distribution(c, _models(spark, sf))


@query("srt04_names", """SELECT DISTINCT 'm' || (s_suppkey % 90) || '_x' AS name, 'm' || (s_suppkey % 90) AS phoneme FROM supplier""")
def _(spark, sf):
    return ms.names(_models(spark, sf)).select("name", ms.prefix(F.col("name")).alias("phoneme"))


@query("sup13_without", """SELECT 'm' || (s_suppkey % 90) || '_x' AS name, count(*) AS n FROM supplier WHERE s_suppkey % 90 > 4 GROUP BY 1""")
def _(spark, sf):
    gone = spark.range(5).select(F.concat(F.lit("m"), F.col("id").cast("string"), F.lit("_x")).alias("name"))
    return ms.without(_models(spark, sf), gone).groupBy("name").agg(F.count("*").alias("n"))


@query("ag36_weighted_score", """SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS score FROM lineitem GROUP BY 1""")
def _(spark, sf):
    return rnd(ms.weighted_score(tb(spark, sf, "lineitem"), ["l_suppkey"], "l_discount", "l_quantity"), "score")


@query("ml14_distances", f"""WITH p AS (SELECT a.vec_id, CAST(unnest(a.embedding) AS DOUBLE) AS x, CAST(unnest(b.embedding) AS DOUBLE) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(sum(abs(x - y)), 4) AS l1, round(sqrt(sum((x - y) * (x - y))), 4) AS l2 FROM p GROUP BY 1""")
def _(spark, sf):
    e = _vectors(spark, sf)
    x = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")
    a, b = ms.transition_distance(F.col("e"), F.col("f"))
    return x.select("vec_id", F.round(a, 4).alias("l1"), F.round(b, 4).alias("l2"))


@query("flt17_variances_valid", """SELECT vec_id, len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) * x - 0.00001 < 1e-6)) = 0 AS valid FROM embeddings""")
def _(spark, sf):
    return _vectors(spark, sf).select("vec_id", ms.variance_valid(F.col("e"), F.transform("e", lambda v: v * v - 0.00001), 64).alias("valid"))


@query("flt18_mixtures_valid", """SELECT vec_id, embedding[1] >= 0 AND len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) + 3 <= 0)) = 0 AS valid FROM embeddings""")
def _(spark, sf):
    return _vectors(spark, sf).select("vec_id", ms.mixture_valid(F.col("e")[0], F.transform("e", lambda v: v + 3)).alias("valid"))


@query("flt19_trajectory_inputs", """SELECT l_orderkey, l_linenumber, l_linenumber > 2 AS valid FROM lineitem""")
def _(spark, sf):
    n = F.col("l_linenumber")
    ones = F.array(F.lit(1.0), F.lit(2.0))
    return tb(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ms.trajectory_inputs_valid(ones, ones, F.array(n - 2, F.lit(3))).alias("valid"))


@query("ag32_merged_variance", """SELECT event_type, round(sum(v * n) / sum(n), 5) AS variance, CAST(sum(n) AS BIGINT) AS count FROM (SELECT event_type, user_id % 3 AS s, var_pop(value) AS v, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    sets = tb(spark, sf, "events").groupBy("event_type", F.col("user_id") % 3).agg(F.var_pop("value").alias("v"), F.count("*").alias("n"))
    return ms.merged_variance(sets, ["event_type"], "v", "n").withColumn("variance", F.round("variance", 5))


@query("jn26_best_match", """SELECT n_regionkey, arg_min(n_name, (-s, n_name)) AS n_name FROM (SELECT n_regionkey, n_name, sum(s_acctbal) AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) GROUP BY 1""")
def _(spark, sf):
    x = tb(spark, sf, "supplier").join(F.broadcast(tb(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").agg(F.sum("s_acctbal").alias("s"))
    return ms.best_match(x, ["n_regionkey"], "s", "n_name")


@query("jn24_compatibility", """SELECT l_orderkey, l_linenumber, CASE WHEN a = 1 AND b = 2 THEN 'migrate' WHEN a = b THEN 'same' WHEN a < b THEN 'upgrade' ELSE 'unsupported' END AS verdict, b >= a AND b - a <= 1 AS safe, CASE WHEN a <= b THEN array_to_string(range(a, b + 1), '>') ELSE array_to_string(list_reverse(range(b, a + 1)), '>') END AS path FROM (SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS a, l_partkey % 4 AS b FROM lineitem)""")
def _(spark, sf):
    a, b = (F.col("l_linenumber") % 3).cast("int"), (F.col("l_partkey") % 4).cast("int")
    x = tb(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))
    table = spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("b"), F.lit("migrate").alias("verdict"))
    return ms.compatibility(x, table, "a", "b", "verdict").select("l_orderkey", "l_linenumber", "verdict", ms.migration_safe(F.col("a"), F.col("b")).alias("safe"), F.array_join(ms.path(F.col("a"), F.col("b")).cast("array<string>"), ">").alias("path"))


@query("set04_fields", """SELECT n_name AS field, CASE WHEN 3 < n_regionkey THEN 'absent' WHEN 3 >= n_nationkey THEN 'removed' WHEN 3 >= n_nationkey // 2 THEN 'deprecated' ELSE 'current' END AS state FROM nation""")
def _(spark, sf):
    rules = tb(spark, sf, "nation").select(F.col("n_name").alias("field"), F.col("n_regionkey").alias("added"), F.floor(F.col("n_nationkey") / 2).alias("deprecated"), F.col("n_nationkey").alias("removed"))
    return ms.fields(rules, F.lit(3)).select("field", "state")


@query("str14_alerts", """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, max(value) AS l, max(event_id % 100) AS c FROM events GROUP BY 1) SELECT start, 'latency' AS alert FROM w WHERE l > 50 UNION ALL SELECT start, 'cpu' FROM w WHERE c > 80""")
def _(spark, sf):
    x = tb(spark, sf, "events").select("ts", F.col("value").alias("latency"), (F.col("event_id") % 100).cast("double").alias("cpu"), F.lit(0.0).alias("util"), F.lit(0).alias("underruns"), F.lit(0).alias("overflows"))
    return telemetry.alerts(telemetry.windows(x, size="1 hour")).select("start", "alert")


@query("ml02_responsibilities", f"""WITH {_DIMS}, d AS (SELECT vec_id, sum(-0.5 * (x * x + ln(2 * pi()))) AS a, sum(-0.5 * ((x - 0.1) * (x - 0.1) + ln(2 * pi()))) AS b FROM dims GROUP BY 1) SELECT vec_id, round(1 / (1 + exp(ln(0.7 / 0.3) + b - a)), 4) AS first FROM d""")
def _(spark, sf):
    means, ones = np.stack([np.zeros(64), np.full(64, 0.1)]), np.ones((2, 64))
    x = kernels.posteriors(_vectors(spark, sf), "vec_id", "e", np.array([0.3, 0.7]), means, ones)
    return x.select("vec_id", F.round(F.col("posterior")[0], 4).alias("first"))
