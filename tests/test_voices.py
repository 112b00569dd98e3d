"""Phonemes, flags, chains, synthesis, settings, containers and policies on hand-worked cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import phonemes as ph
from seqloom.operators import kernels, synthesis, voice
from seqloom.operators import statistics as st
from seqloom.sinks import container
from seqloom.sources import settings
from seqloom.streaming import policies


def test_phonemes(spark):
    df = spark.createDataFrame([("a",), ("A",), ("N",), ("n",), ("aa",), ("a:",), ("ts",), ("ʃ",), ("?",), ("",), (None,), ("r",)], "p string")
    got = {r.p: (r.c, r.b) for r in df.select("p", ph.category(ph.mask(F.col("p"))).alias("c"), ph.bits(ph.mask(F.col("p"))).alias("b")).collect()}
    assert {p: c for p, (c, _) in got.items()} == {
        "a": "vowel", "A": "vowel", "N": "nasal", "n": "nasal", "aa": "long_vowel", "a:": "long_vowel", "ts": "plosive", "ʃ": "fricative",
        "?": "silence", "": "silence", None: "silence", "r": "consonant",
    }
    assert len(got["a"][1]) == 32 and [i for i, x in enumerate(got["a"][1]) if x] == [0, 23, 27, 29]
    assert [i for i, x in enumerate(got["N"][1]) if x] == [1, 4, 16, 19]


def test_kana(spark):
    df = spark.createDataFrame([("さくら",), ("きっと?",), ("",), (None,)], "k string")
    assert [r[0] for r in df.select(ph.romaji(F.col("k"))).collect()] == ["sakura", "kixtuto?", "", None]
    back = spark.createDataFrame([("ji",), ("ya",), ("kya",), (None,)], "r string")
    assert [r[0] for r in back.select(ph.hiragana(F.col("r"))).collect()] == ["じ", "や", "kya", None]


def test_vectors(spark):
    none = F.lit(None)
    x = ph.position_vector([none] * 5, [none] * 6, none, none, [none] * 2)
    v = ph.context_vector([none] * 7, [x] * 7, [none] * 3, [none] * 3, [none, none, none, none, none])
    got = spark.range(1).select(v.alias("v"), ph.quinphone_vector([F.lit("sil"), F.lit("?"), none, F.lit("ka"), F.lit("cl")], [F.lit(0.0)] * 11).alias("q")).first()
    assert len(got.v) == 346 and sum(got.v) == pytest.approx(7 - 0.7, abs=1e-6)
    assert len(got.q) == 5 * len(ph.INVENTORY) + 11 and [i % len(ph.INVENTORY) for i, y in enumerate(got.q) if y] == [0, 1, 1, ph.CODES["ka"], ph.CODES["cl"]]


def test_flags(spark):
    rows = [(0, 0, 0, 0, None, None), (100, 0, 0, 0, "x", 220.0), (50, 50, 60, 40, "growl", 110.0), (0, 0, 100, 0, "Whisper", -1.0)]
    plain, formant, growl, whisper = voice.convert(spark.createDataFrame(rows, "g int, t int, bre int, bri int, voice string, f0 double")).collect()
    assert (plain.formant, plain.tension, plain.breath, plain.brightness, plain.emphasis, plain.aperiodicity) == (1, 0, 0, 1, 0, 1)
    assert formant.formant == pytest.approx(1.48)
    assert growl.emphasis == pytest.approx(0.36) and growl.tilt == -1 and growl.roughness == 0.4
    assert growl.tension == pytest.approx(np.tanh(0.5 * 1.8 * 1.5) * 0.8) and growl.breath == pytest.approx(0.6 * 0.8 * 1.3 * 0.7)
    assert whisper.breath == 1 and whisper.aperiodicity == 1.5


def paths(n, t):
    for p in itertools.product(range(n), repeat=t):
        if p[0] == 0 and p[-1] == n - 1 and all(b - a in (0, 1) for a, b in itertools.pairwise(p)):
            yield p


def test_chain_counts_equal_enumeration():
    r = np.random.default_rng(5)
    x, w = r.normal(size=(5, 2)), np.array([[0.3, 0.7], [1.0, 0.0], [0.5, 0.5]])
    means, variances = r.normal(size=(3, 2, 2)), r.random((3, 2, 2)) + 0.3
    steps = np.array([[0.6, 0.4, 0], [0, 0.7, 0.3], [0, 0, 1.0]])
    each = w * np.exp(kernels.log_density(x, means.reshape(6, 2), variances.reshape(6, 2)).reshape(5, 3, 2))
    total, s0, moves = 0.0, np.zeros((3, 2)), np.zeros((3, 3))
    for p in paths(3, 5):
        chance = np.prod([steps[a, b] for a, b in itertools.pairwise(p)]) * np.prod([each[i, s].sum() for i, s in enumerate(p)])
        total += chance
        for i, s in enumerate(p):
            s0[s] += chance * each[i, s] / each[i, s].sum()
        for a, b in itertools.pairwise(p):
            moves[a, b] += chance
    with np.errstate(divide="ignore"):
        got = kernels.chain_counts(x, w, means, variances, np.log(steps))
    assert np.allclose(got[0], s0 / total) and np.allclose(got[3], moves / total) and got[4] == pytest.approx(np.log(total))
    with np.errstate(divide="ignore"):
        assert kernels.chain_counts(x[:2], w, means, variances, np.log(steps))[4] == -np.inf


def test_training_a_chain(spark):
    r = np.random.default_rng(1)
    rows = [(u, i, [float(r.normal(4 * (i // 4), 0.5))]) for u in range(12) for i in range(12)]
    df = spark.createDataFrame([*rows, (99, 0, [1.0]), (98, 0, None)], "utt long, i int, x array<double>").repartition(3)
    start = np.array([[0.6, 0.4, 0], [0, 0.6, 0.4], [0, 0, 1.0]])
    given = (np.ones((3, 1)), np.array([[[1.0]], [[3.0]], [[6.0]]]), np.ones((3, 1, 1)), start)
    (w, m, v, a), trace = kernels.train_chain(df, ["utt"], "i", "x", *given, steps=12)
    assert all(b[0] >= a[0] - 1e-6 for a, b in itertools.pairwise(trace)) and trace[-1][0] > trace[0][0]
    assert np.allclose(m[:, 0, 0], [0, 4, 8], atol=0.4) and np.allclose(np.diag(a)[:2], 0.75, atol=0.05)
    _, held = kernels.train_chain(df, ["utt"], "i", "x", *given, steps=4, held_out=3)
    assert all(np.isfinite(x) and x != 0 for x in held[0])
    same, none = kernels.train_chain(df.where("false"), ["utt"], "i", "x", *given)
    assert np.allclose(same[1], given[1]) and len(none) == 1


def test_alignment_within_windows(spark):
    w = "array<struct<state: int, first: int, last: int>>"
    rows = [(u, i, [float(i // 2)], win) for u, win in ((1, None), (2, [(0, 0, 0)]), (3, [(2, 9, 9)])) for i in range(6)]
    df = spark.createDataFrame(rows, f"utt long, i int, x array<double>, w {w}")
    steps = np.array([[0.5, 0.5, 0], [0, 0.5, 0.5], [0, 0, 1.0]])
    got = kernels.align_within(df, ["utt"], "i", "x", "w", np.array([[0.0], [1.0], [2.0]]), np.full((3, 1), 0.05), steps)
    found = {u: [r.state for r in sorted(g, key=lambda r: r.i)] for u, g in itertools.groupby(sorted(got.collect(), key=lambda r: r.utt), key=lambda r: r.utt)}
    assert found == {1: [0, 0, 1, 1, 2, 2], 2: [0, 1, 1, 1, 2, 2], 3: [None] * 6}


def test_overlap(spark):
    df = spark.createDataFrame([("a", 0, [1.0, 2.0, 3.0]), ("a", 2, [1.0]), ("a", -1, [9.0, 1.0]), ("a", 5, None), ("b", 0, [])], "k string, p int, x array<double>")
    assert sorted((r["at"], r.x) for r in synthesis.overlap_added(df, ["k"], "p", "x").collect()) == [(0, 2.0), (1, 2.0), (2, 4.0)]
    ones = np.ones(4)
    assert np.allclose(synthesis.crossfade_add([ones, 3 * ones, ones], [0, 2, -1], 7, 2), [1, 1, 1, 3, 3, 3, 0])
    assert np.allclose(synthesis.crossfade_add([ones, ones], [0, 2], 5, 1), [1, 1, 2, 2, 1])


def test_synthesis_and_pitch(spark):
    level = [float(np.exp(-k / 12)) for k in range(65)]
    rows = [(u, i, 200.0 if u == 1 else None, level, [0.0] * 65) for u in (1, 2) for i in range(40)]
    df = spark.createDataFrame([*rows, (3, 0, None, None, None)], "utt long, i int, f0 double, spectrum array<double>, aperiodicity array<double>")
    made = synthesis.synthesised(df, "utt", "i", rate=8000, fft=128, fade=16).cache()
    got = {r.utt: np.array(r.samples) for r in made.collect()}
    assert len(got[1]) == 40 * 40 + 128 and 0 < np.abs(got[1]).max() <= 1 and not got[2].any() and not got[3].any()
    found = {r.utt: r.f0 for r in synthesis.pitch(made.select("utt", F.slice("samples", 401, 800).alias("x")), "utt", "x", 8000).collect()}
    assert found[1] == pytest.approx(200, rel=0.02) and found[2] == 0
    tone = spark.createDataFrame([(f, [float(np.sin(2 * np.pi * f * i / 16000)) for i in range(1600)]) for f in (90, 220, 500)] + [(0, []), (1, None), (2, [0.0] * 999)], "f long, x array<double>")
    assert {r.f: round(r.f0) for r in synthesis.pitch(tone, "f", "x", 16000).collect()} == {90: 90, 220: 220, 500: 500, 0: 0, 1: 0, 2: 0}


def test_variance_correction(spark):
    x = spark.createDataFrame([(1, "a", 0, v) for v in (-1.0, 1.0)] + [(1, "b", 1, 5.0), (1, "b", 1, 5.0)], "s int, label string, dim int, x double")
    goal = spark.createDataFrame([("a", 0, 2.25), ("b", 1, 1.0)], "label string, dim int, variance double")
    got = st.variance_corrected(x, ["s"], "label", "dim", "x", goal)
    assert sorted(r.corrected for r in got.collect()) == [-1.5, 1.5, 5.0, 5.0] and set(got.columns) == {"s", "label", "dim", "x", "corrected"}
    assert {r.label: round(r.weight, 6) for r in st.variance_weights(x, ["s"], "label", "dim", "x", goal).collect()} == {"a": round(1 + np.log(2.25), 6), "b": 1.0}


def test_settings(spark):
    df = spark.createDataFrame([(1, '{"world_config": {"q1": -0.2, "f0_floor": "low"}, "scanner_config": {"excluded_files": []}, "other": 1}'), (2, "no"), (3, ""), (4, None), (5, "[]")], "i int, t string")
    got = {r.i: r.c for r in df.select("i", settings.with_defaults(F.col("t"), settings.DEFAULTS).alias("c")).collect()}
    assert got[1].world_config.q1 == -0.2 and got[1].world_config.f0_ceil == 800 and got[1].scanner_config.excluded_files == []
    assert all(got[i].world_config.asDict() == settings.DEFAULTS["world_config"] and got[i].scanner_config.max_scan_depth == 5 for i in (2, 3, 4, 5))
    m = spark.createDataFrame([('{"name": "n", "tags": ["a"]}',), (None,)], "t string").select(settings.metadata(F.col("t")).alias("m")).collect()
    assert m[0].m.display_name == "n" and m[0].m.tags == ["a"] and m[1].m.language == "ja" and m[1].m.display_name == ""
    p = spark.createDataFrame([(1, '{"sample_rate": 8000, "frame_period": 5, "f0": [1, 2], "time_axis": [0.5]}'), (2, "{}"), (3, None)], "i int, t string")
    assert [(r.i, r.frame, r.time, r.f0) for r in settings.parameters(p, ["i"], "t").orderBy("frame").collect()] == [(1, 0, 0.5, 1.0), (1, 1, 0.005, 2.0)]
    lines = spark.createDataFrame([("pitch,a,b,2.5,1,-40,0",), ("# c",), ("",), ("x",), ("y,,,bad",), (None,)], "l string")
    assert [(r.kind, r.semitones, r.tilt_db) for r in settings.manifest(lines, [], "l").collect()] == [("pitch", 2.5, 0.0), ("x", None, None), ("y", None, None)]


def test_container(spark):
    part = {"weight": 1.0, "mean": [0.5, -1.0], "cov": [[1.0, 0.0], [0.0, 2.0]]}
    state = {"state_id": 3, "self_loop": 0.6, "next_state": 0.4, "exit": 0.0, "mixture": [part, {**part, "weight": 0.0}]}
    model = {**{n: {"s": "か", "I": 7, "i": -2, "d": 1.5}[k] for n, k in container.MODEL}, "states": [state]}
    data = container.encode([model, {**model, "name": "", "states": []}], '{"a": 1}')
    head = container.header(data)
    assert head["file_size"] == len(data) and head["metadata_at"] == 72 and container.decode(data) == ('{"a": 1}', [model, {**model, "name": "", "states": []}])
    assert container.decode(b"") is None and container.decode(data[:-1]) is None and container.decode(b"x" * 100) is None
    rows = spark.createDataFrame([("c", *model.values()), ("c", *{**model, "name": None, "states": None}.values()), ("d", *model.values())], f"k string, {container.MODEL_SCHEMA}")
    files = container.write_rows(rows, "k").unionByName(spark.createDataFrame([("bad", bytearray(b"zz")), ("none", None)], "k string, content binary"))
    got = container.read_rows(files, "k").orderBy("k", "name").collect()
    assert [(r.k, r.name, len(r.states)) for r in got] == [("c", "", 0), ("c", "か", 1), ("d", "か", 1)] and got[2].states[0].mixture[0]["cov"] == [[1.0, 0.0], [0.0, 2.0]]


def test_policies(spark):
    df = spark.createDataFrame([(1, 3000, 3100), (2, 1000, 1500), (3, 3100, 3200), (4, 3101, 3300), (5, 1900, 2000)], "i int, s long, e long")
    assert sorted(r.i for r in policies.released(df, "s", "e", F.lit(3000)).collect()) == [1, 3, 5]
    x = spark.createDataFrame([("a", 2, 1.0), ("a", 5, None), ("b", 1, 2.0)], "k string, at long, v double")
    got = sorted((r.k, r["at"], r.v, r.padded) for r in policies.filled(x, ["k"], "at", "v").collect())
    assert got == [("a", 2, 1.0, False), ("a", 3, 0.0, True), ("a", 4, 0.0, True), ("a", 5, 0.0, False), ("b", 1, 2.0, False)]
    size = lambda latency, cpu: policies.next_size(F.lit(260), F.lit(latency), F.lit(cpu))
    assert list(spark.range(1).select(size(20.0, 0.1), size(1.0, 0.1), size(7.0, 0.6), size(1.0, 0.9)).first()) == [325, 256, 260, 325]


def test_dropouts_stream(spark, tmp_path):
    spark.range(200).selectExpr("timestamp_micros(CASE WHEN id < 100 THEN id ELSE id * 100000 END) AS ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "in"))
    q = policies.dropouts(stream, "ts").writeStream.format("memory").queryName("drops").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("drops").count() == 10 and {r.n for r in spark.table("drops").collect()} == {10}


def test_silence_is_laid_side_by_side(spark, tmp_path):
    rows = [(k, k * 37 % 1500 - 700 + 1511 * i, float(i)) for k in range(40) for i in range(12)]
    x = spark.createDataFrame(rows, "k long, at long, v double")
    policies.filled(x, ["k"], "at", "v").write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("k", "at").distinct().count() == 40 * (11 * 1511 + 1)
    assert sorted(tuple(r) for r in got.where("NOT padded").collect()) == sorted((*r, False) for r in rows)
    assert got.agg(F.sum("v")).first()[0] == 40 * 66 and {r[1] for r in got.groupBy("k").agg(F.max("at") - F.min("at")).collect()} == {11 * 1511}
    # the file repeats itself: under two bytes a row, where position after position of one key takes four
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 2 * got.count()
    few = policies.filled(x, ["k"], "at", "v", together=3, at_once=1000)
    assert few.exceptAll(got).isEmpty() and got.exceptAll(few).isEmpty()
    assert policies.filled(x.where("k < 0"), ["k"], "at", "v").isEmpty()


def test_a_long_silence_is_dealt_to_many_tasks(spark):
    x = spark.createDataFrame([(1, 0, 2.0), (1, 1_000_000, None), (2, 7, 1.0), (None, None, 3.0)], "k int, at long, v double")
    got = policies.filled(x, ["k"], "at", "v", at_once=1 << 16)
    assert sorted(map(tuple, got.where("NOT padded").collect())) == [(1, 0, 2.0, False), (1, 1_000_000, 0.0, False), (2, 7, 1.0, False)]
    assert got.count() == got.select("k", "at").distinct().count() == 1_000_002 and got.agg(F.sum("v")).first()[0] == 3
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 150_000  # of one task; half of the silence before
