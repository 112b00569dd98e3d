"""p-values against tables, windows whose overlapped squares are one, energies of tones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import context_labels, significance
from seqloom.operators import adaptive, analysis, voice
from seqloom.sources import arguments

# Tabled two-sided 5 % and 1 % points of Student's t.
TABLE = {1: (12.706, 63.657), 2: (4.303, 9.925), 3: (3.182, 5.841), 5: (2.571, 4.032), 10: (2.228, 3.169), 30: (2.042, 2.750), 120: (1.980, 2.617)}


def test_critical_values_and_p_equal_tables(spark):
    df = spark.createDataFrame([(k,) for k in TABLE], "k int")
    got = df.select("k", significance.critical(0.95, F.col("k")).alias("a"), significance.critical(0.99, F.col("k")).alias("b")).collect()
    assert all(abs(r.a - TABLE[r.k][0]) < 6e-4 and abs(r.b - TABLE[r.k][1]) < 6e-4 for r in got)
    rows = spark.createDataFrame([(r.k, t, p) for r in got for t, p in ((r.a, 0.05), (-r.b, 0.01))], "k int, t double, p double")
    assert all(abs(r.q - r.p) < 1e-9 for r in rows.withColumn("q", significance.two_sided(F.col("t"), F.col("k"))).collect())


def by_integration(t, df):
    a = np.linspace(math.atan(abs(t) / math.sqrt(df)), math.pi / 2, 400_001)
    y = np.cos(a) ** (df - 1)
    y[-1] = 1.0 if df == 1 else 0.0
    whole = 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return whole * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (a[1] - a[0]) / 3


def test_p_equals_integration(spark):
    cases = [(t, k) for k in (1, 2, 7, 50, 999, 20_000) for t in (0.0, 0.01, 0.7, 1.5, 3.0, 12.0)]
    rows = spark.createDataFrame(cases, "t double, k int").withColumn("p", significance.two_sided(F.col("t"), F.col("k"))).collect()
    assert all(abs(r.p - by_integration(r.t, r.k)) < 1e-7 for r in rows)


def test_samples_without_spread(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0), ("b", 2.0), ("c", 5.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r for r in significance.one_sample(df, ["k"], "x", 1.0).collect()}
    assert got["a"].n == 2 and got["a"].t == pytest.approx(1.0) and got["a"].p == pytest.approx(0.5)
    assert got["a"].high - 2 == pytest.approx(12.7062, abs=1e-3)
    assert all(got[k].t is None and got[k].p is None and got[k].low is None for k in "bcd")
    two = significance.two_samples(df.where("x IS NOT NULL").withColumn("g", F.lit(0)), ["g"], "x", F.col("k") == "c").first()
    want = (2.0 - 5.0) / math.sqrt(2 / 3)
    assert (two.n1, two.n2) == (4, 1) and two.d == pytest.approx(want) and two.t == pytest.approx(want / math.sqrt(1.25))
    assert significance.two_samples(df.where("k = 'c'"), ["k"], "x", F.col("x") > 9).first().t is None


def test_tapers_and_fades():
    w = np.ones(50)
    f = adaptive.faded(w, 0.8)
    assert f[0] == 0 and f[2] == pytest.approx(0.5**1.8) and f[4] == 1 and (f[25:27] == pytest.approx(1.04)) and f[27] == 1
    n = np.arange(64)
    low = np.hanning(64)
    t = adaptive.tapered(low, -60.0)
    assert t[0] == 0 and np.allclose(t[25:40], low[25:40]) and (t <= low + 1e-12).all() and t.sum() < low.sum()
    assert np.array_equal(adaptive.tapered(low, 20.0), low)
    assert np.array_equal(adaptive.tapered(np.zeros(8)), np.zeros(8))
    for hop in (1, 7, 16, 64):
        s = adaptive.normalised(0.1 + np.sin(n), hop) ** 2
        sums = np.bincount(n % hop, s, hop)
        assert np.allclose(sums, 1)


@pytest.mark.parametrize("length,hop", [(16, 4), (15, 4), (8, 8)])
def test_overlap_returns_ones(spark, length, hop):
    ones = spark.createDataFrame([("u", i, 1.0) for i in range(60)] + [("v", 3, 1.0), ("w", None, 1.0), ("w", 1, None)], "k string, i int, x double")
    frames = adaptive.cut(ones, ["k"], "i", "x", length, hop)
    assert frames.where("k <> 'u'").count() == 0 and frames.count() == (60 - length) // hop + 1
    # without overlap, nothing makes up for a tapered end
    shapes = adaptive.windows(spark, length, hop) if hop < length else adaptive.windows(spark, length, hop, None, None)
    whole = adaptive.overlapped(frames.withColumn("kind", F.lit("kaiser")), ["k"], shapes, hop).collect()
    inner = [r.value for r in whole if length - hop <= r["at"] < ((60 - length) // hop) * hop]
    assert len(inner) >= 30 and np.allclose(inner, 1)
    with pytest.raises(ValueError, match="hop"):
        adaptive.windows(spark, 8, 9)


def test_choice_by_content(spark):
    flat, steep = [0.0] * 64, [-i * 1.0 for i in range(64)]
    bumps = [(-1.0 if i not in (4, 9) else 3.0) - i * 0.1 for i in range(64)]
    rows = [(1, 150.0, flat, [0.1]), (2, 250.0, flat, [0.1]), (3, 150.0, flat, [0.9]), (4, 150.0, bumps, [0.9]), (5, 150.0, steep, None), (6, 150.0, [], [0.0]), (7, None, None, None), (8, None, flat, [0.0])]
    df = spark.createDataFrame(rows, "id int, f double, s array<double>, a array<double>")
    c = {r.id: r for r in df.select("id", adaptive.content(F.col("f"), F.col("s"), F.col("a"), 16_000.0).alias("c")).select("id", "c", adaptive.choice(F.col("c")).alias("kind")).collect()}
    assert {i: r.kind for i, r in c.items()} == {1: "blackman_harris", 2: "blackman", 3: "tukey", 4: "kaiser", 5: "blackman_harris", 6: "hann", 7: "hann", 8: "blackman"}
    assert c[4].c.formants == [500.0, 1125.0] and c[6].c.centroid == 1000.0 and c[6].c.harmonic_ratio == 0.7 and c[5].c.dynamic_range == 63.0


def test_energies_of_tones(spark):
    t = np.arange(64)
    two = np.sin(2 * np.pi * 4 * t / 64) + 0.5 * np.sin(2 * np.pi * 28 * t / 64)
    rows = [(1, two.tolist()), (2, [3.0] * 15), (3, []), (4, None), (5, [2.0]), (6, [1.0, -1.0] * 8)]
    df = spark.createDataFrame(rows, "id int, samples array<double>").repartition(1)
    got = {r.id: r for r in adaptive.spectral_bands(df).withColumn("c", adaptive.crossings(F.col("samples"))).withColumn("p", adaptive.peaks(F.col("samples"))).collect()}
    assert np.allclose(got[1].bands, [32, 0, 0, 8]) and np.isclose(sum(got[1].bands), (two**2).sum())
    assert np.allclose(got[2].bands, [135, 0, 0, 0]) and got[3].bands == [0, 0, 0, 0] and got[4].bands == [0, 0, 0, 0]
    assert np.allclose(got[6].bands, [0, 0, 0, 16]) and got[6].c == 1.0 and got[2].c == 0 and got[5].c == 0
    assert got[2].p == [9, 9, 9] and got[5].p == [0, 0, 4] and got[3].p == [0, 0, 0]


def test_context_labels(spark):
    names = "l2 l1 c r1 r2 syllables_from_start syllables_to_end syllable_position syllable_length word_position word_length words_from_start words_to_end phrase_syllables phrase_words beat stress_level".split()
    fields = {k: F.lit(k if k in ("l2", "l1", "c", "r1", "r2") else i) for i, k in enumerate(names)}
    fields |= {"pitch_cents": F.lit(-1.7), "duration_ms": F.lit(250.9), "tempo": F.lit(None).cast("double"), "stressed": F.lit(True), "accented": F.lit(None).cast("boolean")}
    got = spark.range(1).select(context_labels.context_label(fields).alias("a"), context_labels.context_text(fields | {"r2": F.lit(None).cast("string")}).alias("b")).first()
    assert got.a == "/A:5_6/B:7_8/C:l2-l1+c++r1+r2/D:9_10/E:11_12/F:13_14/G:-1_250/H:_15/I:1_0_16"
    assert got.b == "Context[l2-l1-c+r1+ | syl:7/8 | word:9/10 | pitch:-1.7c | dur:250.9ms]"
    with pytest.raises(KeyError):
        context_labels.context_label({})


def test_label_files_are_in_order(spark):
    rows = spark.createDataFrame([("u", 2, 20.0, 30.0, "b"), ("u", 1, 20.0, 25.0, "a"), ("u", 3, 0.5, 20.0, "x"), ("v", 1, 0.0, 1.0, "y")], "k string, i int, s double, e double, l string").repartition(3)
    got = {r.k: (r.lines, r.content) for r in context_labels.label_files(rows, ["k"], "s", "e", "l", "i").collect()}
    assert got == {"u": (3, "5000 200000 x\n200000 250000 a\n200000 300000 b\n"), "v": (1, "0 10000 y\n")}
    assert context_labels.label_files(rows.limit(0), ["k"], "s", "e", "l", "i").count() == 0


def vowel(f0, formants, rate=16_000, n=1024, seed=None):
    """A train of pulses (or noise) through resonances."""
    t = np.arange(4 * n)
    x = np.where((t * f0 / rate) % 1 < f0 / rate, 1.0, 0.0) if seed is None else np.random.default_rng(seed).normal(size=len(t))
    for f, width in formants:
        r = np.exp(-np.pi * width / rate)
        a, b = 2 * r * np.cos(2 * np.pi * f / rate), -r * r
        y = np.zeros(len(x))
        for i in range(len(x)):
            y[i] = x[i] + (a * y[i - 1] if i else 0) + (b * y[i - 2] if i > 1 else 0)
        x = y
    return x[-n:]


@pytest.mark.parametrize("f0", [100.0, 125.0, 200.0])
def test_envelope_has_the_vowels_formants(f0):
    formants = [(700.0, 80.0), (1800.0, 100.0)]
    x = vowel(f0, formants)[None]
    found, strength = analysis.pitches(x, 16_000.0)
    assert abs(found[0] - f0) < 0.01 * f0 and strength[0] > 0.8
    e = analysis.envelopes(x, 16_000.0, found, 1024)[0]
    peaks = [i * 16_000 / 1024 for i in range(2, 300) if e[i] > e[i - 1] and e[i] >= e[i + 1]]
    assert all(min(abs(p - f) for p in peaks) < 0.5 * f0 for f, _ in formants) and len([p for p in peaks if 300 < p < 2500]) <= 3
    assert (analysis.aperiodicities(x, 16_000.0, found, 1024, 4)[0] < 0.3).all()


def test_noise_is_aperiodic():
    noise = np.random.default_rng(1).normal(size=(1, 1024))
    found, _ = analysis.pitches(noise, 16_000.0)
    assert found[0] == 0 and (analysis.aperiodicities(noise, 16_000.0, found, 1024, 4) == 1).all()
    high = np.fft.rfft(noise)
    high[:, :256] = 0
    x = vowel(125.0, [(700.0, 80.0)])[None]
    mixed = x + np.fft.irfft(high) * x.std() * 0.5
    a = analysis.aperiodicities(mixed, 16_000.0, np.array([125.0]), 1024, 4)[0]
    assert a[0] < 0.2 and a[2] > 0.5 and a[3] > 0.5


def test_analysis_of_odd_frames(spark):
    rows = [(1, vowel(125.0, [(700.0, 80.0)]).tolist()), (2, None), (3, []), (4, [0.0] * 512), (5, [0.0] * 2000), (6, [1.0, 2.0]), (7, vowel(200.0, [(500.0, 80.0)])[:600].tolist())]
    got = {r.id: r for r in analysis.analysed(spark.createDataFrame(rows, "id int, samples array<double>").repartition(2), 16_000.0).collect()}
    assert len(got) == 7 and abs(got[1].f0 - 125) < 1 and abs(got[7].f0 - 200) < 2 and len(got[1].envelope) == 513
    assert all(got[i].f0 is None and got[i].envelope is None for i in (2, 3, 5))
    assert got[4].f0 == 0 and got[4].aperiodicity == [1.0] * 5 and got[6].f0 == 0 and np.isfinite(got[4].envelope).all()


def test_resampler_arguments(spark):
    full = ["x", "a.wav", "b.wav", " +12", "100", "g-5", "3", "4", "5", "-6", "-60", "100", "0"]
    calls = [full, full[:5], full[:4], [], None, [*full[:3], "4801", *full[4:]], [*full[:3], "1.5", *full[4:]], [*full[:4], "0", *full[5:]], [*full[:6], "-1", "99999999999", "x", "", "61", "101", "101"], [*full[:3], "7\n", *full[4:]], [*full[:3], None, "5"], [*full, "AA"], ["x", "", *full[2:]]]
    df = spark.createDataFrame(list(enumerate(calls)), "i int, args array<string>")
    got = {r.i: r.a for r in df.select("i", arguments.resampler(F.col("args")).alias("a")).collect()}
    assert tuple(got[0]) == ("a.wav", "b.wav", 12, 100, "g-5", 3, 4, 5, -6, -60, 100, 0, None, True)
    assert got[1].is_valid and (got[1].flags, got[1].end, got[1].volume) == ("", 100, 0)
    assert [got[i].error for i in (2, 3, 4)] == ["too few arguments: 4", "too few arguments: 0", "too few arguments: 0"]
    assert [got[i].error for i in (5, 6, 7, 9, 10)] == ["no valid pitch: 4801", "no valid pitch: 1.5", "no valid velocity: 0", "no valid pitch: 7\n", "no valid pitch: "]
    assert got[11].error == "too many arguments: 14" and got[12].error == "empty path" and not got[12].is_valid
    assert tuple(got[8])[5:12] == (0, 0, 0, 0, 0, 0, 100) and got[8].is_valid


def test_pulse_and_engine_of_odd_values(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [0.9, 0.1], 0.5, 6.0), (2, None, [], None, None)], "i int, s array<double>, a array<double>, b double, t double")
    none = F.lit(None).cast("double")
    got = {r.i: r.p for r in df.select("i", voice.pulse(F.col("s"), F.col("a"), F.col("b"), F.lit(1.0), F.col("t"), none, none).alias("p")).collect()}
    assert got[1].aperiodicity == [1.0, 0.6] and got[1].spectrum == pytest.approx([1.0, 2 * 10**0.15]) and got[1].amplitude_scale == 1
    assert got[2].spectrum is None and got[2].aperiodicity == []
    made = df.select(voice.engine(F.lit(50), F.lit(0.01), none, F.lit(True), none, F.col("b"), F.col("b"), F.col("b")).alias("m")).collect()
    assert made[0].m.harmonics == 75 and made[0].m.window == "gaussian" and made[0].m.side_lobe_db is None
    assert made[1].m.harmonics == 50 and made[1].m.window is None and made[1].m.random_phase is False
