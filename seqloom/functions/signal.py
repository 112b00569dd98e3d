"""Array functions: windows, resampling, stretching, tilt, cepstra, all as higher-order expressions inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bessel(x: str) -> str:
    """SQL for the modified Bessel function of order 0, by 40 terms of its series."""
    return f"aggregate(sequence(1, 40), struct(1D AS t, 1D AS s), (a, k) -> struct(a.t * power({x} / 2 / k, 2) AS t, a.s + a.t * power({x} / 2 / k, 2) AS s), a -> a.s)"


def window(kind: str, n: int) -> Column:
    """A window of n points."""
    x = {
        "hann": "0.5 - 0.5 * cos(2 * pi() * i / {m})", "hamming": "0.54 - 0.46 * cos(2 * pi() * i / {m})",
        "blackman": "0.42 - 0.5 * cos(2 * pi() * i / {m}) + 0.08 * cos(4 * pi() * i / {m})",
        "blackman_harris": "0.35875 - 0.48829 * cos(2 * pi() * i / {m}) + 0.14128 * cos(4 * pi() * i / {m}) - 0.01168 * cos(6 * pi() * i / {m})",
        "nuttall": "0.355768 - 0.487396 * cos(2 * pi() * i / {m}) + 0.144232 * cos(4 * pi() * i / {m}) - 0.012604 * cos(6 * pi() * i / {m})",
        "tukey": "CASE WHEN least(i, {m} - i) < {m} / 4.0D THEN 0.5 * (1 - cos(4 * pi() * least(i, {m} - i) / {m})) ELSE 1D END",
        "kaiser": _bessel("8.6D * sqrt(greatest(0D, 1 - power(2.0D * i / {m} - 1, 2)))") + " / " + _bessel("8.6D"),
        "gaussian": "exp(-0.5 * power((i - {m} / 2.0D) / ({n} / 6.0D), 2))",
    }[kind]
    return F.expr(f"transform(sequence(0, {n - 1}), i -> {x.format(m=n - 1, n=n)})")


def resample(values: str, ratio: float) -> Column:
    """Linear interpolation to int(n * ratio) points at i / ratio; the last value is held."""
    at = f"CAST(floor(i / {ratio}D) AS INT)"
    return F.expr(
        f"CASE WHEN CAST(size({values}) * {ratio}D AS INT) < 1 THEN slice({values}, 1, 0) ELSE transform(sequence(0, CAST(size({values}) * {ratio}D AS INT) - 1), i -> "
        f"CASE WHEN {at} + 1 < size({values}) THEN {values}[{at}] + ({values}[{at} + 1] - {values}[{at}]) * (i / {ratio}D - {at}) ELSE {values}[size({values}) - 1] END) END"
    )


def peak_normalised(values: str) -> Column:
    most = f"array_max(transform({values}, x -> abs(x)))"
    return F.expr(f"transform({values}, x -> CASE WHEN {most} > 0 THEN x / {most} ELSE x END)")


def pitch_shift(values: str, semitones: float, low: float = 50.0, high: float = 1000.0) -> Column:
    return F.expr(f"transform({values}, x -> CASE WHEN x > 0 THEN greatest({low}D, least({high}D, x * power(2, {semitones}D / 12))) ELSE x END)")


def cepstra(values: str, n: int, keep: int) -> Column:
    """The first ``keep`` coefficients of the orthonormal DCT-II of n values."""
    sums = f"aggregate(sequence(0, {n - 1}), 0D, (s, j) -> s + {values}[j] * cos(pi() * k * (2 * j + 1) / {2 * n}))"
    return F.expr(f"transform(sequence(0, {keep - 1}), k -> {sums} * CASE WHEN k = 0 THEN {math.sqrt(1 / n)!r}D ELSE {math.sqrt(2 / n)!r}D END)")


def semitone_name(note: Column) -> Column:
    names = F.array(*(F.lit(x) for x in ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")))
    return F.concat(F.element_at(names, (note % 12 + 1).cast("int")), (F.floor(note / 12) - 1).cast("string"))


def hertz(note: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (note - 69) / 12.0)


def flags(text: str) -> Column:
    """Letters and a signed number after them, as a map in lower case; the last of repeated letters counts."""
    pairs = f"transform(regexp_extract_all({text}, '[A-Za-z]+[+-]?[0-9]+', 0), x -> struct(lower(regexp_extract(x, '^[A-Za-z]+', 0)) AS k, CAST(regexp_extract(x, '[+-]?[0-9]+$', 0) AS INT) AS v))"
    return F.expr(f"map_from_entries(aggregate({pairs}, CAST(array() AS ARRAY<STRUCT<k: STRING, v: INT>>), (a, x) -> concat(filter(a, y -> y.k <> x.k), array(x))))")


def magnitudes(values: str, n: int, keep: int) -> Column:
    """Magnitudes of the first ``keep`` terms of the discrete Fourier transform of n values, by definition."""
    part = lambda f: f"aggregate(sequence(0, {n - 1}), 0D, (s, j) -> s + {values}[j] * {f}(2 * pi() * k * j / {n}))"
    return F.expr(f"transform(sequence(0, {keep - 1}), k -> sqrt(power({part('cos')}, 2) + power({part('sin')}, 2)))")


def padded(values: str, n: int) -> Column:
    """Exactly n values: cut, or followed by zeros."""
    return F.expr(f"concat(slice({values}, 1, {n}), array_repeat(0D, greatest(0, {n} - size({values}))))")


def tilted(values: str, decibels: float) -> Column:
    """A log spectrum with a tilt that rises in equal steps to ``decibels`` at the last bin."""
    return F.expr(f"transform({values}, (x, i) -> x + ln(power(10D, {decibels}D * i / greatest(1, size({values}) - 1) / 20)))")
