"""Scalar functions of pitch, tempo, normalisation, names, positions and dates. Null gives null unless a docstring says otherwise."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: The range of normalised pitch in cents, and the least spread that is told from none.
CENTS_RANGE, LEAST_SPREAD = 4800.0, 1e-8


def cents(hertz: Column) -> Column:
    """Cents above 440 Hz; null for frequencies of 0 and less."""
    return 1200 * F.log2(F.when(hertz > 0, hertz) / 440)


def note(hertz: Column) -> Column:
    """The nearest note from 0 to 127; 0 for frequencies of 0 and less."""
    near = F.floor(69 + 12 * F.log2(F.when(hertz > 0, hertz) / 440) + 0.5).cast("int")
    return F.when(hertz <= 0, 0).when(hertz > 0, F.greatest(F.lit(0), F.least(F.lit(127), near)))


def quarter_us(bpm: Column) -> Column:
    """Microseconds of a quarter note; its own inverse."""
    return F.try_divide(F.lit(60_000_000.0), bpm)


def bend(value: Column, semitones: float = 2.0) -> Column:
    """Semitones of a pitch bend of -8192 to 8191."""
    return value / 8192 * semitones


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    """0 without spread."""
    return F.when(deviation <= LEAST_SPREAD, 0.0).otherwise((value - mean) / F.when(deviation > LEAST_SPREAD, deviation))


def from_z_score(z: Column, mean: Column, deviation: Column) -> Column:
    return z * deviation + mean


def min_max(value: Column, least: Column, most: Column) -> Column:
    """0 without range."""
    return F.when(most - least <= LEAST_SPREAD, 0.0).otherwise((value - least) / F.when(most - least > LEAST_SPREAD, most - least))


def from_min_max(x: Column, least: Column, most: Column) -> Column:
    return x * (most - least) + least


def robust(value: Column, median: Column, low: Column, high: Column) -> Column:
    """Distance from the median in quartile ranges; 0 without range."""
    return F.when(high - low <= LEAST_SPREAD, 0.0).otherwise((value - median) / F.when(high - low > LEAST_SPREAD, high - low))


def log_scale(value: Column) -> Column:
    return F.log(F.greatest(value, F.lit(1e-8)) + 1)


def cents_unit(value: Column) -> Column:
    return value / CENTS_RANGE


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays; null where their lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.sqrt(total))


def relative(index: Column, start: Column, end: Column) -> Column:
    """Where an index stands between start and end, 0 to 1."""
    return F.when((end <= start) | (index < start), 0.0).when(index >= end, 1.0).otherwise((index - start) / F.when(end > start, end - start))


def cache_key(index: Column, size: Column, around: Column) -> Column:
    """``idx:<index>_size:<size>`` and the phonemes around, each after an underscore."""
    head = F.concat(F.lit("idx:"), index.cast("string"), F.lit("_size:"), size.cast("string"))
    return F.concat(head, F.when(F.size(around) > 0, F.concat(F.lit("_"), F.array_join(around, "_"))).otherwise(""))


def hash32(text: Column) -> Column:
    """A stable 32-bit hash of a text's bytes (CRC-32), unsigned; null as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def iso_time(time: Column) -> Column:
    """UTC as 2024-01-31T23:59:59Z, fractions cut; the session's time zone must be UTC."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_iso_time(text: Column) -> Column:
    """The moment that such a text names; null for any other."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def within_days(time: Column, until: Column, days: int) -> Column:
    """True from ``days`` days before a moment up to it."""
    return (time >= until - F.expr(f"INTERVAL {days} DAYS")) & (time <= until)


def voiced(hertz: Column, threshold: float = 50.0) -> Column:
    """True for finite pitches above a threshold; null is not."""
    return F.coalesce((hertz > threshold) & ~F.isnan(hertz) & (hertz < float("inf")), F.lit(False))


def acoustic(number: Column, hertz: Column, dims: int) -> Column:
    """A made-up feature vector of a model: sin(0.5 number + 0.1 i) + 0.001 hertz."""
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.sin(0.5 * number + 0.1 * i) + hertz * 0.001)


def merged(spectrum: Column, trajectory: Column) -> Column:
    """spectrum * exp(0.1 trajectory), place by place over the common length; the rest of the spectrum stays."""
    return F.transform(spectrum, lambda v, i: v * F.exp(0.1 * F.coalesce(F.get(trajectory, i), F.lit(0.0))))


def anti_aliased(values: Column) -> Column:
    """Each inner value blended 0.8 to 0.2 with the mean 1:2:1 of its neighbours, the left one already smoothed; under four values stay."""
    n = F.size(values)
    step = lambda s, i: F.concat(s, F.array(
        F.when((i == 0) | (i == n - 1), F.get(values, i)).otherwise(0.8 * (0.25 * F.element_at(s, F.greatest(i, F.lit(1))) + 0.5 * F.get(values, i) + 0.25 * F.coalesce(F.get(values, i + 1), F.lit(0.0))) + 0.2 * F.get(values, i))
    ))
    return F.when(n < 4, values).otherwise(F.aggregate(F.sequence(F.lit(1), n - 1), F.slice(values, 1, 1), step))


def quality_gate(distortion: Column, continuity: Column, ratio: Column) -> tuple[Column, Column]:
    """Whether an augmented row passes (distortion under 2, continuity over 0.7, range ratio between 0.5 and 2), and what it fails by,
    separated by ``; ``. Null metrics fail."""
    tests = (("high spectral distortion", distortion < 2), ("poor pitch continuity", continuity > 0.7), ("range out of bounds", (ratio > 0.5) & (ratio < 2)))
    bad = [F.when(~F.coalesce(ok, F.lit(False)), what) for what, ok in tests]
    issues = F.concat_ws("; ", *bad)
    return issues == "", issues


def weights(values: Column) -> Column:
    """Weights that add up to one; equal ones where their sum is 0."""
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    return F.transform(values, lambda v: F.when(total > 0, v / F.when(total > 0, total)).otherwise(1.0 / F.size(values)))


@F.pandas_udf(BinaryType())
def deflated(content: pd.Series) -> pd.Series:
    """zlib, level 6; null stays null."""
    return content.map(lambda b: None if b is None else zlib.compress(bytes(b), 6))


@F.pandas_udf(BinaryType())
def inflated(content: pd.Series) -> pd.Series:
    """The bytes again; null for what is not zlib."""

    def back(b):
        try:
            return None if b is None else zlib.decompress(bytes(b))
        except zlib.error:
            return None

    return content.map(back)
